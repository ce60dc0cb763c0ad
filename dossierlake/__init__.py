"""Dossierlake: a Spark-native engine that turns document folders into queryable, cited evidence."""
