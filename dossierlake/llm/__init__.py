"""Training-data operators: dedup, decontamination, tokenization, extraction and filters."""
