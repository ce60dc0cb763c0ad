"""Identities: hash ids, scope ids, fingerprints, all as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def stable_id(*parts) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by a bar; null counts as the word None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def document_id(bid, path) -> Column:
    return stable_id(F.lit("document"), bid, path)


def page_id(document, location) -> Column:
    return stable_id(F.lit("page"), document, location)


def table_id(page, index) -> Column:
    return stable_id(F.lit("table"), page, index)


def chunk_id(document, index, text) -> Column:
    return stable_id(F.lit("chunk"), document, index, text)


def relative_path(path) -> Column:
    """Forward slashes; leading dots and slashes go, all of them."""
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "^[./]+", "")


def scope_id(bid, path) -> Column:
    return F.concat_ws(":", col(bid), relative_path(path))


def fingerprint(*named) -> Column:
    """SHA-256 of a canonical JSON object of the (name, column) pairs, keys in order."""
    return F.sha2(F.to_json(F.struct(*[col(c).alias(n) for n, c in sorted(named)]), {"ignoreNullFields": "false"}), 256)


def record_id(scope, chunk, content) -> Column:
    """24 hex digits over scope, chunk and content fingerprint."""
    return F.substring(F.sha2(F.concat(F.lit('["'), F.concat_ws('","', col(scope), col(chunk), col(content)), F.lit('"]')), 256), 1, 24)


def bid_number(folder, official=None) -> Column:
    """The official number if there is one, else 12 digits from the hash of the slug of the folder's name."""
    slug = F.trim(F.regexp_replace(F.lower(col(folder)), "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.conv(F.substring(F.sha2(slug, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    derived = (F.lit(100000000000).cast("decimal(20,0)") + head % F.lit(900000000000).cast("decimal(20,0)")).cast("long").cast("string")
    return derived if official is None else F.coalesce(F.nullif(F.trim(col(official)), F.lit("")), derived)
