"""Identifiers derived from content, as SQL expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestrata.functions.text import folded


def digest(*parts: Column, width: int = 64) -> Column:
    """Hex SHA-256 over the parts, each led by its length in 8 big-endian bytes; null if any part is."""
    framed = []
    for p in parts:
        raw = F.encode(p.cast("string"), "UTF-8")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(p.cast("string"))), 16, "0")), raw]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, width)


def nul_digest(*parts: Column, width: int = 24) -> Column:
    """Hex SHA-256 over the parts joined by NUL; null if any part is."""
    joined: list[Column] = []
    for i, p in enumerate(parts):
        joined += ([F.lit("\0")] if i else []) + [p.cast("string")]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, width)


def hash_bucket(value: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of the value's SHA-256, modulo the number of buckets."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % buckets


def assigned_split(group: Column) -> Column:
    """train below 80, validation below 90, else test, of the group's bucket of 100."""
    b = hash_bucket(group)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def document_group(source_file: Column, source_uri: Column, document_id: Column) -> Column:
    """Report-level group of a document: its file's folder where the path names a page of a report.

    A page is a file whose name starts with page_, two folders deep or more. Blank files count as none.
    """
    first = lambda c: F.when(F.trim(c) != "", c)
    path = folded(F.regexp_replace(F.replace(F.coalesce(first(source_file), first(source_uri), document_id), F.lit("\\"), F.lit("/")), r"^\s+|\s+$", ""))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    rooted = path.startswith("/")
    paged = (F.size(parts) + rooted.cast("int") >= 3) & F.element_at(parts, -1).startswith("page_")
    report = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    return F.concat(F.lit("source-group:"), digest(F.when(paged, report).otherwise(path), width=24))
