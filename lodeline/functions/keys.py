"""Identities: digests of files, chunks and memories, name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the standard's namespace for URLs


def chunk_id(source: Column, file_hash: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, file_hash, index.cast("string")), 256)


def _short(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24)))


def _plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def topic_key(subject: Column, question: Column) -> Column:
    return _short("topic:", subject, _plain(question))


def difficulty_key(subject: Column, question: Column) -> Column:
    return _short("difficulty:", F.lit("difficulty"), subject, _plain(question))


def agent_key(kind: Column, subject: Column, content: Column) -> Column:
    return F.concat(kind, _short(":agent:", F.lit("agent"), kind, subject, _plain(content)))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
