"""Spans of patterns in texts, found on UTF-8 bytes and told in code points. All patterns are of ASCII characters, so bytes match
where characters do."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def in_code_points(raw: bytes, found: list[Span]) -> list[Span]:
    """Byte offsets to code points; ends exclusive."""
    if raw.isascii() or not found:
        return found
    places = sorted({p for _, a, b in found for p in (a, b)})
    at, count, known = 0, 0, {}
    for p in places:
        count += len(raw[at:p].decode("utf-8", "replace"))
        known[p], at = count, p
    return [(k, known[a], known[b]) for k, a, b in found]


def value_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed (others after those, by name), then end; comma-joined."""

    def key(s: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
        return F.struct(s["start"].alias("start"), F.when(place > 0, place).otherwise(len(kinds) + 1).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))

    ordered = F.array_sort(F.transform(spans, key))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
