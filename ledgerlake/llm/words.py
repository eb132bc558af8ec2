"""Words of many texts at once, as places and 64-bit hashes in arrays, without a Python object for each word.

The texts of an Arrow column lie one after the other in one buffer. A word is a run of bytes that are no ASCII blank, inside one
text. Its hash is a polynomial over its bytes (a random 64-bit word for each byte value, times the powers of an odd constant), taken
as a difference of prefix sums; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose prefix sums are held at once; a longer word is hashed by itself.
SPAN = 1 << 16
#: Bytes of a group of whole texts; a longer text is a group of its own.
GROUP = 1 << 20

_rng = np.random.default_rng(20_240_502)


def _powers(base: int, dtype: type) -> np.ndarray:
    factors = np.full(SPAN + 1, base, dtype)
    factors[0] = 1
    return np.cumprod(factors, dtype=dtype)


def _tables(dtype: type, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte (one for both cases of A-Z if `fold`), the base's powers and those of its inverse."""
    bits = 8 * np.dtype(dtype).itemsize
    value = _rng.integers(1, 1 << (bits - 1), 256, dtype=dtype) * dtype(2) + dtype(1)
    if fold:
        value[65:91] = value[97:123]
    base = int(_rng.integers(1, 1 << (bits - 2))) * 4 + 5
    return value, _powers(base % (1 << bits), dtype), _powers(pow(base, -1, 1 << bits), dtype)


FOLDED = _tables(np.uint64, True)
#: Two hashes that tell upper from lower case; together they tell words apart.
EXACT, CHECK = _tables(np.uint64, False), _tables(np.uint32, False)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def groups(column: pa.Array, most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets from 0) of runs of whole texts, in order: at most `most` bytes, or one longer text."""
    if not len(column):
        return
    data, offsets = buffer(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, count of each text) of the words."""
    solid = ~_BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][full]
    first[edge] = solid[edge]
    edge = offsets[1:][full] - 1
    last[edge] = solid[edge]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begins, offsets))


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, tables: tuple = FOLDED) -> np.ndarray:
    """The hashes of the pieces from begins to ends, which ascend; by default equal where only the case of A-Z differs."""
    value, power, inverse = tables
    dtype = value.dtype.type
    out = np.empty(len(begins), dtype)
    i = 0
    while i < len(begins):
        at = int(begins[i])
        j = int(np.searchsorted(ends, at + SPAN, "right"))
        if j <= i:
            import xxhash

            raw = data[at : ends[i]].tobytes()
            digest = (xxhash.xxh3_64_intdigest if dtype is np.uint64 else xxhash.xxh32_intdigest)(raw.lower() if tables is FOLDED else raw)
            out[i] = digest
            i += 1
            continue
        n = int(ends[j - 1]) - at
        sums = np.zeros(n + 1, dtype)
        np.cumsum(value[data[at : at + n]] * power[:n], dtype=dtype, out=sums[1:])
        b, e = begins[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[b]) * inverse[b]
        i = j
    return out


def runs(found: np.ndarray, counts: np.ndarray, size: int, factors: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of all its words where there are fewer."""
    stops = np.cumsum(counts)
    total = np.full(max(0, len(found) - size + 1), size, np.uint64)
    for k in range(size):
        total += found[k : k + len(total)] * factors[k]
    total = mix(total)
    out = []
    for begin, stop in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        n = stop - begin
        if n >= size:
            own = np.sort(total[begin : stop - size + 1])
            if len(own) > 1:
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                own = own[fresh]
        elif n:
            own = mix(np.uint64(n) + (found[begin:stop] * factors[:n]).sum(dtype=np.uint64, keepdims=True))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
    return out
