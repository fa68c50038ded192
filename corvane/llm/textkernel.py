"""Words and word shingles of whole Arrow batches as numpy arrays.

A word is a maximal run of characters that are not Unicode white space (as in str.split()); letter case and
punctuation count. A shingle is five successive words; a text of one to four words has one shingle, of all of them;
a text without words, or null, has none. Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SHINGLE = 5
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_MULT = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
# UTF-8 of the white space beyond ASCII.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
# The same white space as a class of RE2; marks are Unicode punctuation and symbols.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARKS = r"[\pP\pS]+"
#: Bytes that one step looks at; a longer text is one step of its own.
STEP = 1 << 21
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, U)
            p[0] = U(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text (null: empty), without a copy."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def strings(texts: pa.Array) -> list[str | None]:
    """The texts as Python strings, far faster than one scalar at a time."""
    return texts.to_numpy(zero_copy_only=False).tolist() if len(texts) else []


def folded(texts: pa.Array) -> pa.Array:
    """texts without letter case and without the marks at either end of each word; words of marks alone vanish."""
    low = pa.array([t and t.casefold() for t in strings(texts)], pa.string())
    low = pc.replace_substring_regex(low, f"(^|[{_BLANK}]){_MARKS}", r"\1")
    return pc.replace_substring_regex(low, f"{_MARKS}([{_BLANK}]|$)", r"\1")


def steps(off: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP bytes together."""
    n, at = len(off) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield at, end
        at = end


def spaces(buf: np.ndarray) -> np.ndarray:
    out = _SPACE[buf]
    if len(buf) > 1:
        for i in np.flatnonzero(_LEAD[buf]) if _LEAD[buf].any() and _has_wide(buf) else ():
            for w in _WIDE:
                if bytes(buf[i : i + len(w)]) == w:
                    out[i : i + len(w)] = True
    return out


def _has_wide(buf: np.ndarray) -> bool:
    data = buf.tobytes()
    return any(w in data for w in _WIDE)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = ~spaces(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes; span_hash() takes substrings out of them."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U))


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., counts[0]-1, 0, 1, ..., counts[1]-1, ..."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (of size words, SHINGLE at most) in text order, and their number for each text."""
    starts, ends, n = words(buf, off)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    if not len(starts):
        return np.zeros(0, U), counts
    h = np.concatenate([span_hash(prefix(buf), starts, ends), np.zeros(SHINGLE, U)])
    at = np.repeat(np.cumsum(n) - n, counts) + spread(counts)
    out = np.zeros(len(at), U)
    short = np.repeat(n, counts)
    for j in range(size):
        part = h[at + j]
        if (n < size).any():
            part = np.where(j < short, part, U(0))
        out += part * _MULT[j]
    return mix(out), counts


def sketched(ids: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many of a row's distinct features, chosen by a hash of their numbers, with the same weight in all."""
    if len(ids) <= most:
        return ids, weights
    some = np.sort(np.argsort(mix(ids.astype(U) + U(1)), kind="stable")[:most])
    return ids[some], weights[some] * (weights.sum() / max(weights[some].sum(), 1e-30))


def batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, shingle hashes, counts: of successive runs of texts."""
    buf, off = raw(texts)
    for a, b in steps(off):
        h, counts = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, h, counts


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, _, h, counts in batches(texts):
        out += [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
    return out


def shingle_sql(table: str, key: str, name: str) -> str:
    """Two common table expressions in SQL for another engine: the distinct shingles (key, g) of a table's texts."""
    return f"""
    {name}_words AS (SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM {table}),
    {name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {name}_words)"""
