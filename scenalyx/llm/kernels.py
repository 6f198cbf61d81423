"""Vectorised byte kernels on Arrow text columns.

Every kernel works on one *chunk*: a few whole texts as one uint8 buffer plus
the offsets between them, about ``CHUNK_BYTES`` of text (one longer text makes
a chunk of its own), so working memory follows the chunk and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
LONG_SPAN = 256
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW: dict = {}

#: Bytes that separate words: space, tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, uint8 buffer, int64 offsets) of whole texts; null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(text))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd multiplier and of its inverse, modulo 2**64."""
    if n >= len(_POW.get("p", ())):
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("p", _MULT), ("i", pow(_MULT, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POW[name] = np.multiply.accumulate(out)
    return _POW["p"], _POW["i"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums s with s[e]-s[b] the polynomial hash of data[b:e], shifted by b."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[begin:end]; the length counts too."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def long_spans(hashed: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes with those of spans over LONG_SPAN bytes taken from the bytes themselves: polynomials
    modulo 2**64 have equal values for some long texts, whatever their base."""
    for i in np.flatnonzero(end - begin > LONG_SPAN).tolist():
        hashed[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return hashed


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of True within one text."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Word hashes of a chunk and the index of each text's first word (one more than texts)."""
    begin, end = runs(~IS_SPACE[data], offsets)
    data = LOWER[data] if lower else data
    hashed = long_spans(span_hash(prefix_hash(data), begin, end), data, begin, end)
    return hashed, np.searchsorted(begin, offsets), begin, end


def shingles(word: np.ndarray, first: np.ndarray, n: int):
    """Hash of each n-word shingle and its text; a text of fewer words is one shingle, if any."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    code = mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0xA24BAED4963EE407)) | U64(1)
    acc = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n if len(acc) else 0):
        acc += word[k : len(word) - n + 1 + k] * code[k]
    whole = np.flatnonzero(doc[: len(acc)] == doc[n - 1 :][: len(acc)])
    out, of = mix(acc[whole] + U64(n)), doc[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        tail = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            tail[has] += word[first[short[has]] + k] * code[k]
        out = np.concatenate([out, mix(tail + count[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    return out, of


def distinct_by_doc(values: np.ndarray, doc: np.ndarray, n_docs: int):
    """Sorted distinct values of each text, and the texts' offsets among them."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, doc, np.searchsorted(doc, np.arange(n_docs + 1))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]], modulo 2**64 for unsigned values."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def planes(values: np.ndarray, size: int) -> bytes:
    """The low bytes of each value, byte by byte, so that equal high bytes stand together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplanes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()
