"""Suffix-array dedup: remove bytes that a smaller document already holds.

Every byte covered by a ``width``-byte string that also starts in a document of
smaller doc_id goes. Suffixes are never compared as text: they stand in buckets,
and buckets are refined by the identifiers of other buckets.

1. Sampling. In each text a start p is filed under the 20-byte gram of smallest
   hash among those inside its width-byte string. Equal strings choose the same
   gram at the same place; consecutive starts that choose one occurrence make a
   *unit*. A unit whose whole extent a smaller document has too is decided at once.
   Only units whose gram two documents hold, and that are not decided, go on: one
   byte in twenty, or so, of a corpus with many copies.
2. Initial buckets. The q-grams at the places that the open starts need are sorted;
   a bucket's identifier is its rank among the shared ones of the partition that
   sorted it, and goes back to every place. A gram that one document alone holds has
   no identifier, and neither has what is built on it.
3. Refinement. The pair (identifier at p, identifier at p + h) sorts the suffixes by
   twice the depth h; its rank is the new identifier, goes back, and is what the next
   round sorts by, until width bytes are covered (the last offset is shorter). The
   last round asks for the smallest document of each bucket instead.
4. What is decided goes back to its document as spans, and bytes go.

Places of one batch of open text are kept in the shared folder from round to round
as a *state*: its starts, and for each place the number of its identifier among the
batch's distinct ones. Postings and answers are arrays of equal order, so no place
is named on the way. Texts move twice: to find the open starts, and to lose bytes. A round goes
through its postings, and then its states, slice by slice, and drops each slice when it
is done, so postings are not on disk together with their shuffle and their answers.

Skew: equal postings fold within a batch, so a passage that many documents share
comes once from each batch. Units of a gram that a batch holds in many extents are
dealt by their extents, and told open without being asked about.

Identity: a string is known by two identifiers, of its first q bytes and of its
last q bytes (and those between, for small q), each from 48 bits of hash and the
partition that sorts them, which other bits choose; unit extents by 48 bits of hash
beside the 32 and the partition of their gram.

Defined cases: null text is empty; texts shorter than width lose nothing; rows
of equal doc_id do not affect one another; rows without a doc_id lose nothing
and affect nothing; no rows give no rows; texts of any length go by one rule; other
columns are ignored, but ``carry`` (any column made of them) stays with its row. A
kept text drops the rest of a character of which a removed span took some bytes;
kept_sha256 is of the bytes themselves.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .spark import Scratch, Sliced, map_arrow, partitions, session_of, target_column, targets

WIDTH, SAMPLE, QGRAM = 50, 20, 25
FLUSH_BYTES = 6 << 20
FLUSH_PLACES = 500_000
#: A batch deals the units of a gram by their extents if it holds it in more extents than these.
MANY_EXTENTS = 64
ROW = "part int, kind int, ids binary, a binary, b binary, c binary"
#: Rows of the refinement: a state, postings of a part, answers for them, spans of a document.
ROUND = "part int, kind int, flush long, sub int, a binary, b binary, c binary"
SPAN, STATE, ANSWER, POSTING = 0, 1, 2, 3
RANK_BITS = 40
#: A round goes through its parts in so many slices at most, of at least so many parts and bytes of answers each; texts meet their answers in so many.
#: Every slice is a file, and its folder, of each task that writes: four spare most of the disk that more would.
SLICES, PARTS_A_SLICE, BYTES_A_SLICE, TEXT_SLICES = 4, 12, 16 << 20, 4
#: Rows that a task gives go out in batches of about so many bytes: Python, Arrow and Spark each hold one whole.
BATCH_BYTES = 1 << 20


def slices_of(n: int, size: int) -> int:
    """Slices of n parts, for so many bytes of answers to units: where little is open, slices would cost tasks and files and spare no disk."""
    return max(1, min(SLICES, n // PARTS_A_SLICE, size // BYTES_A_SLICE))


def smallest_in_windows(value: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest value (the first of equals) in each window of w, by doubling."""
    place = np.arange(len(value))
    span, best = 1, value
    while span < w:
        step = min(span, w - span)
        n = len(best) - step
        later = best[step:] < best[:n]
        # windows overlap unless they double: of equal values the earlier place wins either way
        best, place = np.where(later, best[step:], best[:n]), np.where(later, place[step:], place[:n])
        span += step
    return place


def units(data: np.ndarray, offsets: np.ndarray, width: int, q: int):
    """Every unit of a chunk: (text, first start, end of starts, gram hash, extent hash), and prefix sums."""
    n, w = len(data), width - q + 1
    sums = K.prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), sums
    _, inv = K.powers(n + 1)
    gram = K.mix((sums[q:] - sums[:-q]) * inv[: n - q + 1])
    pick = smallest_in_windows(gram, w)  # by start p, 0..n-width
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(size >= width)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long] + size[long] - width + 1, -1)
    ok = np.cumsum(valid)[: len(pick)] > 0
    head = ok.copy()
    head[1:] &= (pick[1:] != pick[:-1]) | ~ok[:-1]
    inner = offsets[:-1][size >= width]
    head[inner] = True
    begin = np.flatnonzero(head)
    tail = ok.copy()
    tail[:-1] &= head[1:] | ~ok[1:]
    end = np.flatnonzero(tail) + 1
    doc = np.searchsorted(offsets, begin, "right") - 1
    extent = K.mix(K.span_hash(sums, begin, end - 1 + width) + (pick[begin] - begin).astype(np.uint64) * K.U64(0x8CB92BA72F3D8DD7))
    return doc, begin, end, gram[pick[begin]], extent, sums


def _answer(identifier, doc_id):
    """What tells document doc_id about an identifier."""
    return K.mix(identifier ^ K.mix(doc_id.astype(np.int64).view(np.uint64) + K.U64(0x27D4EB2F165667C5)))


def _unit_key(gram, extent):
    return K.mix(gram ^ (extent * K.U64(0x9FB21C651E98DF25)))


def _blobs(part, parts_keys, n, make, kind):
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(n + 1))
    return [(int(parts_keys[p]), kind, *make(order[at[p] : at[p + 1]])) for p in np.flatnonzero(np.diff(at))]


def _batch(rows):
    c = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.binary()) for x in c[2:])], ["part", "kind", "ids", "a", "b", "c"])


def _pack(doc, a, a_size, b, b_size):
    """Postings (document, a, b) as packed columns; a is sorted and held as differences."""
    order = np.argsort(a, kind="stable")
    ids, index = np.unique(doc[order], return_inverse=True)
    return ids.tobytes(), K.planes(np.diff(a[order], prepend=K.U64(0)), a_size), K.planes(b[order], b_size), index.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32).tobytes()


def _unpack(ids, a, a_size, b, b_size, c):
    a = np.cumsum(K.unplanes(a, a_size), dtype=np.uint64)
    index = np.frombuffer(c, np.uint16 if len(c) == 2 * len(a) else np.uint32)
    return np.frombuffer(ids, np.int64)[index], a, K.unplanes(b, b_size)


def _deal_by_id(high, n):
    # mixed again: hashes that were chosen for being small are not even
    return ((K.mix(high + K.U64(0x9E6C63D0876A9A99)) >> K.U64(32)) * K.U64(n) >> K.U64(32)).astype(np.int64)


def _fold(first, second, doc):
    """Sort by (first, second, doc); heads of equal (first, second); index of each entry's head."""
    order = np.lexsort((doc, second, first))
    f, s = first[order], second[order]
    head = np.ones(len(order), bool)
    head[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    return order, head, np.cumsum(head) - 1


#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (K.U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _home(doc_id, n):
    """Partition of a document: XXH64 of its identifier, as Spark has it, so that steps between identifiers do not matter."""
    turn = lambda x, k: (x << K.U64(k)) | (x >> K.U64(64 - k))
    x = np.atleast_1d(np.asarray(doc_id, np.int64)).view(np.uint64)
    h = turn(turn(x * P2, 31) * P1 ^ (K.U64(42 + 8) + P5), 27) * P1 + P4
    h = (h ^ (h >> K.U64(33))) * P2
    h = (h ^ (h >> K.U64(29))) * P3
    return np.mod((h ^ (h >> K.U64(32))).view(np.int64), n)


def home_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n))


def _told(keys, n, kind, name, doc):
    """Answers of a kind to the documents' homes: what is said, under its name."""
    said = _answer(name, doc)
    return _blobs(_home(doc, n), keys, n, lambda i: (None, np.unique(said[i]).tobytes(), None, None), kind)


#: Kinds of the first round: units; decided and open units (answers); grams that are open anyhow; units dealt by extent.
UNIT, DECIDED, OPEN, OPEN_GRAM, SPREAD = 0, 1, 2, 3, 4


def _post_units(keys, width, q):
    n = len(keys)

    def emit(doc, gram, extent):
        doc, gram, extent = np.concatenate(doc), np.concatenate(gram), np.concatenate(extent)
        order, head, of = _fold(gram, extent, doc)
        doc, gram, extent = doc[order], gram[order], extent[order]
        name = _unit_key(gram & K.U64(0xFFFFFFFF), extent >> K.U64(16))
        known = np.flatnonzero(doc > doc[head][of])  # decided within this task
        rows = _told(keys, n, DECIDED, name[known], doc[known])
        doc, gram, extent, name = doc[head], gram[head], extent[head], name[head]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        many = ((np.bincount(group) > MANY_EXTENTS) & several)[group] if len(at) else np.zeros(0, bool)

        def make(i):
            return _pack(doc[i], gram[i] & K.U64(0xFFFFFFFF), 4, extent[i] >> K.U64(16), 6)

        few, spread, anyhow = np.flatnonzero(~many), np.flatnonzero(many), np.flatnonzero(many & first)
        rows += _told(keys, n, OPEN, name[spread], doc[spread])
        rows += _blobs(_deal_by_id(gram[few], n), keys, n, lambda i: make(few[i]), UNIT)
        rows += _blobs(_deal_by_id(name[spread], n), keys, n, lambda i: make(spread[i]), SPREAD)
        rows += _blobs(_deal_by_id(gram[anyhow], n), keys, n, lambda i: (None, (gram[anyhow[i]] & K.U64(0xFFFFFFFF)).tobytes(), None, None), OPEN_GRAM)
        return _batches(rows)

    def run(batches):
        held, doc, gram, extent = 0, [], [], []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch, "text"):
                of, _, _, g, x, _ = units(data, offsets, width, q)
                doc.append(ids[a:b][of].astype(np.int64))
                gram.append(g)
                extent.append(x)
                held += len(data)
                if held >= FLUSH_BYTES:
                    yield from emit(doc, gram, extent)
                    held, doc, gram, extent = 0, [], [], []
        if held:
            yield from emit(doc, gram, extent)

    return run


def _judge_units(keys):
    """Answers: units that a smaller document has, and units whose gram another document holds, too."""
    n = len(keys)

    def run(batches):
        found: dict[int, list] = {UNIT: [], SPREAD: []}
        passed = []
        anyhow = [np.zeros(0, np.uint64)]
        for batch in batches:
            for part, kind, ids, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind in found:
                    found[kind].append(_unpack(ids, a, 4, b, 6, c))
                elif kind == OPEN_GRAM:
                    anyhow.append(np.frombuffer(a, np.uint64))
                else:
                    passed.append((part, kind, ids, a, b, c))
            yield from _batches(passed)
            passed = []
        anyhow = np.unique(np.concatenate(anyhow))
        for kind, postings in found.items():
            if not postings:
                continue
            doc, gram, extent = (np.concatenate(x) for x in zip(*postings, strict=True))
            order, head, of = _fold(gram, extent, doc)
            doc, gram, extent = doc[order], gram[order], extent[order]
            known = doc > doc[head][of]
            yield from _batches(_told(keys, n, DECIDED, _unit_key(gram[known], extent[known]), doc[known]))
            if kind == SPREAD:  # these were told open by those who posted them
                continue
            g, x, d = gram[head], extent[head], doc[head]
            # a bucket stays open if units of two documents are left in it
            start = np.ones(len(g), bool)
            start[1:] = g[1:] != g[:-1]
            group, at = np.cumsum(start) - 1, np.flatnonzero(start)
            open_ = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at))[group] | _among(g, anyhow)
            yield from _batches(_told(keys, n, OPEN, _unit_key(g[open_], x[open_]), d[open_]))

    return run


def _finish(ids, texts, data, offsets, gone, keep_text):
    begin, end = K.runs(gone, offsets)
    at = np.searchsorted(begin, offsets)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
    rows = []
    for i in range(len(offsets) - 1):
        piece = data[offsets[i] : offsets[i + 1]]
        if lost[i]:
            piece = piece[~gone[offsets[i] : offsets[i + 1]]]
        raw = piece.tobytes()
        rows.append((ids[i], int(offsets[i + 1] - offsets[i]), int(lost[i]), int(at[i + 1] - at[i]), hashlib.sha256(raw).hexdigest(), (None if texts[i] is None else raw.decode("utf-8", "ignore")) if keep_text else None))
    c = list(zip(*rows, strict=True))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(x, t) for x, t in zip(c, types, strict=True)]


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
OUT_TYPES = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _meet(learn, fn):
    """Per part: first the rows with answers, then the documents. fn(learn(answer batches by kind), document batch)."""

    def run(batches):
        part, found, said = None, {}, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.r_[0, edge], np.r_[edge, len(parts)], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    part, found, said = parts[a], {}, None
                if kinds[a] < 9:
                    found.setdefault(int(kinds[a]), []).append(batch.slice(a, b - a))
                else:
                    if said is None:
                        said, found = learn(found), {}
                    yield from fn(said, batch.slice(a, b - a))

    return run


def _among(values, table):
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _names(found):
    """Sorted names of decided and of open units."""
    each = {k: [np.frombuffer(x, np.uint64) for batch in found.get(k, []) for x in batch.column(3).to_pylist()] for k in (DECIDED, OPEN)}
    return {k: np.unique(np.concatenate([np.zeros(0, np.uint64), *v])) for k, v in each.items()}


def _ranges(begin, size):
    """All numbers of the ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def depths(width: int, q: int) -> list[int]:
    """Depths of the buckets, from q doubling up to width."""
    out = [min(q, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def needed(starts: np.ndarray, steps: list[int]) -> list[np.ndarray]:
    """Places whose buckets are needed, for every depth: what the next depth needs, there and an offset later."""
    out = [starts]
    for a, b in zip(steps[-2::-1], steps[:0:-1], strict=True):
        last = out[0]
        mask = last.copy()
        mask[b - a :] |= last[: len(last) - (b - a)]
        out.insert(0, mask)
    return out


class State:
    """Open regions of a batch of texts: rows (doc_id, print), regions (row, begin, length), starts, and the numbers of identifiers."""

    SHAPES = (("doc", "<i8"), ("print", "<u8"), ("row", "<u4"), ("begin", "<u8"), ("length", "<u8"), ("starts", "u1"))

    def __init__(self, **arrays):
        """number counts identifiers from 1; 0 is a place without one."""
        self.__dict__.update(arrays)

    def pack(self) -> bytes:
        raw = [np.ascontiguousarray(getattr(self, name).astype(kind)).tobytes() for name, kind in self.SHAPES]
        width = 3 if int(self.number.max(initial=0)) < 1 << 24 else 4
        raw.append(bytes([width]) + K.planes(self.number.astype(np.uint64), width))
        return struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw)

    @classmethod
    def unpack(cls, blob: bytes) -> State:
        n = len(cls.SHAPES) + 1
        sizes, at, out = struct.unpack_from(f"<{n}Q", blob), 8 * n, {}
        for (name, kind), size in zip(cls.SHAPES, sizes[:-1], strict=True):
            out[name] = np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at)
            at += size
        return cls(**out, number=K.unplanes(blob[at + 1 :], blob[at]).astype(np.int64))

    def mask(self) -> np.ndarray:
        return np.unpackbits(self.starts, count=int(self.length.sum())).astype(bool)

    def docs(self) -> np.ndarray:
        """Document of every place."""
        return np.repeat(self.doc[self.row], self.length.astype(np.int64))


def _posted(part_keys, flush, first, second, docs, last):
    """Posting rows of distinct keys (first, second) and the number of each place among them.

    A posting says whether two documents of the batch hold the key; in the last round, the smallest that does.
    """
    n = len(part_keys)
    if second is None:
        bits = key_bits(n)
        first = ((first >> K.U64(32)) * K.U64(n) >> K.U64(32) << K.U64(bits)) | (first & K.U64((1 << bits) - 1))
    order = np.argsort(first) if second is None else np.lexsort((second, first))
    f, d = first[order], docs[order]
    s = None if second is None else second[order]
    head = np.ones(len(order), bool)
    head[1:] = f[1:] != f[:-1]
    if s is not None:
        head[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(head)
    low = np.minimum.reduceat(d, at) if len(at) else d
    several = low != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    part = (f[at] >> K.U64(bits)).astype(np.int64) if s is None else _deal_by_id(K.mix(K.mix(f[at]) ^ s[at]), n)
    by = np.argsort(part, kind="stable")  # numbers go by part, and by key within
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(1, len(by) + 1)
    number = np.empty(len(order), np.int64)
    number[order] = place[np.cumsum(head) - 1]
    rows, cut_at = [], np.searchsorted(part[by], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cut_at)):
        i = by[cut_at[k] : cut_at[k + 1]]
        own = f[at[i]] & K.U64((1 << bits) - 1) if s is None else f[at[i]]
        a = K.planes(np.diff(own, prepend=K.U64(0)), 6 if s is None else 8)
        b = None if s is None else K.planes(s[at[i]], 8)
        if last:
            ids, index = np.unique(low[i], return_inverse=True)
            c = struct.pack("<I", len(ids)) + ids.tobytes() + index.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32).tobytes()
        else:
            c = np.packbits(several[i]).tobytes()
        rows.append((int(part_keys[k]), POSTING, flush, int(k), a, b, c))
    return rows, number


def key_bits(n: int) -> int:
    """Bits of a gram's hash beside its partition, of n."""
    return min(48, 64 - n.bit_length())


def _smallest(c: bytes, n: int) -> np.ndarray:
    """Documents of the n postings of a last round."""
    (k,) = struct.unpack_from("<I", c)
    ids = np.frombuffer(c, np.int64, k, 4)
    return ids[np.frombuffer(c, np.uint16 if len(c) == 4 + 8 * k + 2 * n else np.uint32, n, 4 + 8 * k)]


def _round_batch(rows):
    c = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], [x.split()[0] for x in ROUND.split(", ")])


def _bounded(rows):
    """Rows in lists of about BATCH_BYTES of columns, 500 rows at most; a longer row has a list of its own."""
    held, size = [], 0
    for row in rows:
        own = sum(len(x) for x in row if isinstance(x, bytes))
        if held and (size + own > BATCH_BYTES or len(held) == 500):
            yield held
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield held


def _batches(rows):
    return map(_batch, _bounded(rows))


def _round_batches(rows):
    return map(_round_batch, _bounded(rows))


def _span_rows(part_keys, doc, print_, row, begin, end):
    """Spans of bytes that go, by document."""
    if not len(row):
        return []
    order = np.argsort(row, kind="stable")
    row, begin, end = row[order], begin[order], end[order]
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    home = _home(doc[row[at]], len(part_keys))
    out = []
    for k, (a, b) in enumerate(zip(at, np.r_[at[1:], len(row)], strict=True)):
        name = struct.pack("<qQ", int(doc[row[a]]), int(print_[row[a]]))
        out.append((int(part_keys[home[k]]), SPAN, 0, 0, name, begin[a:b].astype("<u8").tobytes(), end[a:b].astype("<u8").tobytes()))
    return out


def _prints(data, offsets):
    return np.array([xxhash.xxh3_64_intdigest(data[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def _open_starts(part_keys, width, q, gram, first=0):
    """Documents meet the answers: spans of decided units, and the open starts' state and first postings.

    Batches are numbered from first on, which tells those of several runs apart.
    """
    steps = depths(width, gram)

    def run(batches):
        flush = (first + TaskContext.get().partitionId()) << 32
        held = {"doc": [], "print": [], "row": [], "begin": [], "length": [], "starts": [], "hash": []}
        rows_held = places = 0

        def emit():
            nonlocal rows_held, places, flush
            join = lambda name, kind: np.concatenate([np.zeros(0, kind), *held[name]])
            mask = join("starts", bool)
            state = State(doc=join("doc", np.int64), print=join("print", np.uint64), row=join("row", np.int64), begin=join("begin", np.int64), length=join("length", np.int64), starts=np.packbits(mask), number=None)
            need = needed(mask, steps)[0]
            rows, state.number = _posted(part_keys, flush, join("hash", np.uint64)[need], None, state.docs()[need], len(steps) == 1)
            rows.append((int(part_keys[flush % len(part_keys)]), STATE, flush, 0, state.pack(), None, None))
            yield from _round_batches(rows)
            flush += 1
            for x in held.values():
                x.clear()
            rows_held = places = 0

        def each(said, batch):
            nonlocal rows_held, places
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in K.chunks(batch, "text"):
                own = ids[a:b]
                of, begin, end, g, extent, sums = units(data, offsets, width, q)
                name = _answer(_unit_key(g & K.U64(0xFFFFFFFF), extent >> K.U64(16)), own[of])
                decided = _among(name, said[DECIDED])
                ask = ~decided & _among(name, said[OPEN])
                if not (decided.any() or ask.any()):
                    continue
                prints = _prints(data, offsets)
                if decided.any():
                    gone = _cover(_ranges(begin[decided], (end - begin)[decided]), len(data), width)
                    low, high = K.runs(gone, offsets)
                    row = np.searchsorted(offsets, low, "right") - 1
                    yield from _round_batches(_span_rows(part_keys, own, prints, row, low - offsets[row], high - offsets[row]))
                if ask.any():
                    starts = np.zeros(len(data), bool)
                    starts[_ranges(begin[ask], (end - begin)[ask])] = True
                    low, high = K.runs(_cover(np.flatnonzero(starts), len(data), width), offsets)
                    size = high - low
                    row = np.searchsorted(offsets, low, "right") - 1
                    at = _ranges(low, size)
                    stop = np.minimum(at + steps[0], len(data))
                    held["doc"].append(own)
                    held["print"].append(prints)
                    held["row"].append(row + rows_held)
                    held["begin"].append(low - offsets[row])
                    held["length"].append(size)
                    held["starts"].append(starts[at])
                    held["hash"].append(K.span_hash(sums, at, stop))
                    rows_held += len(own)
                    places += len(at)
                    if places >= FLUSH_PLACES:
                        yield from emit()

        yield from _meet(_names, each)(batches)
        if places:
            yield from emit()

    return run


def _buckets(part_keys, last):
    """Sort the postings of a part into buckets: rank of each shared one, or whether a smaller document has it, to those who posted."""
    place_of = {int(k): i for i, k in enumerate(part_keys)}

    def run(batches):
        first, second, third, source, rows = [], [], [], [], []
        for batch in batches:
            for part, _, flush, sub, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b is None:  # the partition completes the key
                    k = np.cumsum(K.unplanes(a, 6), dtype=np.uint64) | (K.U64(place_of[part]) << K.U64(key_bits(len(part_keys))))
                else:
                    k = np.cumsum(K.unplanes(a, 8), dtype=np.uint64)
                first.append(k)
                second.append(np.zeros(len(k), np.uint64) if b is None else K.unplanes(b, 8))
                third.append(_smallest(c, len(k)) if last else np.unpackbits(np.frombuffer(c, np.uint8), count=len(k)))
                source.append(len(k))
                rows.append((flush, sub, part))
        if not rows:
            return
        # a part's postings are the most that a task holds: each array goes once the next is made of it
        one = np.concatenate(first)
        first.clear()
        two = np.concatenate(second)
        second.clear()
        order = np.lexsort((two, one))
        head = np.ones(len(order), bool)
        one = one[order]
        head[1:] = one[1:] != one[:-1]
        del one
        two = two[order]
        head[1:] |= two[1:] != two[:-1]
        del two
        own = np.concatenate(third)
        third.clear()
        own = own[order]
        bucket, at = np.cumsum(head) - 1, np.flatnonzero(head)
        del head
        if last:
            said = np.minimum.reduceat(own, at)[bucket] < own
        else:
            # a bucket that several batches hold, or two documents of one
            shared = (np.bincount(bucket) > 1) | (np.maximum.reduceat(own, at) > 0)
            said = np.where(shared, np.cumsum(shared), 0)[bucket]
        del own, bucket
        back = np.empty(len(order), said.dtype)
        back[order] = said
        del order, said

        def answers():
            begin = 0
            for (flush, sub, part), size in zip(rows, source, strict=True):
                x = back[begin : begin + size]
                begin += size
                if last:
                    a = np.packbits(x).tobytes()
                else:  # the rank of a part, and the part
                    a = K.planes(np.where(x > 0, x.astype(np.uint64) | (K.U64(place_of[part]) << K.U64(RANK_BITS)), K.U64(0)), 8)
                yield int(part_keys[flush % len(part_keys)]), ANSWER, flush, sub, a, struct.pack("<Q", size), None

        yield from _round_batches(answers())

    return run


def _advance(part_keys, width, gram, k):
    """States meet the answers of round k: the next round's postings, or after the last the spans that go."""
    steps = depths(width, gram)
    last = k == len(steps) - 1

    def close(flush, state, answers):
        if state is None:
            return
        mask = state.mask()
        need = needed(mask, steps)
        if last:
            bits = [np.unpackbits(np.frombuffer(a, np.uint8), count=struct.unpack("<Q", b)[0]) for a, b in answers]
            smaller = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
            docs = state.docs()[mask]
            live = state.number > 0
            number = state.number - 1
            # within the batch the smallest document of a bucket is known here
            low = np.full(len(smaller), np.iinfo(np.int64).max)
            np.minimum.at(low, number[live], docs[live])
            gone_start = np.zeros(len(docs), bool)
            gone_start[live] = smaller[number[live]] | (docs[live] > low[number[live]])
            marks = np.zeros(len(mask), bool)
            marks[np.flatnonzero(mask)[gone_start]] = True
            size = state.length.astype(np.int64)
            edge = np.r_[0, np.cumsum(size)]
            gone = _cover(np.flatnonzero(marks), len(mask), width)
            begin, end = K.runs(gone, edge)
            region = np.searchsorted(edge, begin, "right") - 1
            shift = state.begin.astype(np.int64)[region] - edge[region]
            yield from _round_batches(_span_rows(part_keys, state.doc, state.print, state.row[region], begin + shift, end + shift))
            return
        ids = np.concatenate([np.zeros(0, np.uint64), *(K.unplanes(a, 8) for a, _ in answers)])
        here = np.zeros(len(mask), np.uint64)
        places = np.flatnonzero(need[k])
        live = state.number > 0
        here[places[live]] = ids[state.number[live] - 1]
        offset = steps[k + 1] - steps[k]
        ahead = np.zeros(len(mask), np.uint64)
        ahead[: len(mask) - offset] = here[offset:]
        ask = need[k + 1]
        one, two = here[ask], ahead[ask]
        both = (one > 0) & (two > 0)  # without an identifier on either side, no other document can have it
        rows, own = _posted(part_keys, flush, one[both], two[both], state.docs()[ask][both], k + 1 == len(steps) - 1)
        number = np.zeros(len(one), np.int64)
        number[both] = own
        rows.append((int(part_keys[flush % len(part_keys)]), STATE, flush, 0, State(**(state.__dict__ | {"number": number})).pack(), None, None))
        yield from _round_batches(rows)

    def run(batches):
        flush, state, answers = None, None, []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[1] == SPAN:
                    yield _round_batch([row])
                    continue
                if row[2] != flush:
                    yield from close(flush, state, answers)
                    flush, state, answers = row[2], None, []
                if row[1] == STATE:
                    state = State.unpack(row[4])
                else:
                    answers.append((row[4], row[5]))
        yield from close(flush, state, answers)

    return run


def _cover(starts, n, width):
    """Bytes covered by the width-byte strings at the starts (within their texts)."""
    step = np.bincount(starts, minlength=n + width + 1) - np.bincount(starts + width, minlength=n + width + 1)
    return np.cumsum(step[:n]) > 0


def _spans_by_name(found):
    """Spans of every document, by its identifier and its text's print."""
    out: dict[tuple, list] = {}
    for batch in found.get(SPAN, []):
        for name, begin, end in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "c")), strict=True):
            out.setdefault(struct.unpack("<qQ", name), []).append((np.frombuffer(begin, "<u8"), np.frombuffer(end, "<u8")))
    return out, {doc for doc, _ in out}


def _remove(keep_text):
    """Documents meet their spans and lose their bytes."""

    def run(batches):
        def each(learned, batch):
            said, asked = learned
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b, data, offsets in K.chunks(batch, "text"):
                own = ids.slice(a, b - a).to_pylist()
                gone = np.zeros(len(data) + 1, np.int64)
                for i, doc in enumerate(own):
                    if doc in asked:
                        piece = data[offsets[i] : offsets[i + 1]]
                        for begin, end in said.get((doc, xxhash.xxh3_64_intdigest(piece.data)), ()):
                            np.add.at(gone, begin.astype(np.int64) + offsets[i], 1)
                            np.add.at(gone, end.astype(np.int64) + offsets[i], -1)
                out = _finish(own, texts.slice(a, b - a).to_pylist() if keep_text else [0] * (b - a), data, offsets, np.cumsum(gone[:-1]) > 0, keep_text)
                yield pa.RecordBatch.from_arrays([*out, batch.column(batch.schema.get_field_index("carry")).slice(a, b - a)], [*OUT, "carry"])

        yield from _meet(_spans_by_name, each)(batches)

    return run


def suffix_dedup(docs: DataFrame, width: int = WIDTH, q: int = QGRAM, keep_text: bool = False, carry: Column | None = None, tables: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text and carry) of every row."""
    spark = session_of(docs)
    tables = tables or Scratch(spark)
    keys = targets(spark, partitions(spark))
    n = len(keys)
    carry = F.lit(None).cast("string") if carry is None else carry
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carry.alias("carry"))
    kind_of = docs.schema["carry"].dataType
    held = docs.where("doc_id is not null")
    sample = min(SAMPLE, width)
    posted = map_arrow(held.select("doc_id", "text"), _post_units(keys, width, sample), ROW)
    said = map_arrow(posted.repartition(n, "part"), _judge_units(keys), ROW)
    home = target_column(keys, home_of(F.col("doc_id"), n))
    at = F.pmod(F.hash("part"), F.lit(n))  # parts hash to 0 .. n - 1

    def dealt(rows: DataFrame, k: int) -> DataFrame:
        """Rows of one of k slices of the parts (those whose place is its number modulo k), a task for each of its parts."""
        return rows.repartitionById(-(-n // k), F.floor(at / k).cast("int"))

    def met(answers: DataFrame, *carried: str, where: tuple[int, int] = (0, 1)) -> DataFrame:
        """Answers and then the documents of every part, or of one (j, k) of k slices of the parts."""
        own = [c for c in answers.columns if c not in ("part", "kind")]
        kinds = dict(answers.dtypes)
        answers = answers.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *(F.lit(None).cast(kind_of).alias(c) for c in carried))
        texts = held.select(home.alias("part"), F.lit(9).alias("kind"), *(F.lit(None).cast(kinds[c]).alias(c) for c in own), "doc_id", "text", *carried)
        j, k = where
        return dealt(answers.unionByName(texts).where(F.pmod(at, F.lit(k)) == j), k).sortWithinPartitions("part", "kind")

    said = tables.written(said, "suffix-dedup-units")
    # what is on disk at once: the slices to come, what those done have left, and the shuffle of one
    slices = slices_of(n, tables.size(said))
    own = F.pmod(at, F.lit(slices))
    number = F.when(F.col("kind") == POSTING, own).otherwise(slices + own)
    now = Sliced(tables, "suffix-dedup-round", ROUND)
    texts = min(TEXT_SLICES, slices)
    for j in range(texts):
        now.add(map_arrow(met(said, where=(j, texts)), _open_starts(keys, width, sample, q, j * n), ROUND), number)
    tables.drop(said)
    for k in range(len(depths(width, q))):
        answers, after = (Sliced(tables, f"suffix-dedup-{name}", ROUND) for name in ("answers", "round"))
        for j in range(slices):
            answers.add(map_arrow(dealt(now.read(j), slices), _buckets(keys, k == len(depths(width, q)) - 1), ROUND), own)
            now.drop(j)
        for j in range(slices):
            both = dealt(now.read(slices + j).unionByName(answers.read(j)), slices).sortWithinPartitions("flush", "kind", "sub")
            after.add(map_arrow(both, _advance(keys, width, q, k), ROUND), number)
            now.drop(slices + j)
            answers.drop(j)
        tables.drop(now, answers)
        now = after
    now = now.read(*range(slices, 2 * slices))
    out = map_arrow(met(now, "carry"), _remove(keep_text), T.StructType([*T._parse_datatype_string(OUT_TYPES).fields, T.StructField("carry", kind_of)]))
    lone = docs.where("doc_id is null")
    size, text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.coalesce("text", F.lit(""))
    out = out.unionByName(lone.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("kept_text"), "carry"))
    return out if keep_text else out.drop("kept_text", "carry")
