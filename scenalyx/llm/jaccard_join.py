"""N-gram Jaccard join: exact similarity links between documents, as components.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two
documents link when ``den * |A & B| >= num * |A | B|`` (0.85 as 85 / 100).

Plan
1. Frequencies. Every shingle of every set is counted, as packed postings
   (key, place in the task's batch). Of each set come back: its keys that two to
   ``frequent`` sets hold, with their counts, and how many it has of more. A key
   that one batch alone finds frequent is posted once by it, so the copies of a
   common passage never meet in one task.
2. Prefixes. A linking pair shares one of the first ``s - ceil(num * s / den) + 1``
   shingles of each set, whatever the order of shingles. Here: those of one set
   only, then rare ones by count, then the rest by hash. Most sets have enough
   shingles of their own and are done; texts of the others move once.
3. Size-banded tiles: tile j holds the sizes that can meet a smaller set of band
   j. Prefix shingles are posted per tile; sets joined by postings form candidate
   groups (connected components). Within (group, tile) every pair not yet
   connected is bounded from above by popcounts of hashed bitmaps, and what
   passes is intersected exactly, as sorted arrays.
   A tile of a group with more than ``group_limit`` sets or ``group_bytes`` is
   dealt over several cells. What these have not joined yet meets in a second pass:
   the tile's largest class, and the sets outside it, each in blocks, with a cell for
   every two blocks but those of the largest class; a cell compares across its two
   blocks only, so each pair of sets is looked at once, and sets outside the largest
   class are what is copied.

Equal sets count as one, the smallest doc_id. Links inside a class that is already
connected are not needed for components, so copies are never expanded into pairs.
Intermediate tables go as soon as their successors stand.

Defined cases: null or blank text has the empty set and links with nothing; a
text of fewer than n words is one shingle; equal doc_ids are one document whose
rows are judged apart and share a component; a null doc_id has no links and a
null component; other columns are ignored; no rows give no rows. Sets are told
apart by two 64-bit sums and their size; texts have no largest size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .spark import Scratch, components, cut, map_arrow, partitions, session_of, targets

FLUSH_BYTES, FLUSH_DOCS = 8 << 20, 60_000
KEY_BITS = 40
FREQUENT = 16
ROW = "part int, kind int, flush long, a binary, b binary, c binary"
DIRECTORY, POSTED, FOUND_RARE, FOUND_FREQUENT, COMMON = 0, 1, 2, 3, 4


def band_starts(most: int, num: int, den: int) -> np.ndarray:
    """Smallest sizes of the bands up to the one that holds ``most``."""
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, low[-1] * den // num))
    return np.array(low, np.int64)


def tiles_of(size: np.ndarray, num: int, den: int):
    """(set, tile) for every tile of each set: its own band, and those of smaller sets that it can still meet."""
    low = band_starts(int(size.max(initial=1)), num, den)
    band = np.searchsorted(low, size, "right") - 1
    who, tile = [], []
    live = np.flatnonzero(size > 0)
    for back in range(3):
        t = band[live] - back
        live, t = live[t >= 0], t[t >= 0]
        fits = size[live] <= (low[t + 1] - 1) * den // num
        live, t = live[fits], t[fits]
        who.append(live)
        tile.append(t)
    return np.concatenate(who), np.concatenate(tile)


def prefix_length(size, num: int, den: int):
    return size + num * size // -den + 1


def _sets(data, offsets, n):
    word, first, _, _ = K.words(data, offsets)
    h, of = K.shingles(word, first, n)
    return K.distinct_by_doc(h, of, len(offsets) - 1)


def _prints(h, at):
    return K.segment_sum(K.mix(h), at), K.segment_sum(K.mix(h ^ K.U64(0x5851F42D4C957F2D)), at)


def _keys(h, n):
    """Key of each shingle: the partition that counts it, and KEY_BITS of its hash, in one number that sorts by both."""
    x = K.mix(h + K.U64(0x632BE59BD9B4E019))
    return ((x >> K.U64(32)) * K.U64(n) >> K.U64(32) << K.U64(KEY_BITS)) | (x & K.U64((1 << KEY_BITS) - 1))


def _home(flush, n):
    return int(K.mix(np.array([flush], np.int64).view(np.uint64))[0] % K.U64(n))


def _batch(rows):
    c = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["part", "kind", "flush", "a", "b", "c"])


def _heads(keys):
    """First places of the runs of equal sorted keys, and their lengths."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


#: What a batch tells of each of its documents.
ENTRY = np.dtype([("doc", "<i8"), ("size", "<i8"), ("h1", "<u8"), ("h2", "<u8"), ("text", "<i8"), ("common", "<i4"), ("named", "?"), ("posts", "?")])


def _post(n: int, part_keys: np.ndarray, frequent: int):
    """Postings of every set, and a directory of each batch."""
    parts = len(part_keys)

    def emit(flush, entries, keys, own):
        entry, key, own = np.concatenate(entries), np.concatenate(keys), np.concatenate(own)
        order = np.argsort(key)
        key, own = key[order], own[order]
        first, count = _heads(key)
        many = np.repeat(count > frequent, count)
        entry["common"] = np.bincount(own[many], minlength=len(entry))
        rows = [(int(part_keys[_home(flush, parts)]), DIRECTORY, flush, entry.tobytes(), None, None)]
        for kind, k, o in ((POSTED, key[~many], own[~many].astype(np.uint16)), (COMMON, key[first[count > frequent]], None)):
            cut_at = np.searchsorted(k, np.arange(parts + 1, dtype=np.uint64) << K.U64(KEY_BITS))
            for p in np.flatnonzero(np.diff(cut_at)):
                s = slice(cut_at[p], cut_at[p + 1])
                low = k[s] & K.U64((1 << KEY_BITS) - 1)
                rows.append((int(part_keys[p]), kind, flush, K.planes(np.diff(low, prepend=K.U64(0)), KEY_BITS // 8), None if o is None else o[s].tobytes(), None))
        for r in range(0, len(rows), 500):
            yield _batch(rows[r : r + 500])

    def run(batches):
        flush = TaskContext.get().partitionId() << 32
        entries, keys, own, held, docs = [], [], [], 0, 0
        seen: dict[tuple, None] = {}
        for batch in batches:
            ids = batch.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch, "text"):
                h, doc, at = _sets(data, offsets, n)
                entry = np.zeros(b - a, ENTRY)
                entry["text"] = texts[a:b]
                entry["doc"], entry["size"], entry["named"] = ids[a:b], np.diff(at), named[a:b]
                entry["h1"], entry["h2"] = _prints(h, at)
                for i in np.flatnonzero(entry["named"] & (entry["size"] > 0)).tolist():
                    print_ = (int(entry["h1"][i]), int(entry["h2"][i]))
                    entry["posts"][i] = print_ not in seen  # an equal set of this task posts once
                    seen[print_] = None
                if len(seen) > 200_000:
                    seen.clear()
                mine = entry["posts"][doc]
                entries.append(entry)
                keys.append(_keys(h[mine], parts))
                own.append(doc[mine] + docs)
                docs += b - a
                held += len(data)
                if held >= FLUSH_BYTES or docs >= FLUSH_DOCS:
                    yield from emit(flush, entries, keys, own)
                    flush += 1
                    entries, keys, own, held, docs = [], [], [], 0, 0
        if entries:
            yield from emit(flush, entries, keys, own)

    return run


def _count(part_keys: np.ndarray, frequent: int):
    """Tell each batch which of its postings are rare but shared, and which are frequent."""
    parts, place_of = len(part_keys), {int(k): i for i, k in enumerate(part_keys)}

    def run(batches):
        keys, own, source, flushes, common = [], [], [], [], []
        for batch in batches:
            for p, kind, flush, a, b, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == DIRECTORY:
                    yield _batch([(p, kind, flush, a, None, None)])
                    continue
                # one Spark partition may hold several parts: the part's place completes the key
                k = np.cumsum(K.unplanes(a, KEY_BITS // 8), dtype=np.uint64) + (K.U64(place_of[p]) << K.U64(KEY_BITS))
                if kind == COMMON:
                    common.append(k)
                    continue
                keys.append(k)
                own.append(np.frombuffer(b, np.uint16))
                source.append(np.full(len(k), len(flushes), np.int32))
                flushes.append(flush)
        if not keys:
            return
        key, own, source = np.concatenate(keys), np.concatenate(own), np.concatenate(source)
        del keys
        order = np.argsort(key)
        key = key[order]
        first, count = _heads(key)
        if common:
            count_all = count + (frequent + 1) * np.isin(key[first], np.unique(np.concatenate(common)))
        else:
            count_all = count
        total = np.repeat(count_all, count)
        shared = total > 1
        order, key, total = order[shared], key[shared], total[shared]
        own, source = own[order], source[order]
        by = np.argsort(source, kind="stable")
        cut_at = np.searchsorted(source[by], np.arange(len(flushes) + 1))
        rows = []
        for f in np.flatnonzero(np.diff(cut_at)):
            i = by[cut_at[f] : cut_at[f + 1]]
            home = int(part_keys[_home(flushes[f], parts)])
            rare = total[i] <= frequent
            r = i[rare]
            if len(r):
                rows.append((home, FOUND_RARE, flushes[f], K.planes(np.diff(key[r], prepend=K.U64(0)), 8), own[r].tobytes(), total[r].astype(np.uint8).tobytes()))
            if not rare.all():
                rows.append((home, FOUND_FREQUENT, flushes[f], None, own[i[~rare]].tobytes(), None))
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


SETS = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, singles long, rare binary, counts binary"


def _judge(num: int, den: int):
    """One row per document; rare keys and their counts for those that have too few shingles of their own."""

    def close(entry, rare, frequent):
        size = entry["size"]
        many = entry["common"].astype(np.int64)
        for own in frequent:
            many += np.bincount(own, minlength=len(entry))
        key, own, count = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8))
        singles = size - many - np.bincount(own, minlength=len(entry))
        asks = entry["posts"] & (singles < prefix_length(size, num, den))
        mine = asks[own]
        key, own, count = key[mine], own[mine], count[mine]
        order = np.argsort(own, kind="stable")
        key, count = key[order], count[order]
        at = np.searchsorted(own[order], np.arange(len(entry) + 1))
        blob = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() if asks[i] else None for i in range(len(entry))], pa.binary())
        signed = lambda name: pa.array(np.ascontiguousarray(entry[name]).view(np.int64))
        doc = pa.array(np.ascontiguousarray(entry["doc"]), mask=~entry["named"])
        yield pa.RecordBatch.from_arrays([doc, signed("text"), signed("size"), signed("h1"), signed("h2"), pa.array(singles), blob(key), blob(count)], [x.split()[0] for x in SETS.split(", ")])

    def run(batches):
        entry, rare, frequent = None, [], []
        for batch in batches:
            for _, kind, _, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == DIRECTORY:
                    if entry is not None:
                        yield from close(entry, rare, frequent)
                    entry, rare, frequent = np.frombuffer(a, ENTRY), [], []
                elif kind == FOUND_RARE:
                    rare.append((np.cumsum(K.unplanes(a, 8), dtype=np.uint64), np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint8)))
                else:
                    frequent.append(np.frombuffer(b, np.uint16))
        if entry is not None:
            yield from close(entry, rare, frequent)

    return run


def _prefixes(n: int, num: int, den: int, parts: int):
    """Sets that ask for partners, and the keys that they post: (doc_id, size, items, posts)."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            ids = col("doc_id").to_pylist()
            want = [col(name).to_numpy(zero_copy_only=False) for name in ("h1", "h2", "n_shingles", "singles")]
            for a, b, data, offsets in K.chunks(batch, "text"):
                h, _, at = _sets(data, offsets, n)
                size = np.diff(at)
                one, two = _prints(h, at)
                h1, h2, many, singles = (x[a:b] for x in want)
                same = (one.view(np.int64) == h1) & (two.view(np.int64) == h2) & (size == many)
                rare, counts = (col(name).slice(a, b - a).to_pylist() for name in ("rare", "counts"))
                rows, posts = [], []
                for i in np.flatnonzero(same).tolist():
                    name = (ids[a + i], int(one[i]))
                    if name in seen:
                        continue
                    seen.add(name)
                    if len(seen) > 200_000:
                        seen.clear()
                    items = h[at[i] : at[i + 1]]
                    key = _keys(items, parts)
                    known, of = np.frombuffer(rare[i], np.uint64), np.frombuffer(counts[i], np.uint8)
                    order = np.argsort(known)
                    place = np.searchsorted(known[order], key)
                    place[place == len(known)] = 0
                    is_rare = known[order][place] == key if len(known) else np.zeros(len(key), bool)
                    count = np.where(is_rare, of[order][place], 255) if len(known) else np.full(len(key), 255)
                    length = int(prefix_length(size[i], num, den))
                    by = np.lexsort((items, key, count))
                    if singles[i] + is_rare.sum() >= length:  # its own shingles come first, and meet nobody
                        by = by[: length - max(int(singles[i]), 0)]
                    else:
                        by = by[:length]
                    rows.append((a + i, int(one.view(np.int64)[i]), int(size[i]), items.tobytes()))
                    posts.append(np.unique(key[by]).tobytes())
                if rows:
                    index, prints, sizes, items = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([col("doc_id").take(pa.array(index)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(items, pa.binary()), pa.array(posts, pa.binary())], ["doc_id", "h1", "size", "items", "posts"])

    return run


def _fold(key, doc):
    """Star of each key: sorted distinct keys with their smallest document, and the other documents' links to it."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    centre = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(key) else doc
    link = np.unique(np.stack([doc, centre], 1)[centre != doc], axis=0)
    return key[head], doc[head], link


def _forest(link: np.ndarray) -> np.ndarray:
    """Links (document, smallest document it reaches) that connect what the given links connect."""
    if not len(link):
        return link
    ids, at = np.unique(link, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        for x in (label[u], label[v], u, v):
            np.minimum.at(label, x, low)
        while (label[label] != label).any():
            label = label[label]
        if (label[u] == label[v]).all():
            break
    off = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[off], ids[label[off]]], 1)


def _candidates(num: int, den: int, part_keys: np.ndarray):
    """Prefix keys per tile, folded to the smallest document in each task, and the others' links to it."""
    parts = len(part_keys)

    def emit(keys, docs):
        key, doc, link = _fold(np.concatenate(keys), np.concatenate(docs))
        part = ((key >> K.U64(32)) * K.U64(parts) >> K.U64(32)).astype(np.int64)
        cut_at = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cut_at)):
            rows.append((int(part_keys[p]), key[cut_at[p] : cut_at[p + 1]].tobytes(), doc[cut_at[p] : cut_at[p + 1]].tobytes()))
        link = _forest(link)
        deal = (K.mix(link[:, 0].astype(np.int64).view(np.uint64)) % K.U64(parts)).astype(np.int64)
        for p in np.unique(deal):
            rows.append((int(part_keys[p]), None, link[deal == p].tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "keys", "ids"])

    def run(batches):
        keys, docs, held = [], [], 0
        for batch in batches:
            ids, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            posts = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            who, tile = tiles_of(size, num, den)
            if not len(who):
                continue
            keys.append(K.mix(np.concatenate([posts[i] for i in who]) ^ K.mix(np.repeat(tile.astype(np.uint64) + K.U64(1), [len(posts[i]) for i in who]))))
            docs.append(np.repeat(ids[who], [len(posts[i]) for i in who]))
            held += len(keys[-1])
            if held >= 1 << 20:
                yield from emit(keys, docs)
                keys, docs, held = [], [], 0
        if keys:
            yield from emit(keys, docs)

    return run


def _stars(batches):
    """Links that connect the documents of equal postings of one partition, one for a document at most."""
    keys, docs, links = [], [], []
    for batch in batches:
        for k, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
            ids = np.frombuffer(ids, np.int64)
            if k is None:
                links.append(ids.reshape(-1, 2))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                docs.append(ids)
    if keys:
        links.append(_fold(np.concatenate(keys), np.concatenate(docs))[2])
    if links:
        link = _forest(np.concatenate(links))
        for at in range(0, len(link), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(link[at : at + 50_000, 0]), pa.array(link[at : at + 50_000, 1])], ["a", "b"])


def _members(num: int, den: int):
    """(doc_id, grp, size, tile) for every tile of a set."""

    def run(batches):
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            who, tile = tiles_of(size, num, den)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(who)) for i in range(3)), pa.array(tile.astype(np.int32))], ["doc_id", "grp", "size", "tile"])

    return run


def tile_links(docs, sizes, sets, num, den, end, label=None, side=None):
    """Links that connect the similar sets of one tile: those a spanning forest needs.

    Sets of equal label are connected already; sets of one side (but side 0) are not compared.
    """
    order = np.lexsort((docs, sizes))
    label = np.arange(len(docs)) if label is None else np.unique(label, return_inverse=True)[1][order]
    side = np.zeros(len(docs), np.int64) if side is None else side[order]
    docs, sizes = docs[order], sizes[order]
    sets = [sets[i] for i in order]
    m, bits = len(docs), 256
    while bits < 2 * int(sizes[-1]):
        bits *= 2
    maps = np.zeros((m, bits // 64), np.uint64)
    for i, s in enumerate(sets):
        slot = K.mix(s) & K.U64(bits - 1)
        np.bitwise_or.at(maps[i], (slot >> K.U64(6)).astype(np.int64), K.U64(1) << (slot & K.U64(63)))
    kept = np.bitwise_count(maps).sum(1, dtype=np.int64)
    lost = sizes - kept  # shingles that share a bit with another of the set
    out = []
    for i in range(1, m):
        begin = int(np.searchsorted(sizes, -(-num * int(sizes[i]) // den)))
        # the other classes only, nearest in size first
        near = np.flatnonzero(label[begin:i] != label[i]) + begin
        near = near[(sizes[near] <= end - 1) & ((side[near] != side[i]) | (side[i] == 0))]
        if not len(near):
            continue
        bound = np.minimum(np.bitwise_count(maps[near] & maps[i]).sum(1, dtype=np.int64) + np.minimum(lost[near], lost[i]), sizes[near])
        near = near[den * bound >= num * (sizes[near] + sizes[i] - bound)][::-1]
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (int(sizes[i]) + int(sizes[j]) - both):
                out.append((int(docs[i]), int(docs[j])))
                label[label == label[i]] = label[j]
    return out


def _links(num: int, den: int):
    """Links of every cell (grp, tile, cell) of rows (..., doc_id, size, items, component, side)."""

    def run(batches):
        key, rows = None, []

        def close():
            if len(rows) < 2:
                return
            docs, sizes, items, label, side = zip(*rows, strict=True)
            end = band_starts(max(sizes), num, den)[key[1] + 1]
            sets = [np.frombuffer(x, np.uint64) for x in items]
            found = tile_links(np.array(docs), np.array(sizes), sets, num, den, int(end), np.array(label), np.array(side))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for grp, tile, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, tile, cell) != key:
                    yield from close()
                    key, rows = (grp, tile, cell), []
                rows.append(row)
        yield from close()

    return run


def joined(known: DataFrame, links: DataFrame, tables: Scratch) -> DataFrame:
    """(node, component) of known classes after further links: only the classes' smallest nodes are linked anew."""
    for end in ("a", "b"):
        own = known.select(F.col("node").alias(end), "component")
        links = links.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    more = components(links, tables)
    moved = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(more.join(known.select("node"), "node", "left_anti"))


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, group_limit: int = 1024, group_bytes: int = 32 << 20, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text, ...)."""
    spark = session_of(docs)
    tables = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    keys = targets(spark, partitions(spark))
    parts = len(keys)
    posted = map_arrow(docs, _post(n, keys, frequent), ROW)
    counted = map_arrow(posted.repartition(parts, "part"), _count(keys, frequent), ROW)
    told = counted.repartition(parts, "part").sortWithinPartitions("flush", "kind")
    info = tables.written(map_arrow(told, _judge(num, den), SETS), "jaccard-sets")

    known = info.where("doc_id is not null and n_shingles > 0")
    prints = ["h1", "h2", "n_shingles"]
    # a set is told by one of its rows: other texts under the same doc_id are other sets, and stay away from the join
    first = F.min(F.struct("doc_id", "text_hash"))
    reps = tables.written(known.groupBy(*prints).agg(first["doc_id"].alias("rep"), first["text_hash"].alias("rep_text"), F.max_by(F.struct("singles", "rare", "counts"), F.col("rare").isNotNull()).alias("ask")), "jaccard-reps")
    few = max(1, parts // 8)
    # one document of several sets joins their classes
    split = known.join(reps.select(*prints, "rep"), prints).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    split = known.join(reps.select(*prints, "rep"), prints).join(split, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    split = tables.written(split.distinct().coalesce(few), "jaccard-split")

    asks = reps.where("ask.rare is not null").select(F.col("rep").alias("doc_id"), F.col("rep_text").alias("text_hash"), *prints, "ask.*")
    sets = map_arrow(docs.join(asks, ["doc_id", "text_hash"]), _prefixes(n, num, den, parts), "doc_id long, h1 long, size long, items binary, posts binary")
    sets = tables.written(sets.dropDuplicates(["doc_id", "h1"]), "jaccard-asking")  # rows may repeat
    found = map_arrow(sets.select("doc_id", "size", "posts"), _candidates(num, den, keys), "part int, keys binary, ids binary")
    stars = map_arrow(found.repartition(parts, "part"), _stars, "a long, b long")
    candidates = tables.written(components(stars, tables), "jaccard-groups")
    members = sets.select("doc_id", "size").join(candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    members = map_arrow(members.select("doc_id", "grp", "size"), _members(num, den), "doc_id long, grp long, size long, tile int").groupBy("doc_id", "grp", "tile").agg(F.sum("size").alias("size"))
    members = tables.written(members.coalesce(few), "jaccard-members")
    counts = members.groupBy("grp", "tile").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("shingles")).where("sets > 1")
    salts = F.greatest(F.ceil(F.col("sets") / F.lit(group_limit)), F.ceil(F.col("shingles") * 8 / F.lit(group_bytes))).cast("int")
    dealt = tables.written(members.join(counts.withColumn("salts", salts), ["grp", "tile"]).coalesce(few), "jaccard-tiles")

    def links(placed: DataFrame) -> DataFrame:
        """Of (doc_id, grp, tile, component, places (cell, side)): links that the cells find."""
        rows = placed.withColumn("place", F.explode("places")).select("doc_id", "grp", "tile", "place.cell", "component", "place.side")
        rows = rows.join(sets.select("doc_id", "size", "items"), "doc_id").select("grp", "tile", "cell", "doc_id", "size", "items", "component", "side")
        cells = rows.repartition(parts, "grp", "tile", "cell").sortWithinPartitions("grp", "tile", "cell")
        return map_arrow(cells, _links(num, den), "a long, b long")

    def place(cell, side):
        return F.struct(cell.cast("long").alias("cell"), side.cast("int").alias("side"))

    block = lambda of: F.pmod(F.xxhash64("doc_id"), of)
    once = F.array(place(block(F.col("salts")), F.lit(0)))
    first = tables.written(links(dealt.select("doc_id", "grp", "tile", F.col("doc_id").alias("component"), once.alias("places"))), "jaccard-links")
    final = tables.written(components(first.unionByName(split), tables), "jaccard-classes")
    large = dealt.where("salts > 1")
    if large.limit(1).count():
        label = final.withColumnRenamed("node", "doc_id")
        open_ = tables.written(large.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "jaccard-large")
        sizes = open_.groupBy("grp", "tile", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
        blocks = lambda n, size: F.greatest(F.ceil(n / group_limit), F.ceil(size * 8 / group_bytes), F.lit(1))
        most = sizes.groupBy("grp", "tile").agg(F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("main.n < n")
        most = most.select("grp", "tile", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("inner"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("outer"))
        open_ = open_.join(most, ["grp", "tile"])
        # cells: a block of the main class with one outside it, then two blocks outside it
        inner, outer = F.col("inner"), F.col("outer")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        of_main = F.transform(upto(outer), lambda j: place(block(inner) * outer + j, F.lit(1)))
        own = block(outer)
        with_main = F.transform(upto(inner), lambda i: place(i * outer + own, F.lit(2)))
        outside = F.transform(upto(outer), lambda k: place(inner * outer + F.least(own, k) * outer + F.greatest(own, k), F.when(k == own, 0).when(own < k, 1).otherwise(2)))
        places = F.when(F.col("component") == F.col("main"), of_main).otherwise(F.concat(with_main, outside))
        late = tables.written(links(open_.select("doc_id", "grp", "tile", "component", places.alias("places"))), "jaccard-late")
        final = joined(final, late, tables)
    classes = reps.select(*prints, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*prints, F.coalesce("component", "rep").alias("component"))
    by_doc = known.join(classes, prints).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = info.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    out = cut(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    tables.drop()
    return out
