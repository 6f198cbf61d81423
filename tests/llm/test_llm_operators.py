"""Each text operator against brute force on small, awkward tables."""

import bisect
import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenalyx.llm import bpe, url_filter
from scenalyx.llm import suffix_dedup as suffix_dedup_module
from scenalyx.llm.cotraining import document_scores, quality_scores
from scenalyx.llm.decontaminate import decontaminate
from scenalyx.llm.jaccard_join import jaccard_components
from scenalyx.llm.packing import pack, plan
from scenalyx.llm.quality_rules import quality_rules
from scenalyx.llm.sharding import MapStore, grow, initial, rebalance, shard
from scenalyx.llm.sst_output import MARK, Reader, Writer, id_of, key_of, lookup, open_shards, read_shards, sst_round_trip, write_shards
from scenalyx.llm.suffix_dedup import suffix_dedup
from scenalyx.llm.token_count import token_counts
from scenalyx.llm.url_filter import filter_urls

PATH = public_tokenizers.path("byte_bpe_50k.json")
BASE = " ".join(f"w{i % 37}x{i}" for i in range(120))
ROWS = [
    (1, BASE),
    (2, BASE.replace("w3x3 ", "changed ")),
    (3, BASE),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "short text"),
    (8, "short text"),
    (9, "SHORT Text"),
    (10, "é漢字 'quoted' it's  two  spaces\n\nlines\nlines\nlines <|endoftext|> tail"),
    (11, "a" * 3000),
    (12, "la la la la la la la la la la la la"),
    (13, "x" + "a" * 200 + " " + BASE[100:400]),
    (None, BASE),
    (3, BASE + " more"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, part int, words string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "k", 1, "w", 0) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text, pattern=r"[ \t-\r]+"):
    return [w for w in re.split(pattern, text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_jaccard(docs, empty):
    sets = []
    for i, t in ROWS:
        w = words(lower(t))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = collections.Counter((i, len(s), None if i is None else find(i)) for i, s in sets)
    for limit in (4096, 2):
        got = collections.Counter(tuple(r) for r in jaccard_components(docs, group_limit=limit).collect())
        assert got == want
    assert jaccard_components(empty).count() == 0


def brute_components(rows, n, num, den):
    """doc_id -> (set size, smallest doc_id reachable) by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("frequent", "limit"), [(16, 4096), (2, 4096), (1, 5)])
def test_jaccard_random_groups(spark, frequent, limit):
    """Near copies around the threshold, passages that many documents share, and chains of both."""
    rng = np.random.default_rng(frequent + limit)
    passages = [[f"p{k}q{i}" for i in range(40)] for k in range(3)]
    rows = []
    for g in range(25):
        base = [f"g{g}w{x}" for x in rng.integers(0, 60, rng.integers(3, 70))]
        for _ in range(rng.integers(1, 8)):
            t = [f"z{rng.integers(1000)}" if rng.random() < rng.choice([0, 0.01, 0.04]) else w for w in base]
            if rng.random() < 0.5:
                at = rng.integers(0, len(t) + 1)
                t = t[:at] + passages[rng.integers(3)] * int(rng.integers(1, 3)) + t[at:]
            rows.append((7 * len(rows) % 1009, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n, num, den, group_limit=limit, frequent=frequent).collect()}
        assert got == brute_components(rows, n, num, den)


@pytest.mark.parametrize("limit", [7, 1024])
def test_jaccard_large_group(spark, limit):
    """One group of near copies that a tile holds in many blocks: chains, and sets outside its largest class."""
    rng = np.random.default_rng(31)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(110):
        t = list(base)
        for k in rng.choice(80, int(rng.choice([0, 1, 2, 3, 5])), replace=False):
            t[k] = f"e{rng.integers(60)}"
        rows.append((i * 3, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group_limit=limit, frequent=3).collect()}
    want = brute_components(rows, 4, 85, 100)
    assert got == want and 5 < len({c for _, c in want.values()}) < 100


def test_jaccard_long_texts(spark):
    """A text beyond a chunk and one beyond a batch, near copies of both, and one word of megabytes."""
    long = " ".join(f"v{i * i % 100_003}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * (3 << 20)), (4, "x" * (3 << 20)), (5, " ".join(f"u{i}" for i in range(3_000_000)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (got[1][0], 1), 2: (got[1][0] + 1, 1), 3: (1, 3), 4: (1, 3), 5: (2_999_997, 5)}


def test_packing(docs, empty):
    lib = Tokenizer.from_file(PATH)
    rows = pack(docs, PATH, capacity=64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter()
    for i, t in ROWS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k in range(len(cuts) - 1):
            want[(i, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert pack(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_item_wise_best_fit(seed):
    """Planning over counts fills as best fit does that places one item after the other, longest first."""
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    lengths = rng.choice(np.arange(1, capacity + 1), int(rng.integers(1, min(capacity, 40) + 1)), replace=False)
    histogram = {int(n): int(c) for n, c in zip(lengths, rng.integers(0, 60, len(lengths)), strict=True)}
    runs = plan(histogram, capacity)
    got, seen = collections.defaultdict(list), collections.Counter()
    for n, low, high, first, each, offset in runs:
        assert low == seen[n]
        seen[n] = high
        for rank in range(low, high):
            got[first + (rank - low) // each].append((offset + (rank - low) % each * n, n))
    assert seen == collections.Counter({n: c for n, c in histogram.items() if c})
    for filling in got.values():  # no gaps, no overlaps
        at = 0
        for offset, n in sorted(filling):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(got) == list(range(len(got)))
    left = []  # (room, filling)
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(left, (n, ()))
        room, filling = left.pop(at) if at < len(left) else (capacity, ())
        bisect.insort(left, (room - n, (*filling, n)))
    want = collections.Counter(tuple(sorted(f)) for _, f in left)
    mine = collections.Counter(tuple(sorted(n for _, n in f)) for f in got.values())
    # rooms decide; which of several sequences of equal room takes an item is open
    assert collections.Counter(sum(f) for f in mine.elements()) == collections.Counter(sum(f) for f in want.elements())


def test_token_counts(docs, empty):
    lib = Tokenizer.from_file(PATH)
    want = collections.Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ROWS)
    assert collections.Counter(tuple(r) for r in token_counts(docs, PATH).collect()) == want
    assert token_counts(empty, PATH).count() == 0


@pytest.mark.parametrize("library", [False, True])
def test_bpe_fuzz(library):
    lib, own = Tokenizer.from_file(PATH), bpe.load(PATH, library)
    rng = np.random.default_rng(9)
    pool = [*"abst'rvmle  \n\t\r\x85\xa0é漢😀٣12!?.-", "'s", "'ll", "  ", "<|endoftext|>", " the", "aaa"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontaminate(spark, docs, empty, limit):
    item_rows = [(1, " ".join(words(BASE)[5:30])), (2, "Short text"), (3, None), (4, ".."), (5, "la la"), (6, " ".join(words(BASE)[20:31]))]
    items = spark.createDataFrame(item_rows, "item_id long, text string")
    tok = lambda s: words(lower(s), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = collections.defaultdict(set)
    for i, t in item_rows:
        w = tok(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if w else ():
            win[tuple(w[a : a + k])].add(str(i))
    want = collections.Counter()
    for d, t in ROWS:
        w = tok(t)
        hit, found = set(), set()
        for k in {len(x) for x in win}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in win:
                    hit |= set(range(a, a + k))
                    found |= win[tuple(w[a : a + k])]
        want[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    got = decontaminate(docs, items, broadcast_bytes=limit).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert all(sum(s.n for s in r.spans) == r.n_hit for r in got)
    assert decontaminate(empty, items, broadcast_bytes=limit).count() == 0
    assert {r.contaminated for r in decontaminate(docs, items.where("false"), broadcast_bytes=limit).collect()} == {False}


def brute_dedup(rows, width=50):
    """Counter of (doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            s = b[p : p + width]
            first[s] = min(first.get(s, i), i)
    want = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())] += 1
    return want


def test_suffix_dedup(docs, empty):
    assert collections.Counter(tuple(r) for r in suffix_dedup(docs).collect()) == brute_dedup(ROWS)
    assert suffix_dedup(empty).count() == 0


@pytest.mark.parametrize(("q", "width", "extents"), [(25, 50, 64), (13, 50, 1), (7, 50, 64), (50, 50, 64), (9, 31, 2)])
def test_suffix_dedup_random(spark, monkeypatch, q, width, extents):
    """Copies, passages in many documents, repeats within one, and identifiers in steps; all depths of refinement."""
    monkeypatch.setattr("scenalyx.llm.suffix_dedup.MANY_EXTENTS", extents)
    monkeypatch.setattr("scenalyx.llm.suffix_dedup.FLUSH_PLACES", 3000)
    rng = np.random.default_rng(q)
    text = lambda n, k: "".join(rng.choice([*"abcdeé ", "xy", "漢"][:k], n))
    passages = [text(rng.integers(30, 200), 9) for _ in range(6)]
    rows = []
    for _ in range(60):
        t = "".join(passages[rng.integers(6)][rng.integers(0, 20) :] if rng.random() < 0.5 else text(rng.integers(0, 120), int(rng.integers(1, 10))) for _ in range(rng.integers(0, 6)))
        rows.append((200 * int(rng.integers(0, 50)), t))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(tuple(r) for r in suffix_dedup(df, width, q).collect()) == brute_dedup(rows, width)


def test_suffix_dedup_slices(docs, spark, monkeypatch):
    """Slices are for what is worth slicing: few answers go through one, whatever the number of parts; the results are the same."""
    added, add = [], suffix_dedup_module.Sliced.add
    monkeypatch.setattr(suffix_dedup_module.Sliced, "add", lambda self, df, number: added.append(self) or add(self, df, number))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert collections.Counter(tuple(r) for r in suffix_dedup(docs).collect()) == brute_dedup(ROWS)
        assert len(added) == 5  # the texts once, and two rounds of buckets and states
        monkeypatch.setattr("scenalyx.llm.suffix_dedup.BYTES_A_SLICE", 1)
        monkeypatch.setattr("scenalyx.llm.suffix_dedup.PARTS_A_SLICE", 5)
        assert collections.Counter(tuple(r) for r in suffix_dedup(docs).collect()) == brute_dedup(ROWS)
        assert len(added) == 5 + 4 + 2 * 2 * 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_suffix_dedup_buckets_memory():
    """A part's postings are not held many times over, and its answers leave in small batches that name the shared keys as before."""
    keys, batches, n = np.arange(1, 4, dtype=np.int32), 40, 60_000
    rng = np.random.default_rng(3)
    first = np.unique(rng.integers(0, 1 << 40, 2 * n).astype(np.uint64))[:n]
    posted = []
    for flush in range(batches):
        own = first.copy()
        own[: n // 2] += np.uint64((flush + 1) << 41)  # half of the keys are this batch's alone
        rows, _ = suffix_dedup_module._posted(keys, flush, own, own, np.full(n, flush), False)
        posted += [r for r in rows if r[0] == 1]
    posted = list(suffix_dedup_module._round_batches(posted))
    held = sum(len(suffix_dedup_module.K.unplanes(a, 8)) for b in posted for a in b.column("a").to_pylist())
    assert held > 500_000
    tracemalloc.start()
    sizes, named = [], 0
    for batch in suffix_dedup_module._buckets(keys, False)(iter(posted)):
        sizes.append(batch.nbytes)
        named += sum(int((suffix_dedup_module.K.unplanes(a, 8) > 0).sum()) for a in batch.column("a").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) < 2 << 20
    assert peak < 75 * held
    assert 0.45 * held < named < 0.55 * held


def test_suffix_dedup_long_texts(spark):
    """A text of over 16 MiB and a short one share a passage; both go by one rule."""
    passage = "".join(f"{i * i % 99_991:05d} " for i in range(400))
    blank = " ".join(f"n{i * 7919 % 1_500_007:x}x{i}" for i in range(1_500_000))
    half = len(blank) // 2
    rows = [(4, blank[:half] + "|" + passage + "|" + blank[half:]), (2, "short " + passage + " end"), (6, blank[1000:9000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4][0] > 16 << 20
    assert got == {2: (len(rows[1][1]), 0, 0), 4: (len(rows[0][1]), len(passage), 1), 6: (8000, 8000, 1)}


def test_homes_are_the_jvms(spark):
    ids = [0, 1, -1, 200, 400, 2**63 - 1, -(2**63), 123456789012]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", suffix_dedup_module.home_of(F.col("doc_id"), 200).alias("home")).collect()
    assert {r.doc_id: r.home for r in rows} == dict(zip(ids, suffix_dedup_module._home(ids, 200).tolist(), strict=True))
    assert len(set(suffix_dedup_module._home(np.arange(0, 200 * 5000, 200), 200).tolist())) == 200


def test_sst(docs, empty):
    lib = Tokenizer.from_file(PATH)
    got = sorted(sst_round_trip(docs, PATH).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((i, crc(t)) for i, t in ROWS)
    assert sst_round_trip(empty, PATH).count() == 0


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_sst_lookup(id_bytes):
    writer, records = Writer(id_bytes), []
    for i in range(-5000, 5000, 3):
        raw = writer.add(key_of(i), np.arange(i % 50, dtype="<u4"))
        if raw is not None:
            records.append(raw)
    records += writer.finish()
    raw, asked = b"".join(r + b"m" * MARK for r in records), []

    def fetch(at, size):
        asked.append(size)
        return raw[at : at + size]

    reader = Reader(fetch, len(raw))
    assert reader.marker == "m" * MARK and [id_of(k) for k, _ in reader.entries()] == list(range(-5000, 5000, 3))
    assert len(reader.index) > 1 or id_bytes == 2
    reader, asked[:] = Reader(fetch, len(raw)), []
    assert reader.lookup(-5000 + 3 * 17).tolist() == list(range((-5000 + 51) % 50))
    assert len(asked) == 3  # filter, index and one block
    assert reader.lookup(-4999) is None and reader.lookup(99999) is None
    assert [id_of(key_of(i)) for i in (None, -(2**63), -1, 0, 2**63 - 1)] == [None, -(2**63), -1, 0, 2**63 - 1]


def test_sst_files(spark, docs, tmp_path):
    """Shards read back over splits smaller than a block, lookups by ranges, equal rows over several shards."""
    lib = Tokenizer.from_file(PATH)
    rows = [*ROWS, *((50, "the same text again and again") for _ in range(400)), (60, " ".join(f"long{i}" for i in range(60_000)))]
    path = f"file://{tmp_path}/shards"
    write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, PATH, shards=5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = read_shards(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 0]
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(ids(t))) for i, t in rows)
    shards = [open_() for open_ in open_shards(spark, path)]
    assert sum(s.documents for s in shards) == len(rows) and all(a.last <= b.first for a, b in zip(shards, shards[1:], strict=False))
    assert sum(s.first <= key_of(50) <= s.last for s in shards) > 1
    for i, t in ((1, BASE), (60, rows[-1][1]), (50, rows[-2][1]), (None, BASE), (11, "a" * 3000)):
        assert lookup(spark, path, i).tolist() == ids(t)
    assert lookup(spark, path, 51) is None and lookup(spark, path, 61) is None


def test_quality_rules(docs, empty):
    want = collections.Counter()
    for i, t in ROWS:
        w = words(t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    got = quality_rules(docs).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert all(r.kept == (not r.base_failed and r.host_rate <= 0.5) for r in got)
    assert quality_rules(empty).count() == 0
    # as many hosts as no broadcast would take
    assert collections.Counter(tuple(r) for r in quality_rules(docs, broadcast_hosts=0).collect()) == collections.Counter(tuple(r) for r in got)


def test_sharding(docs, empty):
    rows = shard(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert shard(empty).count() == 0
    one = initial(16)
    two = grow(one)
    assert {b for a, b in zip(one.shards, two.shards, strict=True) if a != b} == {16} and two.version == 2
    load = {s: 1 + 9 * (s % 16 == 0) for s in range(len(one.shards))}
    even = rebalance(one, load)
    size = lambda m: [sum(load[s] for s, k in enumerate(m.shards) if k == x) for x in range(16)]
    assert max(size(even)) < max(size(one))


def test_sharding_values(docs):
    """Shards, grown shards, slots' bytes and places against plain Python: the virtual slot is XXH64 of the identifier."""
    slot_of = lambda i: 42 if i is None else int(suffix_dedup_module._home([i], 4096)[0])
    one, two = initial(4), grow(initial(4))
    size = lambda t: len((t or "").encode()) + 1
    load = collections.Counter()
    for i, t in ROWS:
        load[slot_of(i)] += size(t)
    want = collections.Counter((i, size(t), one.shards[slot_of(i)], two.shards[slot_of(i)], slot_of(i), load[slot_of(i)], 1) for i, t in ROWS)
    rows = shard(docs, 4).collect()
    assert collections.Counter((r.doc_id, r.size, r.shard, r.grown_shard, r.virtual_slot, r.slot_bytes, r.map_version) for r in rows) == want
    by = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.virtual_slot for r in by] == [s for k in range(4) for s in sorted(r.virtual_slot for r in rows if r.shard == k)]


def test_sharding_map_store(spark, docs):
    store = MapStore(spark)
    rows = shard(docs, 4, store=store).collect()
    one, two = store.get(1), store.get(2)
    assert (one, two) == (initial(4), grow(initial(4)))
    assert all((r.shard, r.grown_shard) == (one.shards[r.virtual_slot], two.shards[r.virtual_slot]) for r in rows)
    with pytest.raises(Exception, match="(?i)exists"):
        store.grow(1)
    by_slot = collections.Counter()
    for r in rows:
        by_slot[r.virtual_slot] += r.size
    assert all(r.slot_bytes == by_slot[r.virtual_slot] for r in rows)
    many = spark.createDataFrame([(i, "x" * (i % 7 * 900)) for i in range(3000)], "doc_id long, text string").repartition(3)
    store = MapStore(spark)
    rows = shard(many, 8, law="bytes", store=store).collect()
    size, even = collections.Counter(), store.get(2)
    for r in rows:
        assert (r.law, r.grown_shard, r.map_version) == ("bytes", None, 2) and r.shard == even.shards[r.virtual_slot]
        size[r.shard] += r.size
    assert max(size.values()) <= 1.02 * sum(size.values()) / 8
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_urls(spark):
    urls = [
        (1, "http://EXAMPLE.com/en/7a?x#y", "example.com", "/en/7a", "example.com/en/7", "allow"),
        (2, "https://a.b.com/en/1", "a.b.com", "/en/1", "com/en/", "block"),
        (3, "x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (4, "x://m.example.net/de/9", "m.example.net", "/de/9", "net/de/", "allow"),
        (5, "http://site.org/es/", "site.org", "/es/", "org/es/", "block"),
        (6, None, "", "", None, None),
        (7, "no scheme/en/", "", "", None, None),
        (8, "http://xcom/en/", "xcom", "/en/", None, None),
        (9, "http://?q", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u, *_ in urls], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    for i, _, host, path, rule, verdict in urls:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert filter_urls(pages.where("false")).count() == 0
    rows = [([k % 8, 8 + k % 3], int(k % 8 < 4)) for k in range(200)]
    bias, weights = url_filter.fit(rows, 4)
    assert all((sum(weights[s] for s in slots) / len(slots) ** 0.5 + bias > 0) == bool(y) for slots, y in rows)


def test_urls_scores_and_held_out(spark):
    """The model's scores against plain Python, and its verdicts on urls that it was not fitted on."""
    import xxhash

    rng = np.random.default_rng(12)
    word = lambda pool: "".join(rng.choice([*pool], 6))
    rows = [(f"http://{word('bcdfg')}.info/{word('casino')}", 1) for _ in range(150)] + [(f"http://{word('aeiou')}.info/{word('school')}", 0) for _ in range(150)]
    order = rng.permutation(300)
    fitted, held = [rows[i] for i in order[:200]], [rows[i] for i in order[200:]]
    labelled = spark.createDataFrame(fitted + [(None, 1), ("http://x.info/y", None)], "url string, block int")
    pages = spark.createDataFrame(list(enumerate(u for u, _ in held)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.block_score) for r in filter_urls(pages, labelled).collect()}

    def slots(url):
        out, rest = [], (url or "").partition("://")[2]
        host, _, path = rest.partition("/")
        for mark, part in (("h", f"^{host}$"), ("p", f"^/{path}$" if rest else "^$")):
            for k in range(len(part) - 2):
                seed = xxhash.xxh64_intdigest(mark.encode(), 42)
                out.append(np.array([xxhash.xxh64_intdigest(part[k : k + 3].encode(), seed)], np.uint64).view(np.int64)[0] % 4096)
        return out

    bias, weights = url_filter.fit(sorted([(slots(u), b) for u, b in [*fitted, (None, 1)]], key=lambda x: str(x)), 12)
    for k, (url, _) in enumerate(held):
        s = slots(url)
        z = sum(weights[i] for i in s) / len(s) ** 0.5 + bias
        assert got[k][1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    assert sum((got[k][0] == "block") == bool(b) for k, (_, b) in enumerate(held)) / len(held) > 0.95


def test_urls_sample_takes_each_url_once(spark):
    def pages(urls):
        return spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")

    few = [*(f"http://a{k}.com/en/bad" for k in range(20)), *(f"http://b{k}.net/de/good" for k in range(20))]
    hot = pages(few).orderBy(F.xxhash64("url")).first()["url"]
    got = {r.url: r.block for r in url_filter.labelled_by_rules(pages([*few, *[hot] * 300]), 100).collect()}
    assert len(got) == 40 and set(got.values()) == {0, 1}
    table = pages([*few, *[hot] * 300, "http://c.com/x/bad", "http://d.net/y/good"])
    verdict = {r.path: r.verdict for r in filter_urls(table, max_labelled=100).where("rule is null").collect()}
    assert verdict == {"/x/bad": "block", "/y/good": "allow"}
    one = pages(["http://a.com/en/1"] * 5 + ["http://xcom/zz"])
    assert [r.verdict for r in filter_urls(one).orderBy("page_id").collect()] == ["block"] * 5 + ["allow"]


def test_near_duplicates_repeated_ids(spark):
    import corpus_pipeline as C

    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    rows = [
        (1, text("a"), "s"),
        (7, text("b"), "t"),
        (7, text("b"), "s"),  # an equal text: the first by source stays
        (7, text("c"), "s"),
        (7, text("a") + " end", "s"),  # linked to doc 1
        (7, text("d"), "s"),
        (8, text("c") + " end", "s"),  # linked to one of the texts of doc 7
        (9, "", "s"),
        (9, "", "t"),
        (None, text("a"), "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = C.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter(rows[k] for k in (0, 2, 3, 5, 7, 8, 9))


def test_quality_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_scores(docs, labels.where("doc_id % 2 = 0"))
    j = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == (r.quality == 1) for r in j) / len(j) > 0.95
    assert scored.count() == docs.count()


def test_toxic_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = document_scores(docs, labels.where("doc_id % 2 = 0"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0 and r.quality == 1]
    assert len(toxic) > 100 and sum(not r.keep for r in toxic) / len(toxic) > 0.9
    assert sum(r.keep for r in clean) / len(clean) > 0.95


def test_classifier_scores_by_hand(spark):
    """Scores of the corpus against a plain reading of the models, text by text."""
    from scenalyx.llm import cotraining as C

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    models = C.train(docs, labels, rounds=1)
    some = docs.where("doc_id % 23 = 0")
    got = {r.row.doc_id: r for r in C.score_rows(some, models).collect()}
    sure = lambda z: 1 / (1 + np.exp(-z))
    for r in some.collect():
        both = [np.clip(s * x + t, -30, 30) for x, (s, t) in zip(quality_odds_by_hand(models.quality, r), models.quality.calibration, strict=True)]
        has_words = bool(words(r.text))
        score = sure(sum(both) / 2) if has_words else 0.0
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].keep == (score >= 0.5 and has_words and got[r.doc_id].toxic_score < 0.5)


def quality_odds_by_hand(m, r):
    """Uncalibrated log-odds of the text view and the metadata view of one document."""
    from scenalyx.llm import cotraining as C
    from scenalyx.llm import kernels as K

    raw = (r.text or "").encode()
    tokens = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    size, words_ = max(len(raw), 1), max(len(tokens), 1)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in tokens]
    count = lambda keep: sum(keep(c) for c in raw) / size
    numbers = np.array([
        np.log1p(len(raw)), np.log1p(raw.count(b"\n")), count(lambda c: 65 <= c <= 90), count(lambda c: 33 <= c < 127 and not chr(c).isalnum()), count(lambda c: 48 <= c <= 57),
        count(lambda c: c == 32 or 9 <= c <= 13), len(set(low)) / words_, size / words_ / 10, np.log1p(len(tokens)),
    ])
    meta = m.meta[0][zlib.crc32((r.source or "").encode()) % C.SOURCES] + m.meta[0][C.SOURCES + zlib.crc32((r.lang or "").encode()) % C.LANGS] + m.meta[1]
    meta += np.clip((numbers - m.mean) / m.scale, -8, 8) @ m.meta[0][C.SOURCES + C.LANGS :]
    hashed = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    w, bias = m.text
    z = sum(w[int(h >> np.uint64(64 - C.BITS))] for h in hashed)
    for k, t in enumerate(tokens):
        z += w[(1 << C.BITS) + ((t[-1] * 257 + (t[-2] if len(t) > 1 else 0)) * 40503 & 0xFFFF) % (1 << 12)]
        z += w[-1] * (k > 0 and low[k] == low[k - 1])
    return z / words_ + bias, meta


def test_one_round_of_the_exchange_by_hand(spark, monkeypatch):
    """Each view is taught the texts without a label of which the other is surest, from its trusted sureness on."""
    from scenalyx.llm import cotraining as C

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen, own = {}, C._exchange

    def watched(rows, ids, targets, per_round, sure):
        q = targets[0]
        seen["model"], seen["trusted"], seen["losses"] = q.model(calibrated=False), {(v, x): q.trusted(v, x) for v in (0, 1) for x in (0, 1)}, [q.loss()]
        taught = []
        monkeypatch.setattr(q, "teach", lambda view, label, rows: (taught.extend((view, label, r["sure"]) for r in rows), C.Target.teach(q, view, label, rows)))
        out = own(rows, ids, targets, per_round, sure)
        seen["taught"] = taught
        seen["losses"].append(q.loss())
        return out

    monkeypatch.setattr(C, "_exchange", watched)
    C.train(docs, labels.where("doc_id % 3 = 0"), rounds=1, per_round=20, sure=0.9, max_labelled=40)
    known = {r.doc_id for r in labels.where("doc_id % 3 = 0").collect()}
    assert len(known) > 40  # labelled ids beyond the sample are not taught either
    want = []
    rows = {}
    for r in docs.collect():
        if words(r.text) and r.doc_id not in known:
            rows.setdefault(r.text, []).append(quality_odds_by_hand(seen["model"], r))
    for view in (0, 1):
        for label in (0, 1):
            p = [max(1 / (1 + np.exp(-np.clip(z[view], -30, 30) * (1 if label else -1))) for z in zs) for zs in rows.values()]
            top = [x for x in sorted(p, reverse=True) if x >= 0.9][:20]
            want += [(1 - view, float(label), x) for x in top if x >= seen["trusted"][view, label]]
    assert len(want) > 20
    got = seen["taught"]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want), atol=1e-6)
    assert seen["losses"][1] <= seen["losses"][0]


def test_training_keeps_one_matrix_at_a_time():
    """The driver's memory while it trains stays near one view's rows: once it was 80 bytes a feature and more."""
    import json
    import tracemalloc

    from scenalyx.llm import cotraining as C

    rng = np.random.default_rng(3)

    def row(i):
        slots = np.unique(rng.integers(0, C.TEXT_SIZE // 2, 400) + C.TEXT_SIZE // 2 * (i % 2)).astype(np.int32)
        return {"doc_id": i, "label": i % 2, "toxic": None, "held": False, "slots": slots.tobytes(), "parts": np.full(len(slots), 0.01, np.float32).tobytes(), "marks": b"", "meta": json.dumps([i % 2, 0, [0.0] * C.NUMBERS])}

    rows = [row(i) for i in range(1000)]
    features = sum(len(r["slots"]) // 4 for r in rows)
    tracemalloc.start()
    try:
        target = C.Target(rows)
        at_rest, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 50 * features and at_rest < 10 * features
    assert target.loss() < 0.1


def test_exchange_is_undone_where_it_hurts():
    """Labels that held-out rows contradict are taken back, and end the exchange."""
    import json

    from scenalyx.llm import cotraining as C

    rng = np.random.default_rng(2)

    def row(i, label):
        slots = np.unique(rng.integers(0, 40, 8) + 40 * label).astype(np.int32)
        return {"doc_id": i, "label": label, "toxic": None, "held": False, "sure": 0.99, "slots": slots.tobytes(), "parts": np.full(len(slots), 0.1, np.float32).tobytes(), "marks": b"", "meta": json.dumps([label, 0, [float(label)] * C.NUMBERS])}

    target = C.Target([row(i, i % 2) for i in range(300)])
    loss, n = target.loss(), len(target.rows)
    assert target.trusted(0, 1) < 1 and target.trusted(1, 0) < 1
    wrong = [{"x": row(1000 + i, 0)} for i in range(300)]
    target.exchange({(0, 1): wrong, (1, 1): wrong})
    assert target.ended and len(target.rows) == n and target.loss() == loss
    right = C.Target([row(i, i % 2) for i in range(300)])
    right.exchange({(0, 1): [{"x": row(2000 + i, 1)} for i in range(20)], (0, 0): [{"x": row(3000 + i, 0)} for i in range(20)]})
    assert right.loss() <= loss


def test_gathered_bytes_are_bounded(spark):
    from scenalyx.llm import cotraining as C

    df = spark.createDataFrame([(i, bytes(100), b"", b"", "") for i in range(50)], "doc_id long, slots binary, parts binary, marks binary, meta string")
    assert C.within_bytes(df, F.struct("slots", "parts", "marks", "meta"), "doc_id", 1000).count() == 10


def test_names_may_clash(spark, docs, tmp_path):
    """Columns of any name in any table, and timestamps that keep their microseconds."""
    import datetime

    import corpus_pipeline as C

    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    names = ["__source", "__keep", "row", "keep", "score", "part", "kind", "a", "carry", "text_hash", "key", "id", "label"]
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in names], F.lit(when).alias("at"))
    labels = spark.createDataFrame([(i, i % 2, 0, "x", "y") for i in range(1, 14)], "doc_id long, quality int, toxic int, text string, held string")
    labels.write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    items = spark.createDataFrame([(1, " ".join(words(BASE)[5:30]), 3, "z")], "item_id long, text string, k int, window string")
    items.write.mode("overwrite").parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, wide, f"file://{tmp_path}")
        assert out.schema == wide.schema or [f.dataType for f in out.schema] == [f.dataType for f in wide.schema], name
        rows = out.collect()
        assert out.columns == wide.columns and all(r.at == when and r["__source"] == "__source" and r.key == "key" for r in rows), name
    assert C.packed(spark, wide, "").count() >= len(ROWS)
    assert op_rows(spark, wide, items, labels) == len(ROWS)


def op_rows(spark, wide, items, labels):
    """Rows of every operator on a table of clashing names: as many as it has, for those that give one a row."""
    found = {
        jaccard_components(wide).count(), token_counts(wide, PATH).count(), decontaminate(wide, items).count(), suffix_dedup(wide).count(), sst_round_trip(wide, PATH).count(),
        quality_rules(wide).count(), shard(wide).count(), document_scores(wide, labels).count(),
    }
    assert len(found) == 1
    return found.pop()


def test_pipeline_edges(spark, docs):
    """Every stage on no rows, null and repeated identifiers, null columns, and tables without the extra columns."""
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.where("false"), d).count() == 0
    bare = spark.createDataFrame([(None, BASE), (None, BASE), (1, None), (1, "a few plain words about nothing in particular"), (2, "")], "doc_id long, text string")
    assert C.near_duplicates(spark, bare, d).count() == 5
    assert collections.Counter(tuple(r) for r in C.repeated_passages(spark, bare, d).collect()) == collections.Counter(tuple(r) for r in bare.collect())
    assert C.decontaminated(spark, bare, d).count() == 5
    assert C.quality(spark, bare, d).where("text is null or text = ''").count() == 0
    assert C.packed(spark, bare, d).count() == 5 and C.packed(spark, bare.where("false"), d).count() == 0


def test_long_texts_of_the_other_operators(spark):
    """One text of megabytes, one word of megabytes, and a short one."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocabulary, 300_000))
    rows = [(1, long), (2, "y" * (1 << 20)), (3, "short text"), (4, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    lib = Tokenizer.from_file(PATH)
    ids = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()} == ids
    assert {r.doc_id: r.n_tokens - 1 for r in sst_round_trip(df, PATH).collect()} == ids
    pieces = pack(df, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in pieces} == ids
    item = spark.createDataFrame([(9, " ".join(long.split()[250_000:250_012]))], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate(df, item).collect()} == {1: (300_000, 12), 2: (1, 0), 3: (2, 0), 4: (len(rows[3][1].split()), 0)}
    assert {r.doc_id: r.n_words for r in quality_rules(df).collect()} == {1: 300_000, 2: 1, 3: 2, 4: len(rows[3][1].split())}
    assert {r.doc_id: r.size for r in shard(df, 4).collect()} == {i: len(t) + 1 for i, t in rows}
    assert document_scores(df, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")).count() == 4


def test_quality_classifier_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == len(ROWS)
    assert {r.keep for r in rows if r.doc_id in (4, 5, 6)} == {False}
    assert quality_scores(empty, none).count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
