"""Centroid clustering, source mixing and the filter audit against brute force."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenalyx.llm import centroids, curriculum, filter_audit
from scenalyx.llm.spark import Scratch

# --- centroid clustering -------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance) rows, each cluster's inertia, and the centroids, by plain loops over Python's integers."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v, n) for n, (i, v) in enumerate(rows))
    c = [kept[n][1] for *_, n in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    spread = collections.Counter()
    for _, j, d in final:
        spread[j] += d
    return final, spread, c


def vectors(seed, n, dims, far=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (6, dims))
    rows = []
    for i in range(n):
        v = (base[rng.integers(6)] + rng.normal(0, 0.1, dims)).astype(np.float32).tolist()
        rows.append((int(i) if i % 17 else None, v))
        if i % 5 == 0:
            rows.append((int(i), v))
    if far:
        rows += [(10_000 + n, [x * far for x in v]) for n, (_, v) in enumerate(rows[:9])]
    broken = [(1, None), (2, []), (3, [0.0] * (dims - 1)), (4, [0.0] * (dims + 1)), (5, [0.0] * (dims - 1) + [None]), (6, [float("nan")] * dims), (7, [float("inf")] + [0.0] * (dims - 1))]
    return rows + broken


@pytest.mark.parametrize("far", [0.0, 1e4, 3e7, 1e25])
def test_clusters(spark, far):
    rows = vectors(3, 150, 64, far)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, code string").repartition(5)
    want, spread, c = brute_clusters(df.select("vec_id", "embedding").collect(), 16, 3, 64, 64)
    most = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    got = collections.Counter(tuple(r) for r in centroids.cluster(df).collect())
    assert got == collections.Counter((i, j, min(d, most), min(spread[j], most), min(sum(spread.values()), most), digest[j]) for i, j, d in want)


def test_clusters_few_vectors_and_ties(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (None, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, _, _ = brute_clusters(rows, 4, 2, 2, 2)
    got = centroids.cluster(df, clusters=4, rounds=2, dims=2, scale=2, segments=2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == sorted((str(i), j, d) for i, j, d in want)
    # one point twice as a start: the smaller number has all, the other stays empty
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.cluster for r in centroids.cluster(same, clusters=3, rounds=2, dims=2, segments=1).collect()} == {0}
    assert centroids.cluster(df.where("false"), dims=2).count() == 0
    assert centroids.cluster(df, dims=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_screen():
    """No bound is above the exact distance, and most exact distances are not needed."""
    rng = np.random.default_rng(5)
    c = rng.integers(-40, 40, (16, 64)) * rng.integers(1, 4, (16, 1))
    v = c[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64))
    found = centroids.Centroids(tuple(map(tuple, c.tolist())), 8)
    assign = centroids.Assigner(found)
    low = centroids.bounds(centroids.segment_norms(v, 8), assign.norms)
    exact = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert (low <= exact).all()
    cluster, distance = assign(v, centroids.segment_norms(v, 8))
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert assign.exact < 0.5 * exact.size


# --- source mixing -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, share, most):
    left, open_, target = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = max(left, 0.0) / sum(open_.values())
        full = [s for s in open_ if most * sizes[s] < level * open_[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def source_rows(seed, n):
    rng = np.random.default_rng(seed)
    names = ["b", "a", None, "Z", "é", "", "hot"]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else names[rng.integers(len(names))]
        text = None if rng.random() < 0.05 else " ".join("w" * rng.integers(1, 9) for _ in range(int(rng.lognormal(2, 1.5))))
        rows.append((None if i % 41 == 0 else int(i % 97 if i % 3 == 0 else i), text, source))
    return rows + [(7, "same text", "hot")] * 60


def test_mix(spark):
    rows = source_rows(1, 400)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, range string").repartition(6)
    keyed = df.select("doc_id", "source", "text", F.xxhash64(F.lit(1), "doc_id").alias("h")).collect()
    docs = sorted(((r.source is None, r.source or "", r.h, r.doc_id is not None, r.doc_id or 0, len(WORD.findall(r.text or ""))) for r in keyed))
    sizes = collections.Counter()
    for none, source, *_, size in docs:
        sizes[none, source] += size
    names = sorted(sizes, key=lambda s: (s[0], s[1].encode()))
    target = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    want, at = collections.Counter(), collections.Counter()
    for none, source, _, known, doc, size in docs:
        s = (none, source)
        goal = math.floor(target[s] + 1e-9)
        taken = sum(min(max(goal - at[s] - k * sizes[s], 0), size) for k in (0, 1))
        at[s] += size
        want[doc if known else None, size, sizes[s], round(target[s], 6), taken] += 1
    mixed = curriculum.mix(df)
    got = collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed.collect())
    assert got == want
    taken = collections.Counter()
    for r in mixed.collect():
        assert r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[r.source is None, r.source or ""] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = curriculum.mix(df.repartition(3, "text"))
    assert collections.Counter(tuple(r) for r in again.collect()) == collections.Counter(tuple(r) for r in mixed.collect())


def test_mix_order_follows_the_schedule(spark):
    """At any time the words that are due from a source are its cumulative demand, within a document."""
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = curriculum.curriculum(df)
    order = curriculum.training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    target = {r.source: r.target for r in mixed.collect()}
    for k, schedule in enumerate(curriculum.CYCLE):
        for t in (0.1, 0.3, 0.5, 0.75, 0.95):
            grid = np.linspace(0, t, 2001)
            weight = np.interp(grid, *zip(*schedule.knots))
            demand = target[f"s{k}"] * np.trapezoid(weight, grid) / schedule.share
            due = sum(r["words"] for r in order if r.source == f"s{k}" and r.position < t)
            assert abs(due - demand) <= 6
    assert {r.reading for r in order} == {0, 1}


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, " \t", "a"), (None, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in curriculum.mix(df).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)}
    assert curriculum.mix(df.where("false")).count() == 0
    one = df.sparkSession.createDataFrame([(1, "x " * 3000, "a")], df.schema)
    assert [(r["size"], r.target, r.taken) for r in curriculum.mix(one).collect()] == [(3000, 4500.0, 4500)]
    with pytest.raises(ValueError):
        curriculum.Schedule(((0.0, 1.0), (0.5, 1.0)))
    flat = curriculum.Schedule(((0.0, 0.0), (0.5, 0.0), (1.0, 2.0)))  # nothing is due in the first half
    assert spark.range(1).select(flat.inverse(F.lit(0.25))).first()[0] == pytest.approx(0.75)


def test_mix_joins_ranges_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(source_rows(4, 150), "doc_id long, text string, source string")
    want = collections.Counter(tuple(r) for r in curriculum.mix(df).collect())
    monkeypatch.setattr(curriculum, "BROADCAST_ROWS", 0)
    assert collections.Counter(tuple(r) for r in curriculum.mix(df).collect()) == want


# --- filter audit --------------------------------------------------------------------------------


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for i, t, part in docs:
        t = t or ""
        w = re.split(r"[\x20\x09-\x0D]+", t)
        w = [x for x in w if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part or "", "".join(order), step), collections.Counter())
                if fails[f]:
                    c["unique_fails"] += sum(fails.values()) == 1
                    c["redundant" if gone else "removed"] += 1
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                    gone = True
                c["kept"] += not gone
    shapley = collections.Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(c[n] for n in names), shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def audit_rows(seed, n):
    rng = np.random.default_rng(seed)
    long = [" ".join(f"w{x}" for x in rng.integers(0, k, 230)) for k in (40, 400, 1000)]
    texts = [None, "", "short", "SHORT Text", "a & b", *long, long[1] + " $", long[2].upper(), "x " * 250]
    return [(None if rng.random() < 0.05 else int(rng.integers(0, n)), texts[rng.integers(len(texts))], ["en", "de", None, ""][rng.integers(4)]) for _ in range(n)]


def test_audit(spark):
    docs = audit_rows(2, 300)
    labels = [(i % 90, i % 2, int(i % 7 == 0)) for i in range(0, 150)] + [(None, 1, 1), (3, None, None), (5, 0, 0)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, step int, mask int").repartition(7)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, lab)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = brute_audit(docs, labels)
    assert len(rows) == len(want) == 3 * 600 and set(rows) == want


def test_audit_edges(spark, monkeypatch):
    docs = [(i, "same text", f"p{i % 40}") for i in range(400)] + [(1, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "HELD", 3)  # many parts: tasks pass on what they hold
    got = filter_audit.audit(df, lab)
    assert {tuple(r) for r in got.collect()} == brute_audit(docs, [])
    assert filter_audit.audit(df.where("false"), lab).count() == 0


def test_first_failures():
    table, names = filter_audit.first_failures("ABCDE"), filter_audit.orders("ABCDE")
    assert table.shape == (32, 120) and len(set(names)) == 120
    for mask in range(32):
        for k, order in enumerate(names):
            steps = [s for s, c in enumerate(order, 1) if mask >> "ABCDE".index(c) & 1]
            assert table[mask, k] == (steps[0] if steps else 0)


# --- shared files --------------------------------------------------------------------------------


def test_tables_of_a_call_go(spark, tmp_path):
    tables = Scratch(spark)
    frame = tables.written(spark.range(3).toDF("id"), "kept-for-a-while")
    assert frame.count() == 3 and tables.held
    tables.drop()
    assert not tables.held


def test_many_texts_of_one_id(spark):
    """Different texts under one doc_id are other sets: the join that fetches texts grows with the rows."""
    from scenalyx.llm.jaccard_join import jaccard_components

    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(7, f"{passage} " + " ".join(f"r{k}w{i}" for i in range(3))) for k in range(2000)] + [(7, "equal rows of one id " * 5)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = jaccard_components(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {7}
    joined = spark_join_rows(spark)
    assert max(joined) >= len(rows) and max(joined) <= 20 * len(rows)


def spark_join_rows(spark):
    """Output rows of the joins of all executions that the session has kept."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = []
    for e in range(store.executionsCount()):
        run = store.executionsList().apply(e)
        metrics = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" in node.name():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    found = metrics.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and found.isDefined():
                        out.append(int(str(found.get()).replace(",", "")))
    return out


# --- vocabulary files ----------------------------------------------------------------------------


def vocabulary(tmp_path, name, extra=0, merges=(), added=(), **model):
    """A byte-level file: ``extra`` unused tokens first, so that ids may pass 65,536."""
    import json

    from scenalyx.llm import bpe

    vocab = {f"unused{i}": i for i in range(extra)}
    for token in [*bpe.byte_letters(), *(a + b for a, b in merges)]:
        vocab.setdefault(token, len(vocab))
    tokens = [{"id": len(vocab) + k, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": special} for k, (t, special) in enumerate(added)]
    spec = {"version": "1.0", "added_tokens": tokens, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    spec["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]} | model
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(spec))
    return str(path)


MERGES = [("d", "e"), ("a", "b"), ("ab", "c"), ("de", "de"), ("x", "f")]
WIDE = [(chr(97 + i % 26), chr(97 + i // 26)) for i in range(26 * 26)]


@pytest.mark.parametrize(
    ("name", "given", "is_plain"),
    [
        ("plain", dict(merges=MERGES), True),
        ("wide", dict(extra=65_500, merges=WIDE), True),
        ("added", dict(merges=MERGES, added=[("foo", False), ("<end>", True)]), True),
        ("whole", dict(merges=MERGES, ignore_merges=True), False),
        ("suffix", dict(merges=[], end_of_word_suffix="</w>"), False),
        ("late part", dict(merges=[("ab", "c"), ("a", "b"), ("b", "c")]), False),
    ],
)
def test_counts_equal_the_library(spark, tmp_path, name, given, is_plain):
    import json

    from scenalyx.llm import bpe
    from scenalyx.llm.token_count import token_counts
    from tokenizers import Tokenizer

    path = vocabulary(tmp_path, name, **given)
    assert bpe.plain(json.loads(open(path).read())) == is_plain
    rng = np.random.default_rng(3)
    texts = ["de", "xfoo", "foo<end> de", "dedede abcabc", "", None] + ["".join(rng.choice(list("abcdefoxz <>é"), 60)) for _ in range(60)]
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts(df, path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
