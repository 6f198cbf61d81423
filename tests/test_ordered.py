"""Running sums over ranges, haloed blocks and bucketed bootstraps against plain loops."""

import collections
import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from scenalyx.operators import inference, ordered, resampling, scoring
from scenalyx.runtime import checkpoint_dir, cut


def series(seed, n=700):
    """One series of half the rows, a null key, values that many rows share, and nulls."""
    rng = np.random.default_rng(seed)
    keys = ["hot"] * 5 + ["a", "b", None, "c"]
    rows = []
    for i in range(n):
        v = None if rng.random() < 0.05 else float(rng.choice([1.5, 2.5, round(rng.normal(), 3)]))
        rows.append((keys[rng.integers(len(keys))], int(i % 3), i, v))
    return rows


def test_running_sums(spark):
    rows = series(1)
    df = spark.createDataFrame(rows, "k string, g int, t int, v double").repartition(7)
    want, total, count = {}, collections.Counter(), collections.Counter()
    for k, g, t, v in rows:
        total[k, g] += v or 0.0
        count[k, g] += 1
        want[k, g, t] = (round(total[k, g], 9), count[k, g])
    got = ordered.running_sums(df, ["k", "g"], ["t"], {"s": F.col("v"), "n": F.lit(1)})
    assert got.columns == ["k", "g", "t", "v", "s", "n"]
    assert {(r.k, r.g, r.t): (round(r.s, 9), r.n) for r in got.collect()} == want
    whole = ordered.running_sums(df, [], ["t"], {"n": F.lit(1)})
    assert all(r.n == r.t + 1 for r in whole.collect())
    assert ordered.running_sums(df.where("false"), ["k"], ["t"], {"s": F.col("v")}).count() == 0


def test_running_sums_of_one_series_in_many_ranges(spark):
    """A series of all rows is dealt over the ranges; no task sums more than a share of it."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("t"))
        got = ordered.running_sums(df, ["k"], ["t"], {"n": F.lit(1)}).withColumn("task", F.spark_partition_id())
        assert all(r.n == r.t + 1 for r in got.collect())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert len(sizes) > 8 and max(sizes) < 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_sets_are_no_task_for_every_partition(spark):
    """Ranges follow the rows, not the shuffle partitions; the sums are the same in many ranges."""
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(90)], "k int, t int, v double")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", coalesce)}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        few = ordered.value_sums(df, ["k"], "t", {"s": F.col("v")})
        assert few.rdd.getNumPartitions() <= 4
        spark.conf.set(coalesce, "false")
        many = ordered.value_sums(df, ["k"], "t", {"s": F.col("v")})
        assert many.rdd.getNumPartitions() > 4
        want = {(i % 3, i): float(sum(range(i % 3, i + 1, 3))) for i in range(90)}
        assert {(r.k, r.t): r.s_upto for r in few.collect()} == {(r.k, r.t): r.s_upto for r in many.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_value_sums_keep_ties_together(spark):
    rows = [(k, v) for k, _, _, v in series(2) if v is not None]
    got = ordered.value_sums(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"n": F.lit(1)})
    table = pd.DataFrame(rows, columns=["k", "v"])
    for r in got.collect():
        own = table[table.k.isna() if r.k is None else table.k == r.k]
        assert (r.n, r.n_upto) == ((own.v == r.v).sum(), (own.v <= r.v).sum())


@pytest.mark.parametrize(("block", "lags"), [(10, 7), (50, 3), (3, 3)])
def test_halo(spark, block, lags):
    df = spark.range(1, 96).select(F.lit("s").alias("k"), F.col("id").alias("rn"))
    got = ordered.haloed(df, ["k"], "rn", F.lit(block), F.lit(lags)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.block_no].append((r.own, r.rn))
    for b, rows in by.items():
        own = sorted(rn for o, rn in rows if o)
        assert own == list(range(b * block + 1, min((b + 1) * block, 95) + 1))
        assert sorted(rn for o, rn in rows if not o) == list(range((b + 1) * block + 1, min((b + 1) * block + lags, 95) + 1))
    assert len(got) <= 95 * (1 + lags / block)


def test_lagged_products():
    rng = np.random.default_rng(3)
    for n, own, lags in ((30, 20, 9), (5, 5, 9), (400, 300, 90), (40, 40, 200)):
        c = rng.normal(size=n)
        want = [sum(c[t] * c[t + k] for t in range(own) if t + k < n) for k in range(lags + 1)]
        assert np.allclose(inference.lagged_products(c, own, lags), want, atol=1e-9)


def test_autocovariance_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK", 16)  # series of many blocks
    rng = np.random.default_rng(4)
    rows = [(b, f, datetime.date(2000, 1, 1) + datetime.timedelta(t), float(rng.normal())) for b in "xy" for f in range(3) for t in range((80, 33, 1)[f])]
    df = spark.createDataFrame(rows, "b string, fold int, date date, diff double")
    got = {(r.b, r.lag): r for r in inference.autocovariance(df, ["b"], 12, ["fold"]).collect()}
    for b in "xy":
        parts = [np.array([v for k, g, _, v in rows if k == b and g == f]) for f in (0, 1)]  # one observation has no dependence
        mean, n = np.concatenate(parts).mean(), 113
        for lag in range(13):
            want = sum(((p[lag:] - mean) * (p[: len(p) - lag] - mean)).sum() for p in parts) / n
            r = got[b, lag]
            assert (r.acov, r.n, r.shortest) == (pytest.approx(want, abs=1e-12), n, 33)


@pytest.mark.parametrize("bucket", [8, 64, 4096])
def test_block_means(spark, bucket):
    """Short and long segments alike, whatever the bucket: sums of the blocks that the hashes name."""
    rng = np.random.default_rng(5)
    rows = [(b, f, t, float(rng.normal())) for b in "xy" for f in range(3) for t in range((70, 9, 31)[f])]
    df = spark.createDataFrame(rows, "b string, fold int, date int, diff double").repartition(5)
    blocks = spark.createDataFrame([("x", 5), ("y", 12)], "b string, block int")
    got = {(r.b, r.sample): r["mean"] for r in inference.block_means(df, ["b"], blocks, 40, 7, ["fold"], bucket=bucket).collect()}
    assert len(got) == 80
    for b, block in (("x", 5), ("y", 12)):
        for sample in range(40):
            total = n_all = 0
            for f in range(3):
                v = [x for k, g, _, x in rows if (k, g) == (b, f)]
                n, size = len(v), min(block, len(v))
                starts = resampling.drawn(f"7|block|{f}", sample, range(-(-n // size)), n - size + 1)
                total += sum(sum(v[s : s + min(size, n - i * size)]) for i, s in enumerate(starts.tolist()))
                n_all += n
            assert got[b, sample] == pytest.approx(total / n_all, abs=1e-12)


def test_draws_equal_the_column_expression(spark):
    from scenalyx.functions.expr import hash32

    rows = spark.range(50).select("id", F.pmod(hash32(7, "block", F.lit("t"), F.lit(3), F.col("id")), F.lit(17)).alias("s")).orderBy("id").collect()
    assert [r.s for r in rows] == resampling.drawn("7|block|t", 3, range(50), 17).tolist()


def test_scores_with_ties(spark):
    """CRPS, tails and F of discrete values against sums over all pairs."""
    rng = np.random.default_rng(6)
    scen = [("m", a, i, p, x) for a in "uv" for i, (p, x) in enumerate(zip(rng.dirichlet(np.ones(40)).tolist(), rng.integers(-3, 4, 40).astype(float).tolist()))]
    obs = [(a, i, float(y)) for a in "uv" for i, y in enumerate((-9.0, -1.0, 0.5, 2.0, 2.0, 9.0))]
    s = spark.createDataFrame(scen, "model string, asset string, date int, p double, x double")
    o = spark.createDataFrame(obs, "asset string, date int, y double")
    got = {(r.asset, r.date): r.crps for r in scoring.crps(s, o).collect()}
    f = {(r.asset, r.date): (r.f, r.f_below) for r in scoring.ranked(s, o).collect()}
    tails = {r.asset: (r["var"], r.es) for r in scoring.tail(s, ["asset"], 0.1).collect()}
    for a in "uv":
        p, x = np.array([(r[3], r[4]) for r in scen if r[1] == a]).T
        half = (p[:, None] * p * np.abs(x[:, None] - x)).sum() / 2
        for b, i, y in obs:
            if a == b:
                assert got[a, i] == pytest.approx((p * np.abs(x - y)).sum() - half, abs=1e-12)
                assert f[a, i] == (pytest.approx(p[x <= y].sum()), pytest.approx(p[x < y].sum(), abs=1e-12))
        order = np.argsort(x)
        cum = p[order].cumsum()
        var = x[order][np.argmax(cum >= 0.1)]
        es = ((x * p)[x < var].sum() + var * (0.1 - p[x < var].sum())) / 0.1
        assert tails[a] == (var, pytest.approx(es))


def test_checkpoints_go_with_their_frames(spark):
    import gc
    import time

    jvm = spark.sparkContext._jvm
    checkpoint_dir(spark)
    root = jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = lambda: {str(f.getPath()) for f in fs.listStatus(root)}
    before = held()
    frame = cut(spark.range(10).toDF("id"))
    made = held() - before
    assert len(made) == 1 and frame.count() == 10
    more = frame.where("id > 3")
    del frame
    gc.collect()
    jvm.System.gc()
    time.sleep(1)
    assert made <= held() and more.count() == 6  # what was made from it still reads it
    del more
    for _ in range(40):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
        if not made & held():
            break
    assert not made & held()


def test_drawn_hashes_side_by_side():
    """Many blocks at once draw what one at a time does, across changes of the number of digits and for long names."""
    from hashlib import md5

    for prefix in ("7|block|0", "7|block|" + "x" * 60):
        for blocks in (range(0, 1200), range(99_950, 100_060)):
            want = [int.from_bytes(md5(f"{prefix}|31|{b}".encode()).digest()[:4], "big") % 977 for b in blocks]
            assert resampling.drawn(prefix, 31, blocks, 977).tolist() == want


def test_rows_of_long_draws_grow_with_the_series(spark):
    """A span of draws sends its places in few rows, not one for every 4,096 rows of the series."""
    import pyarrow as pa

    rows = {}
    for n in (400_000, 1_600_000):
        size = 2
        one = pa.record_batch([pa.array([v]) for v in ("p", n, size, max(resampling.BUCKET * 16, -(-n // 1024)), 0, 0)], ["prefix", "n", "size", "width", "sample", "low"])
        out = list(resampling._ends(0)(iter([one])))
        rows[n] = sum(b.num_rows for b in out)
        draws = min(resampling.BLOCKS_A_ROW, n // size)
        assert sum(len(v.as_py()) for b in out for v in b.column("places")) == 2 * 2 * draws
    assert rows[1_600_000] < 200


@pytest.mark.parametrize("wider", [1, 16])
def test_buckets_of_a_long_series(spark, monkeypatch, wider):
    monkeypatch.setattr(resampling, "WIDER", wider)
    rng = np.random.default_rng(6)
    v = rng.normal(size=3000)
    df = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(v)], "b string, date int, diff double").repartition(3)
    got = {r.sample: r["mean"] for r in inference.block_means(df, ["b"], spark.createDataFrame([("a", 2)], "b string, block int"), 6, 7, bucket=64).collect()}
    for sample in range(6):
        starts = resampling.drawn("7|block", sample, range(1500), 2999)
        assert got[sample] == pytest.approx(sum(v[s] + v[s + 1] for s in starts) / 3000, abs=1e-12)
