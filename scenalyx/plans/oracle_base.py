"""Common table expressions of the oracle SQL: the weekly panel and what follows from it, and makers of statements."""

from __future__ import annotations

import re

CTES: list[tuple[str, str]] = [
    ("px", "SELECT date_trunc('week', l_shipdate)::DATE AS date, p_type AS asset, sum(l_extendedprice) / sum(l_quantity) AS raw FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    ("dpx", "SELECT l_shipdate::DATE AS date, p_type AS asset, sum(l_extendedprice) / sum(l_quantity) AS raw FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    ("grid", "SELECT d.date, a.asset, px.raw FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT asset FROM px) a LEFT JOIN px ON px.date = d.date AND px.asset = a.asset"),
    ("filled", "SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS price FROM grid"),
    ("complete", "SELECT date, asset, raw, price FROM (SELECT *, count(price) OVER (PARTITION BY date) AS have, count(*) OVER (PARTITION BY date) AS n FROM filled) WHERE have = n"),
    ("lagged", "SELECT date, asset, price, raw IS NOT NULL AS obs, lag(price) OVER w AS p0, lag(raw IS NOT NULL) OVER w AS obs0 FROM complete WINDOW w AS (PARTITION BY asset ORDER BY date)"),
    ("returns", "SELECT date, asset, ret, CASE WHEN date <= DATE '1999-12-31' THEN 'is' ELSE 'oos' END AS segment FROM (SELECT date, asset, price / p0 - 1 AS ret, min((obs AND obs0)::INT) OVER (PARTITION BY date) AS ok FROM lagged WHERE p0 IS NOT NULL) WHERE ok = 1"),
    ("zs", "SELECT asset, (ret - avg(ret) OVER (PARTITION BY asset)) / stddev_pop(ret) OVER (PARTITION BY asset) AS z, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn, count(*) OVER (PARTITION BY asset) AS n FROM returns WHERE segment = 'is'"),
    ("zero_runs", "SELECT asset, segment, max(CASE WHEN flag = 1 THEN n ELSE 0 END) AS max_zero_run FROM (SELECT asset, segment, flag, island, count(*) AS n FROM (SELECT asset, segment, flag, rn - row_number() OVER (PARTITION BY asset, segment, flag ORDER BY date) AS island FROM (SELECT *, (ret = 0)::INT AS flag, row_number() OVER (PARTITION BY asset, segment ORDER BY date) AS rn FROM returns)) GROUP BY ALL) GROUP BY 1, 2"),
    ("quality", "SELECT * FROM (SELECT asset, segment, count(*) AS n, avg(CASE WHEN ret = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_rate, stddev_pop(ret) AS vol FROM returns GROUP BY 1, 2) JOIN zero_runs USING (asset, segment)"),
    ("term", "SELECT segment, asset, date, rn, exp(s) - 1 AS tret, (rn - 5) % 5 = 0 AS is_nonoverlap FROM (SELECT segment, asset, date, row_number() OVER w AS rn, sum(ln(1 + ret)) OVER (PARTITION BY segment, asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM returns WINDOW w AS (PARTITION BY segment, asset ORDER BY date)) WHERE rn >= 5"),
    ("raw_weights", "SELECT date, pow(pow(0.5::DOUBLE, 1.0::DOUBLE / 55.0::DOUBLE), (count(*) OVER () - row_number() OVER (ORDER BY date))::DOUBLE) AS u, count(*) OVER () AS n, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM term WHERE segment = 'is')"),
    ("weights", "SELECT date, 'ewma' AS model, u / sum(u) OVER () AS p FROM raw_weights UNION ALL SELECT date, 'recent', 1.0::DOUBLE / least(n, 250) FROM raw_weights WHERE back <= 250 UNION ALL SELECT date, 'uniform', 1.0::DOUBLE / n FROM raw_weights"),
    ("scen", "SELECT model, asset, date, p, tret AS x FROM term JOIN weights USING (date) WHERE segment = 'is'"),
    ("obs", "SELECT asset, date, tret AS y FROM term WHERE segment = 'oos' AND is_nonoverlap"),
    ("moments", "SELECT model, asset, max(m1) AS m1, sum(p * pow(x - m1, 2)) AS m2, sum(p * pow(x - m1, 3)) AS m3, sum(p * pow(x - m1, 4)) AS m4 FROM (SELECT *, sum(p * x) OVER (PARTITION BY model, asset) AS m1 FROM scen) GROUP BY 1, 2"),
    ("dev", "SELECT *, x - sum(p * x) OVER (PARTITION BY model, asset) AS d FROM scen"),
    ("pairs", "SELECT a.model, a.date, a.p, a.asset AS asset_i, b.asset AS asset_j, a.d AS di, b.d AS dj FROM dev a JOIN dev b ON a.model = b.model AND a.date = b.date AND a.asset <= b.asset"),
    ("cov", "SELECT model, asset_i, asset_j, sum(p * di * dj) AS value FROM pairs GROUP BY 1, 2, 3"),
    ("cum", "SELECT *, sum(p) OVER (PARTITION BY model, asset ORDER BY x, date ROWS UNBOUNDED PRECEDING) AS cum FROM scen"),
    ("var", "SELECT model, asset, min(x) AS var FROM cum WHERE round(cum, 12) >= 0.05::DOUBLE GROUP BY 1, 2"),
    ("pair_term", "SELECT a.model, a.asset, sum(a.p * b.p * abs(a.x - b.x)) / 2 AS half FROM scen a JOIN scen b ON a.model = b.model AND a.asset = b.asset GROUP BY 1, 2"),
    ("crps", "SELECT model, asset, date, first - half AS crps FROM (SELECT s.model, s.asset, o.date, sum(p * abs(x - y)) AS first FROM scen s JOIN obs o ON s.asset = o.asset GROUP BY 1, 2, 3) JOIN pair_term USING (model, asset)"),
    ("scores", "SELECT model, date, avg(crps) AS score FROM crps GROUP BY 1, 2"),
    ("diff", "SELECT b.model AS benchmark, date, a.score - b.score AS diff FROM (SELECT date, score FROM scores WHERE model = 'ewma') a JOIN (SELECT * FROM scores WHERE model <> 'ewma') b USING (date)"),
    ("energy", "SELECT model, date, first - half AS energy FROM (SELECT model, date, sum(p * dist) AS first FROM (SELECT s.model, s.date AS sd, o.date, max(p) AS p, sqrt(sum((x - y) * (x - y))) AS dist FROM scen s JOIN obs o ON s.asset = o.asset GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT model, sum(p * q * dist) / 2 AS half FROM (SELECT a.model, a.date, b.date, max(a.p) AS p, max(b.p) AS q, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM scen a JOIN scen b ON a.model = b.model AND a.asset = b.asset GROUP BY a.model, a.date, b.date) GROUP BY 1) USING (model)"),
    ("variogram", "SELECT model, date, sum((g - e) * (g - e)) AS variogram FROM (SELECT a.date, a.asset AS ai, b.asset AS aj, sqrt(abs(a.y - b.y)) AS g FROM obs a JOIN obs b ON a.date = b.date AND a.asset < b.asset) JOIN (SELECT a.model, a.asset AS ai, b.asset AS aj, sum(a.p * sqrt(abs(a.x - b.x))) AS e FROM scen a JOIN scen b ON a.model = b.model AND a.date = b.date AND a.asset < b.asset GROUP BY 1, 2, 3) USING (ai, aj) GROUP BY 1, 2"),
    ("hits", "SELECT model, asset, date, (y < var)::INT AS hit FROM obs JOIN var USING (asset)"),
    ("kupiec", "SELECT model, asset, n, hits, 2 * ((CASE WHEN hits > 0 THEN hits * ln(greatest(hits / n::DOUBLE, 1e-12)) ELSE 0 END + CASE WHEN n > hits THEN (n - hits) * ln(greatest(1 - hits / n::DOUBLE, 1e-12)) ELSE 0 END) - (CASE WHEN hits > 0 THEN hits * ln(0.05::DOUBLE) ELSE 0 END + CASE WHEN n > hits THEN (n - hits) * ln(0.95::DOUBLE) ELSE 0 END)) AS lr_uc FROM (SELECT model, asset, count(*) AS n, sum(hit)::BIGINT AS hits FROM hits GROUP BY 1, 2)"),
    ("trans", "SELECT model, asset, count(*) FILTER (q = 0 AND hit = 0) AS n00, count(*) FILTER (q = 0 AND hit = 1) AS n01, count(*) FILTER (q = 1 AND hit = 0) AS n10, count(*) FILTER (q = 1 AND hit = 1) AS n11 FROM (SELECT *, lag(hit) OVER (PARTITION BY model, asset ORDER BY date) AS q FROM hits) GROUP BY 1, 2"),
    ("rates", "SELECT *, CASE WHEN n00 + n01 + n10 + n11 > 0 THEN (n01 + n11) / (n00 + n01 + n10 + n11)::DOUBLE ELSE 0 END AS pi, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01)::DOUBLE ELSE 0 END AS p0, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11)::DOUBLE ELSE 0 END AS p1 FROM trans"),
    ("christoffersen", "SELECT *, 2 * ((CASE WHEN n00 > 0 THEN n00 * ln(greatest(1 - p0, 1e-12)) ELSE 0 END + CASE WHEN n01 > 0 THEN n01 * ln(greatest(p0, 1e-12)) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(greatest(1 - p1, 1e-12)) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(greatest(p1, 1e-12)) ELSE 0 END) - (CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(greatest(1 - pi, 1e-12)) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(greatest(pi, 1e-12)) ELSE 0 END)) AS lr_ind FROM rates"),
    ("pit", "SELECT model, asset, date, least(1.0::DOUBLE, greatest(0.0::DOUBLE, below + v * (upto - below))) AS u FROM (SELECT s.model, s.asset, o.date, sum(CASE WHEN x < y THEN p ELSE 0 END) AS below, sum(CASE WHEN x <= y THEN p ELSE 0 END) AS upto, ('0x' || substr(md5('11|pit|' || s.model || '|' || s.asset || '|' || o.date), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM scen s JOIN obs o ON s.asset = o.asset GROUP BY 1, 2, 3)"),
    ("schedule", "SELECT rebalance_date, asset, n, var, (1 / var) / sum(1 / var) OVER (PARTITION BY rebalance_date) AS weight FROM (SELECT rebalance_date, asset, count(*) AS n, var_pop(ret) AS var FROM (SELECT min(date) AS rebalance_date FROM returns WHERE segment = 'oos' GROUP BY date_trunc('quarter', date)) JOIN returns ON date < rebalance_date GROUP BY 1, 2) WHERE n >= 100"),
    ("score_frame", "SELECT model, date, score AS mean_crps, energy, variogram FROM scores JOIN energy USING (model, date) JOIN variogram USING (model, date)"),
    ("long_scores", "SELECT 'mean_crps' AS metric, model, date, mean_crps AS score FROM score_frame UNION ALL SELECT 'energy', model, date, energy FROM score_frame UNION ALL SELECT 'variogram', model, date, variogram FROM score_frame"),
    ("contrast", "SELECT metric, b.model AS benchmark, year(date) AS fold, date, a.score - b.score AS diff, a.score AS fa, b.score AS fb FROM (SELECT * FROM long_scores WHERE model = 'ewma') a JOIN (SELECT * FROM long_scores WHERE model <> 'ewma') b USING (metric, date)"),
    ("day", "SELECT date, row_number() OVER (ORDER BY date) AS k, list(ret ORDER BY asset) AS r FROM returns WHERE segment = 'oos' GROUP BY date"),
    ("plan_weights", "SELECT 'WF_InverseVariance' AS portfolio, rebalance_date, asset, weight FROM schedule UNION ALL SELECT 'WF_EqualWeight', rebalance_date, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebalance_date) FROM schedule UNION ALL SELECT 'InverseVariance', first, asset, (1 / v) / sum(1 / v) OVER () FROM (SELECT asset, var_pop(ret) AS v FROM returns WHERE segment = 'is' GROUP BY asset) CROSS JOIN (SELECT min(date) AS first FROM returns WHERE segment = 'oos') UNION ALL SELECT 'EqualWeight', first, asset, 1.0::DOUBLE / count(*) OVER () FROM (SELECT DISTINCT asset FROM returns) CROSS JOIN (SELECT min(date) AS first FROM returns WHERE segment = 'oos')"),
    ("orders_of", "SELECT portfolio, k, list(weight ORDER BY asset) AS w FROM plan_weights JOIN day ON date = rebalance_date GROUP BY 1, 2"),
    ("sim", "SELECT DISTINCT portfolio, 0::BIGINT AS k, NULL::DATE AS date, 1.0::DOUBLE AS wealth, list_transform(w, lambda x: 1.0::DOUBLE / len(w)) AS cur, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS cost FROM orders_of UNION ALL SELECT portfolio, k, date, wealth * (1 - turnover * 0.002) * (1 + list_dot_product(w, r)), list_transform(range(1, len(w) + 1), lambda i: w[i] * (1 + r[i]) / (1 + list_dot_product(w, r))), turnover, turnover * 0.002 FROM (SELECT s.portfolio, d.k, d.date, s.wealth, d.r, coalesce(o.w, s.cur) AS w, CASE WHEN o.w IS NULL THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(1, len(o.w) + 1), lambda i: abs(o.w[i] - s.cur[i]))) / 2 END AS turnover FROM sim s JOIN day d ON d.k = s.k + 1 LEFT JOIN orders_of o ON o.portfolio = s.portfolio AND o.k = d.k)"),
    ("ledger", "SELECT portfolio, date, turnover, cost, wealth, wealth / lag(wealth, 1, 1.0::DOUBLE) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS r FROM sim WHERE k > 0"),
]


def with_base(sql: str) -> str:
    """The statement with the expressions it needs, in order."""
    body = dict(CTES)
    need: set[str] = set()
    todo = [sql]
    while todo:
        found = {n for n in body if re.search(rf"\b(FROM|JOIN)\s+{n}\b", todo[-1])} - need
        todo.pop()
        need |= found
        todo += [body[n] for n in found]
    parts = ", ".join(f"{n} AS ({q})" for n, q in CTES if n in need)
    return f"WITH RECURSIVE {parts} {sql}" if parts else sql


def _alike(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def acov_sql(source: str, keys: str, last: str, grouped: bool = False) -> str:
    """keys, lag, acov, n, mean, shortest of source (keys, seg, date, diff)."""
    live = f"SELECT *, count(*) OVER (PARTITION BY {keys}, seg) AS own FROM ({source})"
    c = f"SELECT *, diff - mean AS c, min(own) OVER (PARTITION BY {keys}) AS shortest FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, avg(diff) OVER (PARTITION BY {keys}) AS mean, row_number() OVER (PARTITION BY {keys}, seg ORDER BY date) AS rn FROM ({live}){' WHERE own > 1' if grouped else ''})"
    names = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"SELECT {names}, x.lag AS lag, sum(coalesce(x.c * y.c, 0)) / max(x.n) AS acov, max(x.n) AS n, max(x.mean) AS mean, max(x.shortest) AS shortest FROM (SELECT *, unnest(range(0, greatest({last}, 0)::BIGINT + 1)) AS lag FROM ({c})) x LEFT JOIN ({c}) y ON {_alike(keys, 'x', 'y')} AND x.seg = y.seg AND y.rn = x.rn - x.lag GROUP BY ALL"


def nw_sql(source: str, keys: str, grouped: bool = False) -> str:
    """keys, bw, n, mean, lrv."""
    bw = "least(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9.0::DOUBLE)), shortest - 1)"
    return f"SELECT {keys}, greatest(max({bw}), 0)::INT AS bw, max(n) AS n, max(mean) AS mean, greatest(sum(CASE WHEN lag = 0 THEN acov ELSE 2 * (1 - lag / ({bw} + 1.0::DOUBLE)) * acov END), 0.0::DOUBLE) AS lrv FROM ({acov_sql(source, keys, bw, grouped)}) GROUP BY {keys}"


def dm_sql(source: str, keys: str, grouped: bool = False) -> str:
    """keys, bw, n, lrv, dm, pvalue."""
    return f"SELECT *, {t_sql('dm', '(n - 1)')} AS pvalue FROM (SELECT *, CASE WHEN lrv > 1e-24 * greatest(mean * mean, 1e-12) THEN mean / sqrt(lrv / n) * sqrt(greatest((n + 1 - 2 * (bw + 1) + (bw + 1) * bw / n::DOUBLE) / n, 1e-12)) END AS dm FROM ({nw_sql(source, keys, grouped)}))"


def t_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t with whole degrees of freedom, its coefficients from gamma functions."""
    theta = f"atan(abs({t}) / sqrt({df}::DOUBLE))"
    odd = f"list_sum(list_transform(range(0, (({df} - 3) // 2)::BIGINT + 1), lambda k: exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow(cos({theta}), 2.0::DOUBLE * k)))"
    even = f"list_sum(list_transform(range(0, (({df} - 2) // 2)::BIGINT + 1), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow(cos({theta}), 2.0::DOUBLE * k)))"
    return f"CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {df} = 1 THEN 1 - 2 / pi() * {theta} WHEN {df} % 2 = 1 THEN greatest(0, 1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd})) ELSE greatest(0, 1 - sin({theta}) * {even}) END"


def chi2_sql(x: str) -> str:
    """Tail of chi-squared with one degree of freedom, by the series of erf with gamma functions."""
    z = f"sqrt(greatest({x}, 0.0::DOUBLE) / 2)"
    return f"CASE WHEN {x} > 60 THEN 0.0::DOUBLE ELSE greatest(0, 1 - exp(-{z} * {z}) * list_sum(list_transform(range(0, 201), lambda k: pow({z}, 2.0::DOUBLE * k + 1) / exp(lgamma(k + 1.5::DOUBLE))))) END"


def block_sql(source: str, keys: str, grouped: bool = False) -> str:
    """keys, n, m, bandwidth, raw, block, capped by the automatic rule."""
    search = "greatest(least(shortest - 1, greatest(5, ceil(sqrt(n))) + 10), 1)"
    a = f"SELECT *, {search}::BIGINT AS search, max(CASE WHEN lag = 0 THEN acov END) OVER (PARTITION BY {keys}) AS at0 FROM ({acov_sql(source, keys, search, grouped)})"
    calm = f"SELECT *, min((abs(acov / nullif(at0, 0)) < 2 * sqrt(log10(n) / n))::INT) OVER (PARTITION BY {keys} ORDER BY lag ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS calm FROM ({a})"
    m = f"SELECT *, greatest(coalesce(min(CASE WHEN lag >= 1 AND calm = 1 THEN lag END) OVER (PARTITION BY {keys}) - 1, search), 1) AS m FROM ({calm})"
    band = f"SELECT *, least(2 * m, search) AS bandwidth FROM ({m})"
    taper = "CASE WHEN lag > bandwidth THEN 0 WHEN lag / bandwidth::DOUBLE <= 0.5 THEN 1 ELSE 2 * (1 - lag / bandwidth::DOUBLE) END"
    g = f"SELECT {keys}, max(n) AS n, max(m) AS m, max(bandwidth) AS bandwidth, max(shortest) AS shortest, max(at0) AS at0, max(abs(mean)) AS size, sum(2 * ({taper}) * lag * acov) AS g, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * ({taper}) * acov) AS level FROM ({band}) GROUP BY {keys}"
    raw = f"SELECT *, CASE WHEN n < 4 THEN NULL WHEN at0 <= pow(1e-12 * greatest(size, 1.0::DOUBLE), 2) OR level = 0 OR g = 0 THEN 1.0::DOUBLE ELSE pow(2 * g * g / (4.0::DOUBLE / 3 * level * level), 1.0::DOUBLE / 3) * pow(n::DOUBLE, 1.0::DOUBLE / 3) END AS raw FROM ({g})"
    return f"SELECT {keys}, n, m, bandwidth, raw, least(greatest(ceil(round(raw, 9)), 1), shortest)::INT AS block, raw > shortest AS capped FROM ({raw})"


def sizes_sql(source: str, keys: str, grouped: bool = False, fixed: int | None = None) -> str:
    """keys, block, raw, capped as a bootstrap takes them."""
    if fixed is None:
        return f"SELECT {keys}, coalesce(block, least(4, n))::INT AS block, raw, coalesce(capped, FALSE) AS capped FROM ({block_sql(source, keys, grouped)})"
    return f"SELECT {keys}, least({fixed}, min(own))::INT AS block, NULL::DOUBLE AS raw, FALSE AS capped FROM (SELECT {keys}, seg, count(*) AS own FROM ({source}) GROUP BY ALL) GROUP BY {keys}"


def means_sql(source: str, keys: str, sizes: str, samples: int, seed: int, stream: str = "") -> str:
    """keys, sample, mean of the moving-block bootstrap of source (keys, seg, date, diff); stream: the hash's keys, as SQL text."""
    pre = f"SELECT *, sum(diff) OVER (PARTITION BY {keys}, seg ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY {keys}, seg ORDER BY date) AS rn FROM ({source})"
    packed = f"SELECT {keys}, seg, count(*) AS n, list_concat([0.0::DOUBLE], list(cum ORDER BY rn)) AS cum FROM ({pre}) GROUP BY ALL"
    sized = f"SELECT *, greatest(least(block, n), 1) AS size FROM ({packed}) JOIN ({sizes}) USING ({keys})"
    blocks = f"SELECT *, unnest(range(0, ceil(n / size::DOUBLE)::BIGINT)) AS nth FROM (SELECT *, unnest(range(0, {samples})) AS sample FROM ({sized}))"
    starts = f"SELECT *, ('0x' || substr(md5('{seed}|block|' || {stream} sample || '|' || nth), 1, 8))::BIGINT % (n - size + 1) AS start, least(size, n - nth * size) AS take FROM ({blocks})"
    return f"SELECT {keys}, sample, sum(cum[start + take + 1] - cum[start + 1]) / sum(take) AS mean FROM ({starts}) GROUP BY {keys}, sample"


def ci_sql(source: str, keys: str, means: str) -> str:
    """keys, mean_diff, ci_low, median, ci_high, pvalue, p_better."""
    tail = "least(count(*) FILTER (round(mean - mean_diff, 12) <= round(mean_diff, 12)), count(*) FILTER (round(mean - mean_diff, 12) >= round(mean_diff, 12)))"
    return f"SELECT {keys}, max(mean_diff) AS mean_diff, 2 * max(mean_diff) - quantile_cont(mean, 0.975) AS ci_low, quantile_cont(mean, 0.5) AS median, 2 * max(mean_diff) - quantile_cont(mean, 0.025) AS ci_high, least(1.0::DOUBLE, 2 * ({tail} + 1) / (count(*) + 1)::DOUBLE) AS pvalue, avg((mean < 0)::INT::DOUBLE) AS p_better FROM ({means}) JOIN (SELECT {keys}, avg(diff) AS mean_diff FROM ({source}) GROUP BY {keys}) USING ({keys}) GROUP BY {keys}"


def holm_sql(source: str, family: str, order: str) -> str:
    """The rows of source with holm, from its pvalue."""
    return f"SELECT * EXCLUDE (rk, m, step), CASE WHEN pvalue IS NOT NULL THEN least(1.0::DOUBLE, step) END AS holm FROM (SELECT *, max((m - rk + 1) * pvalue) OVER (PARTITION BY {family} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS step FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY pvalue NULLS LAST, {order}) AS rk, count(pvalue) OVER (PARTITION BY {family}) AS m FROM ({source})))"


def elimination_sql(seen: str, means: str, models: int) -> str:
    """metric, model, left_at, pvalue, statistic of the range statistic's elimination, one step after the other.

    seen: metric, model, m; means: metric, model, sample, mean.
    """
    left, gone, steps = f"SELECT metric, model FROM ({seen})", [], []
    for k in range(1, models):
        own = f"SELECT * FROM ({left}) JOIN ({seen}) USING (metric, model) JOIN ({means}) USING (metric, model)"
        pair = f"SELECT a.metric, a.model AS i, b.model AS j, a.sample, a.m - b.m AS gap, a.mean - b.mean - a.m + b.m AS noise FROM ({own}) a JOIN ({own}) b ON a.metric = b.metric AND a.sample = b.sample AND a.model <> b.model"
        scaled = f"SELECT *, CASE WHEN sd > 0 THEN gap / sd ELSE 0 END AS t, CASE WHEN sd > 0 THEN abs(noise) / sd ELSE 0 END AS far FROM (SELECT *, sqrt(avg(noise * noise) OVER (PARTITION BY metric, i, j)) AS sd FROM ({pair}))"
        steps.append((f"p{k}", f"SELECT metric, (1 + count(*) FILTER (far >= top)) / (count(*) + 1)::DOUBLE AS p, max(top) AS statistic FROM (SELECT metric, sample, max(far) AS far, max(top) AS top FROM (SELECT *, max(abs(t)) OVER (PARTITION BY metric) AS top FROM ({scaled})) GROUP BY 1, 2) GROUP BY 1"))
        steps.append((f"w{k}", f"SELECT metric, arg_max(i, t) AS model FROM ({scaled}) GROUP BY 1"))
        gone.append(f"SELECT metric, model FROM w{k}")
        left = f"SELECT metric, model FROM ({seen}) WHERE (metric, model) NOT IN ({' UNION ALL '.join(gone)})"
    best = [f"greatest({', '.join(f'p{j}.p' for j in range(1, k + 1))})" if k > 1 else "p1.p" for k in range(1, models)]
    joins = lambda k: "".join(f" JOIN p{j} USING (metric)" for j in range(1, k + 1))
    rows = [f"SELECT metric, w{k}.model, {k} AS left_at, {best[k - 1]} AS pvalue, p{k}.statistic FROM w{k}{joins(k)}" for k in range(1, models)]
    rows.append(f"SELECT metric, model, {models} AS left_at, 1.0::DOUBLE AS pvalue, 0.0::DOUBLE AS statistic FROM ({left})")
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({q})' for n, q in steps)} {' UNION ALL '.join(rows)}"
