"""Oracle SQL (DuckDB) of the text operators that SQL can express."""

_RULES = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice CROSS JOIN range(0, 5) r(d) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT t.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS fails FROM b GROUP BY source),
m AS (SELECT avg(fails / n::DOUBLE) AS mean, var_pop(fails / n::DOUBLE) AS var, avg(1.0::DOUBLE / n) AS inv FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-9) - 1, 1), 1e6) AS weight FROM m),
rates AS (SELECT source, (fails + mean * weight) / (n + weight) AS rate FROM h CROSS JOIN p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
"""

_JACCARD = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN edges ON r = a)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_LEAKS = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM t CROSS JOIN (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, item, a, d.k FROM d JOIN win ON d.k = win.k AND d.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM (SELECT DISTINCT doc_id, a, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM t WHERE n >= 50)),
least_doc AS (SELECT s, min(doc_id) AS d FROM starts GROUP BY s),
gone AS (SELECT doc_id, p FROM starts JOIN least_doc USING (s) WHERE d < doc_id),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, (p - lag(p, 1, -99) OVER (PARTITION BY doc_id ORDER BY p) > 50)::INT AS fresh FROM gone)),
spans AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM islands GROUP BY doc_id, k),
edges AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM spans),
kept AS (SELECT doc_id, sum(e - b)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS k FROM edges JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
least_doc AS (SELECT text, min(doc_id) AS d FROM t GROUP BY text),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200,
     100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text),
     regexp_matches(t.text, '[#$%&*|]'),
     coalesce(t.doc_id > d, false)] AS fails
  FROM t JOIN least_doc USING (text) LEFT JOIN lab ON lab.doc_id = t.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
perms AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM l a, l b, l d, l e, l f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS filter, ascii(substr(filter_order, s, 1)) - 64 AS k FROM perms CROSS JOIN range(1, 6) r(s)),
firsts AS (SELECT part, filter_order, fails, n, good, toxic, coalesce(list_min(list_filter(range(1, 6), lambda s: fails[ascii(substr(filter_order, s, 1)) - 64])), 0) AS first FROM g CROSS JOIN perms),
cells AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (first = 0 OR first > step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails[k] AND first < step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (first = step), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (first = step), 0)::BIGINT AS toxic_lost
  FROM firsts JOIN steps USING (filter_order) GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM cells
"""


def _clusters(rounds: int) -> str:
    """Rounds of assignment as one chain of expressions: v are the vectors, c0 the starts."""
    steps = [
        """v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v)
  QUALIFY row_number() OVER (ORDER BY h) <= 16)""",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
        steps.append(f"""a{r} AS (
  SELECT vec_id, v, k, c, d FROM (SELECT vec_id, v, k, c, {distance} AS d FROM v CROSS JOIN c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) j(i) GROUP BY k, i)""")
            steps.append(f"""n{r} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY k)""")
            steps.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))")
    return (
        "WITH "
        + ",\n".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)
        + f"""
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds}
"""
    )


SQL: dict[str, str] = {"op1_ngram_jaccard_join": _JACCARD, "op4_benchmark_decontamination": _LEAKS, "op5_suffix_array_dedup": _REPEATS, "op7_quality_rules": _RULES, "op11_centroid_clustering": _clusters(3), "op13_filter_interaction_audit": _AUDIT}
