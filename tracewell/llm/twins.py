"""SQL twins of the corpus queries that SQL can say."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
spots AS (
  SELECT doc_id, k, i, w[i:i + k - 1] AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM spots JOIN win USING (g)),
n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
  sha256(coalesce(ids.ids, '')) AS items_sha256,
  coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit ON d.doc_id = n_hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""


def mixing(rounds: int = 3) -> str:
    parts = [
        r"""
WITH u0 AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
units AS (SELECT doc_id, source, size, draw, count(*) AS rows, size * count(*) AS words FROM u0 GROUP BY doc_id, source, size, draw),
known AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size, sum(size / (size + 100.0::DOUBLE) * rows) AS liking, sum(rows) AS docs
  FROM units GROUP BY source),
dealt AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM known),
full_ AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS total,
    cap * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) < (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0)) * w AS f
  FROM dealt WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT *, CASE WHEN f THEN cap ELSE (total - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN f THEN 0 ELSE w END) OVER () END AS target
  FROM full_),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM goal),
quota AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS quota FROM plan),
odds AS (
  SELECT u.*, q.source_size, q.target, q.whole, q.quota, (CAST('0x' || substr(draw, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS x,
    least(CAST(q.quota AS DOUBLE) / q.source_size * (size / (size + 100.0::DOUBLE)) / (q.liking / q.docs), 1 - 1e-9::DOUBLE) AS p
  FROM units u JOIN quota q ON u.source IS NOT DISTINCT FROM q.source),
r0 AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS id, CASE WHEN quota > 0 AND size > 0 THEN (x / (1 - x)) / (p / (1 - p)) END AS rank,
    FALSE AS taken, quota AS gap FROM odds)"""
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"""
f{k} AS (SELECT *, NOT taken AND rank IS NOT NULL AND words <= gap AS fits FROM r{k - 1}),
c{k} AS (SELECT *, sum(CASE WHEN fits THEN words END) OVER (PARTITION BY source ORDER BY rank, draw, id ROWS UNBOUNDED PRECEDING) AS run FROM f{k}),
r{k} AS (
  SELECT * EXCLUDE (fits, run, taken, gap), taken OR (fits AND run <= gap) AS taken,
    gap - coalesce(max(CASE WHEN fits AND run <= gap THEN run END) OVER (PARTITION BY source), 0) AS gap FROM c{k})"""
        )
    parts.append(
        f"""
near AS (
  SELECT *, row_number() OVER (PARTITION BY source, NOT taken AND rank IS NOT NULL AND abs(words - gap) < gap
    ORDER BY abs(words - gap), rank, draw, doc_id) = 1 AND NOT taken AND rank IS NOT NULL AND abs(words - gap) < gap AS closes FROM r{rounds}),
done AS (SELECT *, size * least(CASE WHEN size > 0 THEN whole + CASE WHEN taken OR closes THEN 1 ELSE 0 END ELSE 0 END, 3) AS t FROM near)
SELECT doc_id, size, source_size, target, CAST(t AS BIGINT) AS taken FROM (SELECT *, unnest(range(rows)) AS i FROM done)
"""
    )
    return ",".join(parts)


def clustering(rounds: int = 5, clusters: int = 40) -> str:
    """Every round measures all vectors against all centroids."""
    parts = [
        rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS cluster, x
  FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters})"""
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""
a{k} AS MATERIALIZED (
  SELECT r, vec_id, v.x, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS distance
  FROM v, c{k} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
        )
        if k < rounds:
            parts.append(
                f"""
m{k} AS (
  SELECT cluster, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(x) AS y, unnest(range(64)) AS j FROM a{k}) GROUP BY cluster, j),
n{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n USING (cluster))"""
            )
    parts.append(
        f"""
last AS (SELECT cluster, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN last ON a.cluster = last.cluster
"""
    )
    return ",".join(parts)


RESAMPLING = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
words AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN words USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN words USING (w) GROUP BY bucket),
total AS (
  SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS sa, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS ta),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sa + 10000) / ((s::DOUBLE + 1) * (ta + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), total),
weight AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN words USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND score IS NOT NULL AND place <= drawn THEN CAST(place AS BIGINT) END AS rank FROM ranked
"""


SQL = {
    "op4_mixing": mixing(),
    "op6_decontaminate": DECONTAMINATE,
    "op9_top_k": TOP_K,
    "op10_jaccard_join": JACCARD,
    "op12_clustering": clustering(),
    "op13_resampling": RESAMPLING,
}
