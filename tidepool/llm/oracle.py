"""DuckDB SQL for the operators that SQL can express."""

ORACLE = {
    "op2_mixing": r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM rows_ GROUP BY source),
fill(step, source, source_size, weight, target, closed) AS (
  SELECT 0, source, source_size, weight, 0.0::DOUBLE, false FROM sources
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         CASE WHEN closed OR level * weight >= 2 * source_size THEN 2.0 * source_size ELSE level * weight END,
         closed OR level * weight >= 2 * source_size
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (closed) OVER (), 0))
                  / sum(weight) FILTER (NOT closed) OVER () AS level FROM fill)
  WHERE step <= (SELECT count(*) FROM sources)),
goals AS (SELECT source, source_size, target FROM fill WHERE step = (SELECT max(step) FROM fill)),
placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         (sum(r.size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size) - r.size)::BIGINT AS start
  FROM rows_ r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) END::BIGINT AS taken
FROM placed""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_chat": r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS pos, content
  FROM (SELECT *, md5(coalesce('+' || role, '-') || chr(31) || coalesce('+' || text, '-')) AS content FROM conversations)
  WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list(content ORDER BY pos) AS turns FROM t GROUP BY conv_id),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, md5(array_to_string(turns, ',')) AS h FROM c GROUP BY n_turns, turns),
prefixes AS (SELECT DISTINCT md5(array_to_string(turns[1:k], ',')) AS h
             FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
kept AS (SELECT conv_id, n_turns FROM whole WHERE h NOT IN (SELECT h FROM prefixes))
SELECT t.conv_id, kept.n_turns, (pos - 1) // 1000 AS part, count(*) AS part_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept ON kept.conv_id = t.conv_id GROUP BY ALL""",
    "op11_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
held AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
windows AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM held) ON len(w) >= n)),
hits AS MATERIALIZED (SELECT r, k, n, phrase FROM windows SEMI JOIN held USING (n, phrase)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits JOIN held USING (n, phrase) WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}


def _rounds(k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds, one pair of steps each: distances to all centroids, then means."""
    nearest = """
near{t} AS MATERIALIZED (
  SELECT row, min(struct_pack(distance, cluster)) AS best
  FROM (SELECT row, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
        FROM kept, c{t}) GROUP BY row)"""
    means = """
c{u} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{t} LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS m FROM (
      SELECT cluster, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
      FROM (SELECT best.cluster AS cluster, unnest(range(1, {dimension} + 1)) AS i, unnest(x) AS v FROM near{t} JOIN kept USING (row))
      GROUP BY cluster, i) GROUP BY cluster) USING (cluster))"""
    steps = [nearest.format(t=t) + ("," + means.format(t=t, u=t + 1, dimension=dimension) if t < rounds else "") for t in range(rounds + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dimension}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, x AS c FROM kept
  ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}),{",".join(steps)}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
       (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (row) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


ORACLE["op13_centroids"] = _rounds()
