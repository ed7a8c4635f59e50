"""DuckDB SQL for the registered queries that SQL can express."""

OP2_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM per_source),
-- A source is capped if all sources with a smaller cap per weight leave it more than its cap.
ranked AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE AS full_before,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left, sum(source_size) OVER () AS total
  FROM weighted
  WINDOW o AS (ORDER BY 2 * source_size / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
capped AS (SELECT *, (1.5::DOUBLE * total - full_before) * w / w_left > 2 * source_size AS over_cap FROM ranked),
open_sum AS (
  SELECT coalesce(sum(2 * source_size) FILTER (WHERE over_cap), 0)::DOUBLE AS full_sum, sum(w) FILTER (WHERE NOT over_cap) AS w_open FROM capped),
targets AS (
  SELECT source, source_size,
         CASE WHEN over_cap THEN (2 * source_size)::DOUBLE ELSE (1.5::DOUBLE * total - full_sum) * w / w_open END AS target
  FROM capped, open_sum),
quota AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS q FROM targets),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN q % source_size ELSE 0 END AS rest FROM quota),
ordered AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || s.doc_id), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM ordered
"""

OP7_URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
judged AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN (contains(host, 'cheap-pills') OR contains(host, 'casino')) AND starts_with(path, '/') THEN 'block'
            WHEN regexp_matches(path, '/[^/]*\.exe$') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP4_CHAT = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n,
         '[' || coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS mark,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM turns),
prefixes AS (
  SELECT conv_id, place, n, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far
  FROM placed),
whole AS (SELECT so_far, min(conv_id) AS conv_id, count(*) AS n_equal FROM prefixes WHERE place = n GROUP BY so_far),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.n AND p.so_far = w.so_far))
SELECT p.conv_id, count(*) AS n_turns, k.n_equal, string_agg(p.line, '' ORDER BY p.place) AS rendered
FROM placed p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY p.conv_id, k.n_equal
"""

OP6_TOP_K = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.row <> c.row WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP11_HARD_NEGATIVES = """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.row AS anchor_row, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.row <> c.row WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_row, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST))::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_row = n.anchor_row AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def clustering(clusters: int = 40, rounds: int = 5) -> str:
    """Each round is a table of its own: all distances, the nearest, the new centroids."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {clusters})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT k.row, k.vec_id, k.v, c.cluster, (list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS distance
  FROM kept k, c{i} c QUALIFY row_number() OVER (PARTITION BY k.row ORDER BY distance, c.cluster) = 1)""")
        if i < rounds:
            steps.append(f"""sums{i} AS (
  SELECT cluster, place, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY ALL)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY place) AS v FROM sums{i} GROUP BY cluster) m USING (cluster))""")
    last = f"""SELECT n.vec_id, n.cluster::INTEGER AS cluster, n.distance, (sum(n.distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia, (sum(n.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM near{rounds} n JOIN c{rounds} c USING (cluster)"""
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLES = {"op2_mixing": OP2_MIXING, "op4_chat": OP4_CHAT, "op6_top_k": OP6_TOP_K, "op7_url_filter": OP7_URL_FILTER, "op11_hard_negatives": OP11_HARD_NEGATIVES, "op12_centroids": clustering()}
