"""SQL counterparts of the registered queries, for engines that read the same tables."""

from __future__ import annotations

from gaugeworks.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"


def _round(n: int) -> str:
    """Assignment to the centroids ``c{n}`` and the centroids that follow from it."""
    return f"""
    far{n} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM numbers v JOIN c{n} c USING (place) GROUP BY v.row, c.cluster),
    near{n} AS (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{n} GROUP BY row),
    c{n + 1} AS (
      SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
        SELECT cluster, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS x
        FROM (SELECT cluster, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM numbers JOIN near{n} USING (row) GROUP BY cluster, place)
      ) m USING (cluster, place)),"""


CENTROIDS = f"""
    WITH kept AS (
      SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    numbers AS (SELECT row, p AS place, floor(64 * embedding[p]::DOUBLE)::BIGINT AS x FROM kept, range(1, 65) r(p)),
    seeds AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept QUALIFY cluster < 16),
    c0 AS (SELECT cluster, place, x FROM seeds JOIN numbers USING (row)),
    {"".join(_round(n) for n in range(4))}
    final AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c3 GROUP BY cluster)
    SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
      sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM kept JOIN near3 USING (row) JOIN final USING (cluster)"""

MIXING = f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, {mixing.HASH_BITS // 4}))::BIGINT AS place
      FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
      FROM sized GROUP BY source),
    -- Sources fill up in the order of size to weight; the level is that of the first source that it does not fill.
    filled AS (
      SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, coalesce(sum(2.0::DOUBLE * source_size) OVER fuller, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER fuller, 0) AS rest
      FROM sources WINDOW fuller AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
      SELECT (total - given) / rest AS level FROM filled WHERE (total - given) / rest * weight <= 2 * source_size
      ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
    targets AS (SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target FROM sources, level),
    laid AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
    SELECT doc_id, size::BIGINT AS size, source_size, target, l.source,
      (greatest(least(floor(target) - start, size), 0) + greatest(least(floor(target) - source_size - start, size), 0))::BIGINT AS taken
    FROM laid l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source"""

ORACLES: dict[str, str] = {
    "op11_centroid_clustering": CENTROIDS,
    "op12_source_mixing": MIXING,
}
