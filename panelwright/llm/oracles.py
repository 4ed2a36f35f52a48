"""DuckDB SQL of the queries that SQL can express."""

from .secret_scan import ACCESS, ASSIGN, HEX, OPAQUE

SPACE_SQL = r"[\x20\x09-\x0D]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP1 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


def spans_sql(kind_no: int, pattern: str, value: str, keep: str) -> str:
    """Spans of one kind by cutting each text at its matches."""
    return f"""
  SELECT doc_id, source, {kind_no} AS kind_no, begins AS start, begins + length(found) AS stop, {value} AS value
  FROM (
    SELECT doc_id, source, found, (sum(length(piece)) OVER w + coalesce(sum(length(found)) OVER p, 0))::BIGINT AS begins
    FROM (
      SELECT doc_id, source, unnest(range(len(found))) AS i,
             unnest(found) AS found, unnest(pieces[:len(found)]) AS piece
      FROM (SELECT doc_id, source, regexp_extract_all(text, {quoted(pattern)}) AS found,
                   regexp_split_to_array(text, {quoted(pattern)}) AS pieces FROM documents WHERE regexp_matches(text, {quoted(pattern)}))
    )
    WINDOW w AS (PARTITION BY doc_id ORDER BY i), p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) WHERE {keep}"""


OP2 = f"""
WITH spans AS (
{spans_sql(0, ASSIGN, f"regexp_extract(found, {quoted(ASSIGN)}, 2)", f"length(regexp_extract(found, {quoted(ASSIGN)}, 2)) >= 6")}
  UNION ALL
{spans_sql(1, ACCESS, "found", "true")}
  UNION ALL
{spans_sql(2, HEX, "found", "true")}
  UNION ALL
{spans_sql(3, OPAQUE, "found", "regexp_matches(found, '[0-9]') AND regexp_matches(found, '[a-z]') AND regexp_matches(found, '[A-Z]')")}
), owners AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT (source, doc_id)) AS n_repos FROM spans GROUP BY value
), judged AS (
  SELECT s.*, n_owners, n_repos >= 3 AND n_owners >= 2 AS example,
         ['assign', 'access', 'hex', 'opaque'][kind_no + 1] || ':' || start || ':' || stop AS line
  FROM spans s JOIN owners USING (value) WHERE kind_no < 3 OR n_owners = 1
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(line, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(line, ',' ORDER BY start, kind_no) AS spans,
         string_agg(CASE WHEN example THEN 'example' WHEN n_owners = 1 THEN 'live' ELSE 'shared' END, ',' ORDER BY start, kind_no) AS verdicts,
         count(*) FILTER (example) AS n_example, count(*) FILTER (n_owners = 1) AS n_single_owner
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_example, 0) AS n_example, coalesce(n_single_owner, 0) AS n_single_owner, coalesce(verdicts, '') AS verdicts
FROM documents LEFT JOIN by_doc USING (doc_id)
"""

OP6 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s WINDOW o AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, (total - cap_before)::DOUBLE * w >= cap::DOUBLE * (all_w - w_before) AS capped FROM r),
t AS (
  SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS cap_sum, coalesce(sum(w) FILTER (capped) OVER (), 0) AS w_sum FROM c
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (total - cap_sum)::DOUBLE * w / (all_w - w_sum)::DOUBLE END AS target FROM t
), b AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) END::BIGINT AS taken
FROM b
"""

TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}')) AS term FROM documents
), lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, total GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS k
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

COMPONENTS = "list_transform(range(1, 65), lambda i: {0})"


def cluster_sql() -> str:
    """Rounds as they are defined: all distances to all centroids."""
    assign = lambda r: f"""a{r} AS (SELECT * FROM (
  SELECT v.no, v.vec_id, v.x, c.no AS cluster, list_sum({COMPONENTS.format("(v.x[i] - c.x[i]) * (v.x[i] - c.x[i])")})::BIGINT AS distance
  FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.no ORDER BY distance, c.no) = 1)),"""  # noqa: E731
    moved = lambda r: f"""c{r + 1} AS (SELECT c.no, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT cluster, list(y ORDER BY i) AS x FROM (
    SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS y
    FROM (SELECT cluster, unnest(x) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.no),"""  # noqa: E731
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS (
  SELECT place - 1 AS no, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id), x) AS place FROM v) WHERE place <= 16
), {"".join(assign(r) + moved(r) for r in range(3))} {assign(3)}
s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a3) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 JOIN s USING (cluster) JOIN c3 c ON c.no = a3.cluster
"""


STRIP_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
OP13 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {STRIP_SQL}), {LOWER_SQL}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, i, line, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLES = {"op1_exact_dedup": OP1, "op2_secret_scan": OP2, "op6_warc_segments": OP6, "op10_mixing": OP10, "op11_ranked_search": OP11, "op12_clustering": cluster_sql(), "op13_line_dedup": OP13}
