"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from skein.llm import html_text, media, mixing, mtree, near_dups, ngram_join, periodic_runs, pieces, pii, token_counts, toxicity, turn_repair, warc


def queries() -> dict:
    return {
        "op1_html_extract": html_text.op1_html_extract,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
        "op5_mtree_topk": mtree.op5_mtree_topk,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_near_duplicates": near_dups.op8_near_duplicates,
        "op9_media_webp": media.op9_media_webp,
        "op10_piece_encode": pieces.op10_piece_encode,
        "op11_ngram_join": ngram_join.op11_ngram_join,
        "op12_turn_repair": turn_repair.op12_turn_repair,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""

NEAR_DUP_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w),
  x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id"""


def crc32_sql(key: str) -> str:
    """CRC-32 of an ASCII string, unsigned: DuckDB has no such function."""
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(range(8), lambda x, i: {step}, xor(c, ascii(b)::BIGINT))"
    return f"xor(list_reduce(string_split({key}, ''), lambda c, b: {byte}, 4294967295), 4294967295)"


PERIODIC_SQL = rf"""WITH d AS (SELECT doc_id, h % 10 = 0 AS hit, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT *, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents)),
  e AS (SELECT *, len(w) AS n, CASE WHEN hit AND len(w) > 0 THEN g % len(w) END AS a FROM d),
  f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
  t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM f),
  x AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS w FROM t),
  y AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.w = r.w AND r.i > l.i),
  z AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM y),
  s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM z GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
  r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
  o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
  b AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.doc_id = a.doc_id AND (c.length * a.period > a.length * c.period
    OR c.length * a.period = a.length * c.period AND (c.start, c.period) < (a.start, a.period)))),
  g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _turn_sql() -> str:
    """States are strings: six digits of cost, then the audit; a kept system row is J until the end."""

    def more(state: str, cost: str, letter: str) -> str:
        return f"lpad((left({state}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{letter}'"

    def when(test: str, *options: str) -> str:
        return f"CASE WHEN {test} THEN least({', '.join(options)}) END"

    kept = {s: more(s, "t", "K") for s in ("e0", "e1", "e2", "e3")}
    role = {s: more(s, "3 + t", "R") for s in ("e0", "e1", "e2", "e3")}
    deleted = [more(f"e{i}", "4", "D") for i in range(4)]
    x1 = f"least({deleted[1]}, {when("NOT gone AND i = 's'", more('e0', 't', 'J'), 'NULL')})"
    x2 = f"least({deleted[2]}, {when("NOT gone AND i = 'u'", kept['e0'], kept['e1'], kept['e3'])}, {when('NOT gone', role['e0'], role['e1'], role['e3'])})"
    x3 = f"least({deleted[3]}, {when("NOT gone AND i = 'a'", kept['e2'], 'NULL')}, {when('NOT gone', role['e2'], 'NULL')})"
    y2 = f"least(x2, {more('x0', '3', 'I')}, {more('x1', '3', 'I')}, {more('x3', '3', 'I')})"
    space = r"[^\x20\x09-\x0D]"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
  d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
  o AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
  p AS (SELECT *, NOT regexp_matches(text, '{space}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
  q AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN open THEN 3 ELSE 0 END AS t FROM p),
  r(conv_id, k, e0, e1, e2, e3) AS (SELECT DISTINCT conv_id, 0::BIGINT, '000000', NULL::VARCHAR, '000003I', '000006II' FROM q UNION ALL
    SELECT conv_id, k, x0, x1, y2, least(x3, {more("y2", "3", "I")}) FROM (SELECT *, {y2} AS y2 FROM (SELECT q.conv_id, q.k, {deleted[0]} AS x0, {x1} AS x1, {x2} AS x2, {x3} AS x3
      FROM r JOIN q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND q.k = r.k + 1))),
  b AS MATERIALIZED (SELECT conv_id, left(e, 6)::BIGINT AS cost, substr(e, 7) AS audit FROM (SELECT conv_id, least(max_by(e0, k), max_by(e3, k)) AS e FROM (SELECT conv_id, coalesce(e0, '9') AS e0, coalesce(e3, '9') AS e3, k FROM r) GROUP BY conv_id)),
  l AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS pos FROM b WHERE audit <> ''),
  m AS (SELECT *, sum(CASE WHEN x <> 'I' THEN 1 ELSE 0 END) OVER w AS k, sum(CASE WHEN x NOT IN ('D', 'J') THEN 1 ELSE 0 END) OVER w AS out
    FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
  n AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN x IN ('J', 'K') THEN q.role WHEN out % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE q.text END, chr(10) ORDER BY pos)) AS h
    FROM m LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM m.conv_id AND q.k = m.k WHERE x <> 'D' GROUP BY m.conv_id),
  s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT gone) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, translate(coalesce(audit, ''), 'J', 'K') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id"""


NGRAM_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS s FROM w),
  x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id"""


def oracle_sql() -> dict:
    return {"op11_ngram_join": NGRAM_SQL, "op12_turn_repair": _turn_sql(), "op13_periodic_runs": PERIODIC_SQL, "op5_mtree_topk": TOP_K_SQL, "op6_warc": WARC_SQL, "op8_near_duplicates": NEAR_DUP_SQL}
