"""Queries of the composite retrieval and text-analytics operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.operators import chunk_udtf, clustering, embedding, evaluation, meetings, relations, retrieval, sentences, services
from skein.plans.registry import NOW, Tables, register
from skein.sources.shared import stored

TOK = r"regexp_extract_all(lower({}text), '[\p{{L}}\p{{M}}\p{{N}}]+')"
TOKENS = TOK.format("")

#: BM25 of queries ``q`` (query_id, text) over documents ``d`` (id, text), ranked.
BM25 = f"""n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, sum(coalesce(len({TOKENS}), 0)) / count(*)) AS a FROM d),
    k AS (SELECT id, len(toks) AS len, unnest(toks) AS term FROM (SELECT id, {TOKENS} AS toks FROM d)), p AS MATERIALIZED (SELECT id, term, any_value(len) AS len, count(*) AS tf FROM k GROUP BY id, term),
    f AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term), qt AS MATERIALIZED (SELECT DISTINCT query_id, unnest({TOKENS}) AS term FROM q),
    s AS (SELECT query_id, id, round(sum(ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / n.a))), 6) AS score FROM qt JOIN f USING (term) JOIN p USING (term), n GROUP BY query_id, id),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 20)"""
VECTOR = """v AS (SELECT q.query_id, d.id, round(list_inner_product(q.vector, d.vector), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_inner_product(q.vector, d.vector), 6) DESC, d.id) AS rank
    FROM q, d WHERE q.vector IS NOT NULL AND d.vector IS NOT NULL QUALIFY rank <= 20)"""
ASKED = "d AS (SELECT * FROM corpus), q AS (SELECT id AS query_id, text, vector FROM corpus WHERE id % 100 = 0)"
FUSED = """u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(seen) AS first_seen FROM (SELECT query_id, id, rank, rank AS seen FROM v UNION ALL SELECT query_id, id, rank, 1000000 + rank FROM w) GROUP BY query_id, id)"""
ADJUSTED = f"""a AS (SELECT u.query_id, u.id, round(fused + 0.004::DOUBLE * exp(-greatest(0.0::DOUBLE, ({NOW} - d.created) / 86400.0::DOUBLE) / 45.0::DOUBLE)
    + 0.004::DOUBLE * least(1.0::DOUBLE, len(list_intersect(list_distinct({TOK.format('q.')}), {TOK.format('d.')})) / len(list_distinct({TOK.format('q.')}))::DOUBLE), 9) AS adjusted
    FROM u JOIN d USING (id) JOIN q USING (query_id))"""


def mmr_sql(pool: str, k: int = 6) -> str:
    """CTEs that diversify ``pool`` (query_id, place, id, vector, qv): picked (query_id, id, position).

    A greedy fold over k steps; members without a vector fill up, and with fewer than two vectors the pool's order stands.
    """
    return f"""m0 AS (SELECT query_id, list(id ORDER BY place) AS ids, list(vector ORDER BY place) AS vs, any_value(qv) AS qv FROM {pool} GROUP BY query_id),
    m1 AS (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: vs[i] IS NOT NULL AND qv IS NOT NULL AND len(vs[i]) = len(qv)) AS u FROM m0),
    m2 AS (SELECT *, list_reduce(list_transform(range({k + 1}), lambda i: []::BIGINT[]), lambda a, x: CASE WHEN len(a) >= len(u) THEN a ELSE list_append(a, -list_max(list_transform(list_filter(u, lambda c: NOT list_contains(a, c)),
        lambda c: {{'v': 0.7::DOUBLE * list_inner_product(qv, vs[c]) - (1 - 0.7::DOUBLE) * greatest(0.0::DOUBLE, coalesce(list_max(list_transform(a, lambda p: list_inner_product(vs[c], vs[p]))), 0.0::DOUBLE)), 'c': -c}})).c) END) AS a FROM m1),
    m3 AS (SELECT query_id, CASE WHEN len(u) < 2 THEN ids ELSE list_concat(list_transform(a, lambda p: ids[p]), list_filter(ids, lambda i: NOT list_contains(list_transform(a, lambda p: ids[p]), i))) END[1:{k}] AS r FROM m2),
    picked AS (SELECT query_id, unnest(r) AS id, unnest(range(1, len(r) + 1)) AS position FROM m3)"""


POOL = "pl AS (SELECT query_id, rank AS place, v.id, d.vector, q.vector AS qv FROM v JOIN d USING (id) JOIN q USING (query_id) WHERE rank <= 12)"
HYBRID = f"""{ASKED}, {BM25}, {VECTOR}, {FUSED}, {ADJUSTED},
    pl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, a.id) AS place, a.id, d.vector, q.vector AS qv FROM a JOIN d USING (id) JOIN q USING (query_id) QUALIFY place <= 12), {mmr_sql('pl')}"""
#: Greedy clustering: sums of members and cluster numbers, folded over a group's vectors ``u`` in order.
CLUSTER = """list_reduce(u, lambda a, x: CASE WHEN list_max(list_transform(a.s, lambda c: list_inner_product(list_transform(c, lambda e: e / sqrt(list_inner_product(c, c))), x.s[1]))) >= {0} THEN
        {{'s': list_transform(a.s, lambda c, i: CASE WHEN i = list_max(list_transform(list_transform(a.s, lambda c, j: {{'v': list_inner_product(list_transform(c, lambda e: e / sqrt(list_inner_product(c, c))), x.s[1]), 'j': j}}), lambda y: y)).j
            THEN list_transform(c, lambda e, j: e + x.s[1][j]) ELSE c END),
          'o': list_append(a.o, list_max(list_transform(a.s, lambda c, j: {{'v': list_inner_product(list_transform(c, lambda e: e / sqrt(list_inner_product(c, c))), x.s[1]), 'j': j}})).j - 1)}}
        ELSE {{'s': list_append(a.s, x.s[1]), 'o': list_append(a.o, len(a.s))}} END).o"""
#: Window sizes of sessions of conversations, at {0} tokens a window, and (session_id, window, size).
WINDOWS = r"""g AS (SELECT conv_id, turn, ceil(length(text) * 2 / 7.0) > {0} AS big, text FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
    p AS (SELECT conv_id, turn, big, unnest(CASE WHEN big THEN string_split(text, '. ') ELSE [text] END) AS x, unnest(CASE WHEN big THEN range(len(string_split(text, '. '))) ELSE [0] END) AS i FROM g),
    w0 AS (SELECT conv_id, list([{{'k': CASE WHEN big THEN turn ELSE -1 END, 'used': ceil(length(x) * 2 / 7.0)::BIGINT, 'size': length(x)}}] ORDER BY turn, i) AS u FROM p GROUP BY conv_id),
    w1 AS (SELECT conv_id, list_reduce(u, lambda a, x: CASE WHEN a[-1].k = x[1].k AND a[-1].used + x[1].used <= {0}
        THEN list_append(list_slice(a, 1, len(a) - 1), {{'k': a[-1].k, 'used': a[-1].used + x[1].used, 'size': a[-1].size + x[1].size + CASE WHEN a[-1].k < 0 THEN 1 ELSE 2 END}}) ELSE list_append(a, x[1]) END) AS a FROM w0),
    w AS (SELECT conv_id AS session_id, unnest(range(len(a))) AS "window", unnest(list_transform(a, lambda x: x.size)) AS size FROM w1)"""


@register("ir_1_bm25_topk", f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), d AS (SELECT doc_id AS id, text FROM documents), {BM25} SELECT query_id, id, score, rank::BIGINT AS rank FROM w")
def _(t: Tables) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(queries, t.docs.select("id", "text")).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register("ir_2_vector_topk", "WITH q AS (SELECT id AS query_id, vector FROM vectors WHERE id % 100 = 0), d AS (SELECT * FROM vectors), " + VECTOR + " SELECT query_id, id, score, rank::BIGINT AS rank FROM v", "vectors")
def _(t):
    q = t.vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return retrieval.vector_top_k(q, t.vectors).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def _fused(t):
    docs = t.corpus
    return retrieval.reciprocal_rank_fusion([retrieval.vector_top_k(t.asked, docs), retrieval.bm25(t.asked, docs)])


@register("ir_3_rrf", f"WITH {ASKED}, {BM25}, {VECTOR}, {FUSED} SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_seen)::BIGINT AS place FROM u", "corpus")
def _(t):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "first_seen"))
    return _fused(t).select("query_id", "id", "fused", place.cast("long").alias("place"))


@register("ir_4_priors", f"WITH {ASKED}, {BM25}, {VECTOR}, {FUSED}, {ADJUSTED} SELECT query_id, id, round(adjusted, 7) AS adjusted FROM a", "corpus")
def _(t):
    words, known = retrieval.bm25_shared(t.asked, t.corpus)
    words = stored(words, "by-words")
    fused = stored(retrieval.reciprocal_rank_fusion([retrieval.vector_top_k(t.asked, t.corpus), words]), "fused")
    adjusted = retrieval.adjust(fused, t.corpus, t.asked, NOW, words, known)
    return adjusted.select("query_id", "id", F.round("adjusted", 7).alias("adjusted"))


def _pools(t, size=12):
    ranked = retrieval.vector_top_k(t.asked, t.corpus, size)
    rows = ranked.select("query_id", F.col("rank").alias("place"), "id").join(t.corpus.select("id", "vector"), "id")
    return rows.join(t.asked.select("query_id", F.col("vector").alias("query_vector")), "query_id")


@register("ir_5_mmr", f"WITH {ASKED}, {VECTOR}, {POOL}, {mmr_sql('pl')} SELECT * FROM picked", "corpus")
def _(t):
    return retrieval.mmr(_pools(t), 6)


@register("ir_6_mmr_order", f"WITH {ASKED}, {VECTOR}, {POOL}, pt AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN vector END AS vector) FROM pl), {mmr_sql('pt')} SELECT * FROM picked", "corpus")
def _(t):
    """Only every third pool member has a vector: the rest fills up."""
    return retrieval.mmr(_pools(t).withColumn("vector", F.when(F.col("id") % 3 == 0, F.col("vector"))), 6)


@register("ir_7_hybrid", f"WITH {HYBRID} SELECT query_id, id, position, round(adjusted, 6) AS score FROM picked JOIN a USING (query_id, id)", "corpus")
def _(t):
    return retrieval.hybrid(t.asked, t.corpus, NOW)


@register("ir_7_hybrid_expanded", f"""WITH {ASKED}, {BM25}, {VECTOR}, z AS (SELECT query_id, d.id, row_number() OVER (PARTITION BY query_id ORDER BY d.id) AS rank FROM q, d WHERE q.vector IS NOT NULL AND d.vector IS NOT NULL QUALIFY rank <= 20),
    r AS (SELECT query_id, id, rank, 1 AS times FROM z UNION ALL SELECT query_id, id, rank, 2 FROM v UNION ALL SELECT query_id, id, rank, 2 FROM w),
    u AS (SELECT query_id, id, round(sum(times / (60.0::DOUBLE + rank)), 9) AS fused FROM r GROUP BY query_id, id),
    a AS (SELECT query_id, u.id, round(fused + 0.004::DOUBLE * exp(-greatest(0.0::DOUBLE, ({NOW} - d.created) / 86400.0::DOUBLE) / 45.0::DOUBLE), 9) AS adjusted FROM u JOIN d USING (id)),
    pl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, a.id) AS place, a.id, d.vector, list_transform(q.vector, lambda x: x * 0) AS qv FROM a JOIN d USING (id) JOIN q USING (query_id) QUALIFY place <= 12), {mmr_sql('pl')}
    SELECT query_id, id, position, round(adjusted, 6) AS score FROM picked JOIN a USING (query_id, id)""", "corpus")
def _(t):
    """Questions in words that no document has are weak and fall back on two paraphrases each."""
    weak = t.asked.select("query_id", F.lit("zzyzx qwrtp").alias("text"), F.transform("vector", lambda x: x * F.lit(0.0).cast("float")).alias("vector"))
    alternatives = t.asked.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("alt_no"), "text", "vector")
    return retrieval.hybrid(weak, t.corpus, NOW, expansions=alternatives)


@register("ir_8_chunk_documents")
def _(t):
    chunks = sentences.chunk_documents(t.docs.select("id", "text", F.array(F.lit(0), F.lit(1000), F.lit(5000)).alias("page_breaks")))
    return chunks.select("id", "chunk_index", "words", "page_number", F.md5("text").alias("text_md5"))


@register("ir_9_chunk_sessions")
def _(t):
    return sentences.chunk_sessions(t.segments.select("session_id", "start", "text")).select("session_id", "chunk_index", "words", "timestamp", F.md5("text").alias("text_md5"))


@register("ir_10_index_build")
def _(t):
    return embedding.index_documents(t.docs.select("id", "text")).select("id", "chunk_index", "words", F.size("vector").alias("dim"))


@register("ir_11_embed")
def _(t):
    made = embedding.embed(t.docs.select("id", "text"))
    return made.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squared"))


@register("ir_12_cluster", f"""WITH c AS (SELECT label, list(id ORDER BY id::VARCHAR) AS ids, list({{'s': [vector], 'o': [0::BIGINT]}} ORDER BY id::VARCHAR) AS u FROM vectors GROUP BY label), o AS (SELECT ids, {CLUSTER.format(0.2)} AS o FROM c)
    SELECT unnest(ids) AS id, unnest(o) AS cluster FROM o""", "vectors")
def _(t):
    return clustering.cluster(t.vectors.select(F.col("label").alias("grp"), "id", "vector"), 0.2)


@register("ir_13_grouping", f"""WITH x AS (SELECT id % 40 AS session, unnest(vector) AS e, unnest(range(len(vector))) AS i FROM vectors), y AS (SELECT session, i, avg(e) AS e FROM x GROUP BY session, i), m AS (SELECT session, list(e ORDER BY i) AS m FROM y GROUP BY session),
    n AS (SELECT session, list_transform(m, lambda e: e / sqrt(list_inner_product(m, m))) AS v FROM m), c AS (SELECT session % 5 AS owner, list(session ORDER BY session::VARCHAR) AS ids, list({{'s': [v], 'o': [0::BIGINT]}} ORDER BY session::VARCHAR) AS u FROM n GROUP BY 1),
    o AS (SELECT owner, unnest(ids) AS id, unnest(o) AS k FROM (SELECT owner, ids, {CLUSTER.format(0.1)} AS o FROM c)), g AS (SELECT id, owner * 1000 + k AS cluster, CASE WHEN id % 9 = 0 THEN 'tag' || id END AS tag FROM o),
    f AS (SELECT cluster, min_by(tag, id::VARCHAR) FILTER (WHERE tag IS NOT NULL) AS known FROM g GROUP BY cluster)
    SELECT id, cluster, coalesce(tag, known, CASE WHEN cluster % 2 = 0 THEN 'Meeting' END, 'General') AS tag FROM g JOIN f USING (cluster)""", "vectors")
def _(t):
    """Each owner's sessions (an owner is the id modulo 5) are clustered on their own."""
    sessions = clustering.mean_vectors(t.vectors.select((F.col("id") % 40).alias("session"), "vector"), "session")
    owner = F.col("id") % 5
    clusters = clustering.cluster(sessions.select((F.col("session") % 5).alias("grp"), F.col("session").alias("id"), "vector"), 0.1)
    clusters = clusters.select("id", (owner * 1000 + F.col("cluster")).alias("cluster"))
    members = clusters.withColumn("tag", F.when(F.col("id") % 9 == 0, F.concat(F.lit("tag"), F.col("id").cast("string"))))
    named = services.classify(clusters.select("cluster").distinct().select("cluster", F.when(F.col("cluster") % 2 == 0, "a meeting").alias("text")), lambda instructions, prompt: " Meeting ")
    return clustering.group_names(members, named)


@register("ir_14_continuity", """WITH p AS (SELECT a.id, b.id AS prior_id, round(list_inner_product(a.vector, b.vector), 6) AS cosine FROM vectors a JOIN vectors b ON a.label = b.label AND b.id < a.id WHERE b.id % 2 = 0)
    SELECT id, prior_id, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, prior_id)::BIGINT AS rank FROM p WHERE cosine >= 0.2 QUALIFY rank <= 3""", "vectors")
def _(t):
    rows = t.vectors.select(F.col("label").alias("grp"), "id", F.col("id").alias("created"), "vector")
    found = clustering.continuity(rows, rows.filter("id % 2 = 0"), 0.2, 3)
    return found.select("id", "prior_id", "cosine", F.col("rank").cast("long").alias("rank"))


def _turns(t):
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("double").alias("start"), "text")


@register("ir_15_window_plan", f"""WITH {WINDOWS.format(100)} SELECT session_id, "window", ceil(size * 2 / 7.0)::BIGINT AS tokens, size AS n_chars FROM w""")
def _(t):
    return meetings.window_plan(_turns(t), 100)


@register("ir_16_summary_plan", f"""WITH RECURSIVE {WINDOWS.format(100)}, s AS (SELECT session_id, count(*) AS n, sum(ceil(size * 2 / 7.0))::BIGINT AS total FROM w GROUP BY session_id HAVING sum(ceil(size * 2 / 7.0)) >= 15),
    r AS (SELECT session_id, 0 AS level, n FROM s WHERE n > 1 UNION ALL SELECT session_id, level + 1, (n + 6) // 7 FROM r WHERE n > 7),
    m AS (SELECT session_id, 'merge' || level AS stage, unnest(range((n + 6) // 7)) AS number, n FROM r WHERE n > 7)
    SELECT session_id, 'reduce' AS stage, 0 AS number, total AS tokens FROM s WHERE n = 1
    UNION ALL SELECT session_id, 'map', "window", ceil(size * 2 / 7.0)::BIGINT FROM w JOIN s USING (session_id) WHERE n > 1
    UNION ALL SELECT session_id, stage, number, 300 * least(7, n - 7 * number) FROM m
    UNION ALL SELECT session_id, 'reduce', 0, 300 * n FROM r WHERE n <= 7""")
def _(t):
    return meetings.summary_plan(_turns(t), 100)


@register("ir_17_context", f"""WITH {HYBRID}, kk AS (SELECT query_id, position, text, sum(ceil(length(text) / 3.5)) OVER (PARTITION BY query_id ORDER BY position) AS used, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n
    FROM picked JOIN d USING (id))
    SELECT query_id, md5(string_agg('[' || n || '] ' || text, chr(10) || chr(10) ORDER BY position)) AS context_md5, count(*) AS passages FROM kk WHERE used <= 2300 OR n = 1 GROUP BY query_id""", "corpus")
def _(t):
    picked = retrieval.hybrid(t.asked, t.corpus, NOW, 6).join(t.corpus.select("id", "text"), "id")
    packed = retrieval.pack_budget(picked, "query_id", [F.col("position")], text.token_estimate(F.col("text")), 2300, force_first=True)
    numbered = packed.withColumn("passage", text.numbered(F.col("place"), F.col("text")))
    joined = numbered.groupBy("query_id").agg(F.expr("listagg(passage, '\\n\\n') WITHIN GROUP (ORDER BY position)").alias("context"), F.count("*").alias("passages"))
    return joined.select("query_id", F.md5("context").alias("context_md5"), "passages")


@register("ir_18_answers", """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'retrievalOnly:tierB' WHEN value > 30 AND event_id % 2 = 0 THEN 'retrievalOnly:contextOverflow' WHEN value <= 30 AND event_type = 'error' THEN 'retrievalOnly:generationFailed'
    WHEN event_id % 3 = 0 AND event_id % 5 > 0 THEN 'grounded' ELSE 'conversational' END AS result, CASE WHEN event_id % 5 = 4 THEN 3 ELSE event_id % 5 END AS passages FROM events""")
def _(t):
    """Calls with up to four passages of 100 tokens; four are more than the 350 that fit, so the last is dropped once."""
    overflows, n = F.col("value") > 30, (F.col("event_id") % 5).cast("int")
    first = F.when(overflows, "overflow").when(F.col("event_type") == "error", "error").otherwise("ok")
    second = F.when(F.col("event_id") % 2 == 0, "overflow").otherwise("ok")
    passages = F.slice(F.array(*[F.lit(x) for x in "abcd"]), 1, n)
    fitting = services.fit_passages(passages, F.transform(passages, lambda x: F.lit(100).cast("long")), F.lit(350))
    result = services.answer_result(F.col("user_id") % 7 != 0, n > 0, first, second, F.col("event_id") % 3 == 0)
    return t.events.select("event_id", result.alias("result"), F.size(fitting).cast("long").alias("passages"))


@register("ir_19_upkeep", """WITH s AS (SELECT event_id AS id, event_type AS kind, 'Fact ' || (event_id % 200) AS text, epoch_us(ts) // 1000000 AS updated_at, 0 AS prio FROM events WHERE event_id % 2 = 0 AND 'fact ' || (event_id % 200) NOT IN
    (SELECT DISTINCT 'fact ' || (event_id % 200) FROM events WHERE event_id % 50 = 0)), a AS (SELECT event_id AS id, event_type AS kind, '  FACT ' || (event_id % 200) AS text, epoch_us(ts) // 1000000 AS updated_at, 1 AS prio FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0),
    m AS (SELECT lower(trim(text)) AS key, min_by(id, (prio, id)) AS id, min_by(text, (prio, id)) AS text, max(updated_at) AS updated_at FROM (SELECT * FROM s UNION ALL SELECT * FROM a) GROUP BY 1)
    SELECT id, 'general' AS kind, text, updated_at FROM m ORDER BY updated_at DESC, id LIMIT 60""")
def _(t):
    fact = lambda prefix: F.concat(F.lit(prefix), (F.col("event_id") % 200).cast("string")).alias("text")
    when = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("updated_at")
    rows = lambda df, prefix: df.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), fact(prefix), when)
    stored, added = rows(t.events.filter("event_id % 2 = 0"), "Fact "), rows(t.events.filter("event_id % 2 = 1 and event_id % 3 = 0"), "  FACT ")
    return meetings.upkeep(stored, t.events.filter("event_id % 50 = 0").select(fact("fact ")), added)


@register("ir_20_report_states", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'unavailable' WHEN quality = 1 THEN 'ready' ELSE 'failed' END AS state FROM labels""")
def _(t):
    return t.labels.select("doc_id", meetings.next_state(F.lit("pending"), F.col("quality") == 1, F.col("toxic") == 0).alias("state"))


@register("ir_21_benchmark", f"""WITH {ASKED}, {BM25}, {VECTOR}, {FUSED},
    pl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, u.id) AS place, u.id, d.vector, q.vector AS qv FROM u JOIN d USING (id) JOIN q USING (query_id) QUALIFY place <= 12), {mmr_sql('pl')},
    l AS (SELECT DISTINCT a.id AS query_id, b.id FROM corpus a JOIN corpus b USING (label) WHERE a.id % 100 = 0), t AS (SELECT query_id, count(*) AS n FROM l GROUP BY query_id),
    h AS (SELECT query_id, count(*) FILTER (WHERE position <= 1) AS h1, count(*) FILTER (WHERE position <= 3) AS h3, count(*) FILTER (WHERE position <= 6) AS h6, min(position) AS f FROM picked JOIN l USING (query_id, id) GROUP BY query_id),
    e AS (SELECT query_id FROM picked UNION SELECT query_id FROM l), o AS (SELECT t.n, coalesce(h1, 0) / t.n::DOUBLE AS r1, coalesce(h3, 0) / t.n::DOUBLE AS r3, coalesce(h6, 0) / t.n::DOUBLE AS r6, CASE WHEN t.n IS NOT NULL THEN coalesce(1.0::DOUBLE / f, 0) END AS rr FROM e LEFT JOIN t USING (query_id) LEFT JOIN h USING (query_id))
    SELECT round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(r6), 6) AS recall_6, round(avg(rr), 6) AS mrr, count(rr) AS labelled, count(*) - count(rr) AS unlabelled FROM o""", "corpus")
def _(t):
    ranked = retrieval.hybrid(t.asked, t.corpus, NOW, 6, priors=False)
    rows = t.corpus.select("id", "label")
    asked = rows.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return evaluation.summary(evaluation.per_query_by_label(stored(ranked, "ranked"), asked, rows))


@register("ir_22_hit_at_k", """WITH q AS (SELECT id AS query_id, vector, label FROM vectors WHERE id % 100 = 0), d AS (SELECT * FROM vectors), """ + VECTOR + """
    SELECT round(avg(hit::INT), 6) AS hit_rate, list(query_id ORDER BY query_id) FILTER (WHERE NOT hit) AS misses FROM (SELECT q.query_id, coalesce(bool_or(d.label = q.label) FILTER (WHERE v.id <> q.query_id), false) AS hit
    FROM q JOIN v ON v.query_id = q.query_id AND v.rank <= 3 JOIN d ON d.id = v.id GROUP BY q.query_id)""", "vectors")
def _(t):
    q = t.vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector", F.col("label").alias("wanted"))
    found = retrieval.vector_top_k(q.select("query_id", "vector"), t.vectors, 3).join(t.vectors.select("id", "label"), "id").join(q.select("query_id", "wanted"), "query_id")
    hit = F.coalesce(F.bool_or((F.col("label") == F.col("wanted")) & (F.col("id") != F.col("query_id"))), F.lit(False))
    return relations.hit_rate(found.groupBy("query_id").agg(hit.alias("hit")))


@register("ir_23_self_retrieval")
def _(t):
    """Each long enough document's opening must find one of its own chunks, among the chunks of all documents."""
    chunks = embedding.index_documents(t.docs.filter(F.length("text") >= 20).select("id", "text"))
    chunks = chunks.select((F.col("id") * 10000 + F.col("chunk_index")).alias("id"), "text", "vector")
    opening = t.docs.filter((F.length("text") >= 20) & (F.col("id") % 100 == 0)).select(F.col("id").alias("query_id"), F.left("text", F.lit(400)).alias("text"))
    ranked = retrieval.vector_top_k(embedding.embed(opening).select("query_id", "vector"), chunks, 6)
    own = ranked.withColumn("hit", F.floor(F.col("id") / 10000) == F.col("query_id")).groupBy("query_id").agg(F.bool_or("hit").alias("hit"))
    return relations.hit_rate(own)


# Providers: anything with the right shape serves.


@register("ext_1_embedding_provider", "SELECT doc_id AS id, length(text) AS chars FROM documents")
def _(t):
    import numpy as np

    made = embedding.embed(t.docs.select("id", "text"), lambda s: np.array([float(len(s)), float(s.count(" "))]))
    return made.select("id", F.col("vector")[0].cast("long").alias("chars"))


@register("ext_3_vector_store", "SELECT count(*)::BIGINT AS vectors FROM embeddings WHERE vec_id % 2 = 0")
def _(t):
    from skein.operators.vector_store import VectorStore

    store = VectorStore(t.vectors.select("id", "vector").limit(0))
    store = store.upsert(t.vectors.select("id", "vector")).upsert(t.vectors.select("id", "vector")).remove(t.vectors.filter("id % 2 = 1").select("id"))
    return store.count()


@register("ext_5_token_counter", r"SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 5000")
def _(t):
    """Words instead of estimated tokens: as many documents of each source as 5,000 words hold."""
    packed = retrieval.pack_budget(t.documents, "source", [F.col("doc_id")], text.word_count(F.col("text")), 5000)
    return packed.select("source", "doc_id", "used")


@register("ext_2_chunker", """WITH c AS (SELECT doc_id AS id, text, unnest(range((length(text) + 499) // 500)) AS chunk_index FROM documents)
    SELECT id, chunk_index, length(substr(text, chunk_index * 500 + 1, 500)) AS words, md5(substr(text, chunk_index * 500 + 1, 500)) AS text_md5 FROM c""")
def _(t):
    """Pieces of 500 characters instead of sentences."""
    pieces = lambda body: [(body[k : k + 500], k, len(body[k : k + 500])) for k in range(0, len(body), 500)]
    chunks = sentences.chunk_documents(t.docs.select("id", "text", F.array(F.lit(0)).alias("page_breaks")), pieces)
    return chunks.select("id", "chunk_index", "words", F.md5("text").alias("text_md5"))


@register("ext_2_chunk_udtf")
def _(t):
    """Sessions by the table function, called from SQL."""
    chunk_udtf.register(t.spark)
    view = "ext_2_turns"
    t.segments.select("session_id", "start", "text").createOrReplaceTempView(view)
    made = t.spark.sql(f"SELECT * FROM chunk_text(TABLE({view}) PARTITION BY session_id ORDER BY start)")
    return made.select("session_id", "chunk_index", "words", "timestamp", F.md5("text").alias("text_md5"))


def _echo(instructions: str, prompt: str) -> str:
    """A stand-in for a model: valid JSON for even prompts only when asked again, for odd ones never, and it fails on some."""
    if prompt.endswith("7"):
        raise RuntimeError("no model")
    if int(prompt) % 2 or "JSON object alone" not in instructions:
        return "I think {it is"
    return 'Here: {"overview": "' + prompt + '", "more": {"n": 1}} and so on'


@register("ext_4_gateway", """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{"more": {"n": 1}, "overview": "' || item_id || '"}' END AS json, CASE WHEN item_id % 10 <> 7 THEN 'I think {it is' END AS reply FROM benchmark""")
def _(t):
    rows = t.benchmark.select("item_id", F.col("item_id").cast("string").alias("prompt"))
    made = services.generate(rows, _echo, "Summarise.", ("overview",))
    return services.respond(made, _echo, "Summarise.").select("item_id", "json", "reply")


@register("ext_6_services", """SELECT 'title' AS service, item_id AS id, 'Notes on ' || item_id AS value FROM benchmark UNION ALL SELECT 'kind', item_id, CASE WHEN item_id % 2 = 0 THEN 'Planning' END FROM benchmark
    UNION ALL SELECT 'fact', item_id, 'decision:' || item_id FROM benchmark UNION ALL SELECT 'summary', item_id, '{"overview": "' || item_id || '"}' FROM benchmark
    UNION ALL SELECT 'report', item_id, CASE WHEN item_id % 3 = 0 THEN 'failed' ELSE 'ready' END FROM benchmark UNION ALL SELECT 'report', item_id, 'unavailable' FROM benchmark""")
def _(t):
    from json import dumps

    rows = t.benchmark.select(F.col("item_id").alias("session_id"), F.col("item_id").cast("string").alias("text"))
    parts = [
        services.titles(rows, lambda i, p: f'Title: "Notes on {p}"\nmore').select(F.lit("title").alias("service"), F.col("session_id").alias("id"), F.col("title").alias("value")),
        services.classify(rows.withColumnRenamed("session_id", "cluster"), lambda i, p: " Planning\n" if int(p) % 2 == 0 else " ").select(F.lit("kind"), "cluster", "name"),
        services.distil(rows, lambda i, p: dumps({"facts": [{"kind": "decision", "text": p}]})).select(F.lit("fact"), "session_id", F.concat_ws(":", "kind", "text")),
        services.summarise(rows.select("session_id", F.lit("map").alias("stage"), F.lit(0).alias("number"), F.col("text").alias("prompt")), lambda i, p: dumps({"overview": p})).select(F.lit("summary"), "session_id", "json"),
        services.reports(rows, lambda i, p: "none" if int(p) % 3 == 0 else dumps({"overview": p})).select(F.lit("report"), "session_id", "state"),
        services.reports(rows, lambda i, p: "", available=False).select(F.lit("report"), "session_id", "state"),
    ]
    return reduce(DataFrame.union, parts)


@register("ext_7_expansions", """SELECT item_id AS query_id, unnest([1, 2]) AS alt_no, unnest(['about ' || item_id, 'more on ' || item_id]) AS text FROM benchmark WHERE item_id % 4 <> 3""")
def _(t):
    """Phrasings from a stand-in for a model that fails on every fourth question."""

    def model(instructions: str, prompt: str) -> str:
        if int(prompt) % 4 == 3:
            raise RuntimeError("no model")
        return f"1. about {prompt}\n\n - more on {prompt} "

    return services.expansions(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("text")), model)
