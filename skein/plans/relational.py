"""Queries of predicates, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.functions import vectors as V
from skein.operators import clustering, meetings, predicates, relations, retrieval
from skein.operators.substrings import SubstringIndex
from skein.plans.registry import Tables, register

# Predicates


@register("flt_1_search", """SELECT s.session_id, s.title FROM sessions s WHERE contains(strip_accents(lower(s.title)), 'thing')
    OR EXISTS (SELECT 1 FROM segments g WHERE g.session_id = s.session_id AND contains(strip_accents(lower(g.text)), 'thing'))""", "sessions segments")
def _(t: Tables) -> DataFrame:
    index = SubstringIndex.build(t.segments.select("session_id", "text"))
    return predicates.search_sessions(t.sessions, t.segments, "Thing", index).select("session_id", "title")


@register("flt_2_category", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _(t):
    return t.documents.filter(predicates.in_category(F.array("lang", "source"), "en")).select("doc_id")


STATE = "(['none', 'pending', 'ready', 'failed', 'unavailable'])[(event_id % 5 + 1)::INT]"


def _state():
    return F.element_at(F.array(*[F.lit(s) for s in ("none", "pending", "ready", "failed", "unavailable")]), (F.col("event_id") % 5 + 1).cast("int"))


@register("flt_3_retry", f"""SELECT event_id, CASE {STATE} WHEN 'pending' THEN NOT (user_id % 2 = 0) WHEN 'failed' THEN true WHEN 'unavailable' THEN (value > 5) ELSE false END AS retry FROM events""")
def _(t):
    return t.events.select("event_id", meetings.needs_retry(_state(), F.col("user_id") % 2 == 0, F.col("value") > 5).alias("retry"))


@register("flt_4_weak", "SELECT doc_id, ((quality = 0) AND (coalesce(CASE WHEN toxic = 1 THEN NULL ELSE doc_id / 1000.0::DOUBLE END, 0.0) < 0.3)) AS weak FROM labels")
def _(t):
    cosine = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("doc_id") / 1000.0)
    return t.labels.select("doc_id", scores.is_weak(F.col("quality"), cosine).alias("weak"))


CONTEXT = "['" + "','".join(predicates.CONTEXT_WORDS) + "']"
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"


@register("flt_5_needs_rewrite", f"SELECT conv_id, turn, (len({TOK}) < 4 OR list_has_any({TOK}, {CONTEXT})) AS rewrite FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", predicates.needs_rewrite(F.col("text")).alias("rewrite"))


@register("flt_6_relevant", "SELECT doc_id, (contains(lower(text), 'apache license') OR source = 'src3') AS relevant FROM documents WHERE text IS NOT NULL")
def _(t):
    d = t.documents.filter("text is not null")
    return d.select("doc_id", predicates.is_relevant(F.col("text"), F.col("source"), F.lit("Apache License"), F.lit("src3")).alias("relevant"))


@register("flt_7_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def _(t):
    return t.embeddings.filter(V.same_size(F.col("embedding"), F.array(*[F.lit(0.0)] * 64))).select("vec_id")


@register("flt_8_question_length", "SELECT doc_id FROM documents WHERE ceil(length(text) / 3.5::DOUBLE) <= 250")
def _(t):
    return t.documents.filter(text.token_estimate(F.col("text")) <= 250).select("doc_id")


@register("flt_9_speech_onset", r"""SELECT conv_id, turn, (length(s) >= 5 AND len(regexp_extract_all(s, '\S+')) >= 2) AS onset FROM
    (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM conversations)""")
def _(t):
    return t.conversations.select("conv_id", "turn", predicates.speech_onset(F.col("text")).alias("onset"))


STRIP = r"""[ \t"''“”‘’.,:;!]+"""


@register("flt_10_title", rf"""SELECT doc_id, CASE WHEN length(cut) >= 3 AND lower(cut) NOT IN ('meeting', 'discussion', 'untitled', 'notes') THEN cut END AS title FROM
    (SELECT doc_id, CASE WHEN length(l) > 60 THEN trim(regexp_replace(left(l, 60), ' [^ ]*$', '')) ELSE l END AS cut FROM
    (SELECT doc_id, regexp_replace(regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], '^(Title:|title:|TITLE:)', ''),
        '^{STRIP}|{STRIP}$', '', 'g') AS l FROM documents))""")
def _(t):
    return t.documents.select("doc_id", text.title_from(F.col("text")).alias("title"))


@register("flt_11_embedder", """SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'upgrade' ELSE 'builtin' END AS choice,
    (user_id % 5 <> 0 AND (CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'upgrade' ELSE 'builtin' END) <> 'builtin') AS rebuild FROM events""")
def _(t):
    choice = predicates.embedder_choice(F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0)
    active = F.when(F.col("user_id") % 5 != 0, F.lit("builtin"))
    return t.events.select("event_id", choice.alias("choice"), predicates.needs_rebuild(choice, active).alias("rebuild"))


@register("flt_12_router", """SELECT event_id, CASE WHEN heat = 'critical' THEN 'retrieval' WHEN pref = 'hosted' THEN CASE WHEN ready THEN 'hosted' ELSE 'retrieval' END
    WHEN pref = 'local' THEN CASE WHEN loc THEN 'local' ELSE 'retrieval' END
    WHEN pref = 'auto' THEN CASE WHEN ready THEN 'hosted' WHEN loc THEN 'local' ELSE 'retrieval' END
    ELSE CASE WHEN loc THEN 'local' WHEN ready THEN 'hosted' ELSE 'retrieval' END END AS backend FROM
    (SELECT event_id, (['nominal', 'serious', 'critical'])[(event_id % 3 + 1)::INT] AS heat, (['hosted', 'local', 'auto', 'prefer_local'])[(event_id % 4 + 1)::INT] AS pref,
        user_id % 2 = 0 AS ready, (user_id % 3 = 0 AND event_id % 3 <> 1) AS loc FROM events)""")
def _(t):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % k + 1).cast("int"))
    route = predicates.backend(pick(["hosted", "local", "auto", "prefer_local"], 4), pick(["nominal", "serious", "critical"], 3), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0)
    return t.events.select("event_id", route.alias("backend"))


# Joins


@register("join_1_citations", """SELECT e.event_id, coalesce(d.source, 'Document') AS title, CASE WHEN v.vec_id IS NOT NULL AND v.label % 2 = 0 THEN 'Page ' || v.label END AS detail
    FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id LEFT JOIN documents d ON d.doc_id = e.event_id""")
def _(t):
    refs = t.events.select("event_id", F.col("event_id").alias("chunk_id"), F.col("event_id").alias("source_id"))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, F.col("label")).alias("page_number"))
    titles = t.documents.select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"))
    return relations.resolve_citations(refs, chunks, titles, "Document").select("event_id", "title", "detail")


@register("join_2_polymorphic", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'")
def _(t):
    joined = relations.of_type(t.lineitem, "l_returnflag", "R").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_custkey")


RANKS = """a AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
    b AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings WHERE vec_id % 3 = 0)"""


def _rankings(t):
    v = t.embeddings.select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("id"))
    a = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    b = v.filter(F.col("id") % 3 == 0).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id"))))
    return [a, b]


@register("join_3_full_outer", f"WITH {RANKS} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, id")
def _(t):
    return retrieval.reciprocal_rank_fusion(_rankings(t)).select("query_id", "id", "fused")


SPANS = """spans AS (SELECT user_id, event_type AS speaker, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE + 40 * value AS e FROM events)"""


def _spans(t):
    return t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("speaker"), _epoch().alias("start"), (_epoch() + F.col("value") * 40).alias("end"))


def _epoch():
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)


@register("join_4_speakers", f"""WITH segs AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE + 600 AS e FROM events), {SPANS},
    o AS (SELECT g.user_id, g.event_id, p.speaker, round(sum(least(g.e, p.e) - greatest(g.s, p.s)), 6) AS o FROM segs g JOIN spans p ON g.user_id = p.user_id AND g.s < p.e AND p.s < g.e GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY o DESC, speaker) AS n FROM o WHERE o > 0)
    SELECT g.user_id AS session_id, g.event_id AS segment_id, r.speaker FROM segs g LEFT JOIN r ON r.user_id = g.user_id AND r.event_id = g.event_id AND r.n = 1""")
def _(t):
    segs = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("segment_id"), _epoch().alias("start"), (_epoch() + 600).alias("end"))
    return meetings.label_speakers(segs, _spans(t))


@register("join_5_as_of", """SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts""")
def _(t):
    marks = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return relations.as_of(t.events.select("user_id", "ts", "event_id"), marks, "user_id", "ts", "purchase_id").select("event_id", "purchase_id")


@register("join_6_query_corpus", """SELECT q.id AS query_id, v.id, round(list_inner_product(q.vector, v.vector), 6) AS score FROM vectors q, vectors v WHERE q.id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) <= 20""", "vectors")
def _(t):
    q = t.vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return retrieval.vector_top_k(q, t.vectors, 20).select("query_id", "id", "score")


@register("join_7_prior_sessions", """WITH p AS (SELECT a.id, b.id AS prior_id, round(list_inner_product(a.vector, b.vector), 6) AS cosine FROM vectors a JOIN vectors b ON a.label = b.label AND b.id < a.id)
    SELECT id, prior_id, cosine FROM p WHERE cosine >= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, prior_id) <= 3""", "vectors")
def _(t):
    rows = t.vectors.select(F.col("label").alias("grp"), "id", F.col("id").alias("created"), "vector")
    return clustering.continuity(rows, rows, 0.1, 3).select("id", "prior_id", "cosine")


@register("join_8_semi", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def _(t):
    keys = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(keys, "o_orderkey", "left_semi").select("o_orderkey")


@register("join_9_anti", r"""WITH k AS (SELECT doc_id, source, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS key FROM documents WHERE text IS NOT NULL)
    SELECT doc_id FROM k WHERE NOT EXISTS (SELECT 1 FROM k g WHERE g.key = k.key AND g.source = 'src3') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def _(t):
    """Texts of one source retired wherever they stand, by normalised text; then ids that were seen."""
    rows = t.documents.filter("text is not null").select("doc_id", "source", text.normal_key(F.col("text")).alias("key"))
    left = rows.join(rows.filter("source = 'src3'").select("key").distinct(), "key", "left_anti")
    return left.join(t.labels.filter("quality = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@register("join_10_first_wins", "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    return relations.first_wins(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


# Aggregates


@register("agg_1_counts", "SELECT (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM labels) AS facts")
def _(t):
    return relations.counts({"chunks": t.embeddings, "facts": t.labels})


@register("agg_2_bytes", """SELECT *, transcripts + documents + index_bytes AS total FROM (SELECT (SELECT sum(strlen(text))::BIGINT FROM conversations) AS transcripts,
    (SELECT sum(strlen(text))::BIGINT FROM documents) AS documents, (SELECT sum(4 * len(embedding))::BIGINT FROM embeddings) AS index_bytes)""")
def _(t):
    return relations.storage_usage(t.conversations, t.documents, t.embeddings)


@register("agg_3_dashboard", "SELECT count(DISTINCT nullif(lang, ''))::BIGINT AS categories, count(*)::BIGINT AS documents FROM documents")
def _(t):
    return t.documents.agg(F.count_distinct(F.when(F.col("lang") != "", F.col("lang"))).alias("categories"), F.count("*").alias("documents"))


@register("agg_4_by_category", "SELECT coalesce(CASE WHEN lang = 'fr' THEN NULL ELSE lang END, 'Ungrouped') AS category, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def _(t):
    return relations.by_category(t.documents.select(F.when(F.col("lang") != "fr", F.col("lang")).alias("category")))


@register("agg_5_categories", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def _(t):
    return t.documents.filter("source is not null").select("source").distinct().orderBy("source")


@register("agg_6_speakers", "SELECT conv_id, count(DISTINCT role)::BIGINT AS speakers FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.count_distinct("role").alias("speakers"))


@register("agg_7_mean_vector", """WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM vectors) GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, pos, round(x / n, 6) AS x FROM m JOIN n USING (label)""", "vectors")
def _(t):
    pooled = clustering.mean_vectors(t.vectors, "label").select("label", F.posexplode("vector").alias("pos", "x"))
    return pooled.select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("agg_8_document_frequency", f"""WITH k AS (SELECT doc_id, unnest(list_distinct({TOK})) AS term FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, greatest(1.0::DOUBLE, sum(coalesce(len({TOK}), 0)) / count(*)) AS a FROM documents)
    SELECT term, count(*)::BIGINT AS df, any_value(n.n)::BIGINT AS n, round(any_value(n.a), 6) AS avg_len FROM k, n GROUP BY term""")
def _(t):
    return retrieval.document_frequencies(t.docs.select("id", "text"))


@register("agg_9_means", """SELECT round(coalesce(avg(quality) FILTER (WHERE toxic = 0), 0), 6) AS recall, round(coalesce(avg(1.0::DOUBLE / (1 + doc_id % 5)) FILTER (WHERE quality = 1), 0), 6) AS mrr FROM labels""")
def _(t):
    return relations.metric_means(t.labels.select(F.when(F.col("toxic") == 0, F.col("quality")).alias("recall"), F.when(F.col("quality") == 1, 1.0 / (1 + F.col("doc_id") % 5)).alias("rr")))


@register("agg_10_hit_rate", """SELECT round(avg(quality), 6) AS hit_rate, list(doc_id ORDER BY doc_id) FILTER (WHERE quality = 0) AS misses FROM labels""")
def _(t):
    return relations.hit_rate(t.labels.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("hit")))


@register("agg_11_page_chars", "SELECT conv_id, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def _(t):
    pages = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("pages"))
    return pages.select("conv_id", F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + F.length(p)).alias("chars"))


@register("agg_12_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def _(t):
    lines = t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY turn)").alias("transcript"))


@register("agg_13_refresh", "SELECT user_id, event_type, max(event_id) AS newest, min_by(value, event_id) AS first_value FROM events GROUP BY user_id, event_type")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("newest"), F.min_by("value", "event_id").alias("first_value"))


@register("agg_14_level", """SELECT user_id, round((greatest(-60.0::DOUBLE, least(0.0::DOUBLE, 20 * log10(greatest(sqrt(avg(value * value / 10000)), 1e-7::DOUBLE)))) + 60) / 60, 6) AS level FROM events GROUP BY user_id""")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(scores.level(F.sqrt(F.avg(F.col("value") * F.col("value") / 10000))), 6).alias("level"))


# Windows


@register("win_1_rank", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC)::BIGINT AS rank FROM embeddings")
def _(t):
    return t.embeddings.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))).cast("long").alias("rank"))


TOKENS = "ceil(length(text) / 3.5::DOUBLE)::BIGINT"


@register("win_2_pack", f"""SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum({TOKENS}) OVER w AS used, row_number() OVER w AS place FROM documents WHERE text IS NOT NULL
    WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 2300 OR place = 1""")
def _(t):
    packed = retrieval.pack_budget(t.documents.filter("text is not null"), "source", [F.col("doc_id")], text.token_estimate(F.col("text")), 2300, force_first=True)
    return packed.select("source", "doc_id", "used")


@register("win_3_pack_facts", r"""SELECT conv_id, turn, '- ' || text AS line FROM (SELECT conv_id, turn, text, sum(ceil((length(text) + 2) / 3.5::DOUBLE)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used
    FROM conversations WHERE trim(text) <> '') WHERE used <= 120""")
def _(t):
    rows = t.conversations.filter(text.strip(F.col("text")) != "").withColumn("line", F.concat(F.lit("- "), "text"))
    return retrieval.pack_budget(rows, "conv_id", [F.col("turn")], text.token_estimate(F.col("line")), 120).select("conv_id", "turn", "line")


@register("win_4_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def _(t):
    return meetings.last_turns(t.conversations).select("conv_id", "turn", "role")


@register("win_5_first_appearance", """WITH f AS (SELECT user_id, event_type, min(event_id) AS at_ FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, 'Speaker ' || dense_rank() OVER (PARTITION BY user_id ORDER BY at_) AS speaker FROM f""")
def _(t):
    return relations.first_appearance(t.events, "user_id", "event_type", "event_id", "Speaker ").select("user_id", "event_type", F.col("label").alias("speaker"))


@register("win_6_citation_order", """SELECT event_id, CASE WHEN c = [] THEN [1, 2, 3] ELSE c END AS cited FROM (SELECT event_id, CASE WHEN a BETWEEN 1 AND 3 AND b BETWEEN 1 AND 3 AND a <> b THEN [a, b]
    WHEN a BETWEEN 1 AND 3 THEN [a] WHEN b BETWEEN 1 AND 3 THEN [b] ELSE [] END AS c FROM (SELECT event_id, (event_id % 5)::INT AS a, (event_id % 7)::INT AS b FROM events))""")
def _(t):
    cited = F.array((F.col("event_id") % 5).cast("int"), (F.col("event_id") % 7).cast("int"))
    return t.events.select("event_id", relations.citation_order(cited, F.lit(3)).alias("cited"))


@register("win_7_latest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "event_id")


@register("win_8_keep_newest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60")
def _(t):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("n", F.row_number().over(order)).filter("n <= 60").select("user_id", "event_id")


@register("win_9_pairwise", """SELECT conv_id, turn, CASE WHEN p IS NULL THEN 'append' WHEN starts_with(lower(text), lower(p)) THEN 'extends' WHEN starts_with(lower(p), lower(text)) THEN 'repeats' ELSE 'append' END AS relation
    FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)""")
def _(t):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("p", before).select("conv_id", "turn", relations.relation_to_previous(F.col("text"), F.col("p")).alias("relation"))


#: The fold of exactly-once assembly over each session's final updates, its lines as one list.
ASSEMBLY = r"""WITH f AS (SELECT session_id, list([{'t': text, 's': start, 'e': "end", 'k': lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))}] ORDER BY seq) AS u FROM updates WHERE is_final GROUP BY session_id),
    l AS (SELECT session_id, list_reduce(u, lambda a, x: CASE WHEN NOT (x[1].s < a[-1].e - 0.05::DOUBLE AND x[1].e > a[-1].s) THEN list_append(a, x[1])
        WHEN a[-1].k = x[1].k THEN a WHEN a[-1].k = '' OR starts_with(x[1].k, a[-1].k)
        THEN list_append(list_slice(a, 1, len(a) - 1), {'t': x[1].t, 's': least(a[-1].s, x[1].s), 'e': greatest(a[-1].e, x[1].e), 'k': x[1].k})
        WHEN starts_with(a[-1].k, x[1].k) THEN a ELSE list_append(a, x[1]) END) AS a FROM f)
    SELECT session_id, line, a[line + 1].t AS text, a[line + 1].s AS start, a[line + 1].e AS "end" FROM (SELECT session_id, a, unnest(range(len(a))) AS line FROM l)"""


@register("win_9_assembly_fold", ASSEMBLY, "updates")
def _(t):
    return meetings.assemble(relations.update_stream(t.conversations))


@register("win_10_active_time", """SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN d ELSE 0 END), 3) AS active FROM (SELECT user_id, event_type, coalesce(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts), 0)::DOUBLE AS d
    FROM events) GROUP BY user_id""")
def _(t):
    return relations.active_time(t.events, "user_id", "ts", "event_id", F.col("event_type") != "error")


@register("win_11_pages", """WITH o AS (SELECT doc_id, text, unnest([0, 40, 90]) AS off FROM documents), n AS (SELECT *, lead(off) OVER (PARTITION BY doc_id ORDER BY off) AS nxt FROM o)
    SELECT doc_id, off::BIGINT AS off, substr(text, off + 1, coalesce(nxt, length(text)) - off) AS page FROM n WHERE off < length(text)""")
def _(t):
    return relations.split_pages(t.documents.select("doc_id", "text", F.array(*[F.lit(x) for x in (0, 40, 90)]).alias("breaks")), "doc_id")


# Top-k and sets


@register("top_1_vector", """SELECT q.id AS query_id, v.id, round(list_inner_product(q.vector, v.vector), 6) AS score FROM vectors q, vectors v WHERE q.id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) <= 6""", "vectors")
def _(t):
    q = t.vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return retrieval.vector_top_k(q, t.vectors, 6).select("query_id", "id", "score")


@register("top_2_positive", "SELECT user_id AS query_id, event_id AS id, round(value - 20, 6) AS score FROM events WHERE round(value - 20, 6) > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value - 20, 6) DESC, event_id) <= 3")
def _(t):
    scored = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.round(F.col("value") - 20, 6).alias("score")).filter("score > 0")
    return retrieval.top_per_query(scored, 3).select("query_id", "id", "score")


@register("top_3_stable", f"""WITH {RANKS}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(seen) AS seen FROM
    (SELECT *, rank AS seen FROM a UNION ALL SELECT *, 1000000 + rank AS seen FROM b) GROUP BY query_id, id)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen)::BIGINT AS place FROM f""")
def _(t):
    fused = retrieval.reciprocal_rank_fusion(_rankings(t))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "first_seen"))
    return fused.select("query_id", "id", place.cast("long").alias("place"))


@register("top_4_prefix_suffix", "SELECT source, list(doc_id ORDER BY doc_id)[1:3] AS first_three, list(doc_id ORDER BY doc_id)[-3:] AS last_three FROM documents GROUP BY source")
def _(t):
    return relations.ends(t.documents, "source", "doc_id", 3)


@register("set_1_union", f"WITH {RANKS} SELECT query_id, id, rank::BIGINT AS rank FROM a UNION ALL SELECT query_id, id, rank FROM b")
def _(t):
    a, b = _rankings(t)
    return a.unionAll(b).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("set_2_coverage", f"""SELECT conv_id, turn, round(len(list_intersect(list_distinct({TOK}), ['the', 'of', 'and', 'zebra'])) / 4.0::DOUBLE, 6) AS coverage FROM conversations""")
def _(t):
    words = F.array(*[F.lit(w) for w in ("the", "of", "and", "zebra")])
    return t.conversations.select("conv_id", "turn", F.round(scores.coverage(words, text.tokenize(F.col("text"))), 6).alias("coverage"))


@register("set_3_distinct_terms", f"SELECT doc_id, len(list_distinct({TOK}))::BIGINT AS terms FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.array_distinct(text.tokenize(F.col("text")))).cast("long").alias("terms"))


@register("set_4_disjoint", f"SELECT doc_id, NOT list_has_any({TOK}, {CONTEXT}) AS disjoint_ FROM documents")
def _(t):
    context = F.array(*[F.lit(w) for w in predicates.CONTEXT_WORDS])
    return t.documents.select("doc_id", (~F.arrays_overlap(text.tokenize(F.col("text")), context)).alias("disjoint_"))


@register("set_5_except", f"""SELECT doc_id, len(list_filter(list_distinct({TOK}), lambda x: NOT list_contains({CONTEXT}, x)))::BIGINT AS others FROM documents""")
def _(t):
    context = F.array(*[F.lit(w) for w in predicates.CONTEXT_WORDS])
    return t.documents.select("doc_id", F.size(F.array_except(text.tokenize(F.col("text")), context)).cast("long").alias("others"))
