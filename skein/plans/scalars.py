"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.functions import vectors as V
from skein.plans.registry import NOW, Tables, register

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"


@register("fn_1_tokenize", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@register("fn_2_token_estimate", "SELECT doc_id, ceil(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@register("fn_3_fits", "SELECT doc_id, (200 + ceil(length(text) / 3.5::DOUBLE)::BIGINT + 700 <= 4096) AS fits FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fits(F.lit(200), text.token_estimate(F.col("text")), F.lit(700)).alias("fits"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '-\n(\p{Ll})', '\1', 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'),
    '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@register("fn_4_clean", f"SELECT doc_id, md5({CLEAN}) AS cleaned_md5, length({CLEAN})::BIGINT AS n FROM documents")
def _(t):
    cleaned = text.clean(F.col("text"))
    return t.documents.select("doc_id", F.md5(cleaned).alias("cleaned_md5"), F.length(cleaned).cast("long").alias("n"))


@register("fn_5_preview", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))


@register("fn_6_normal_key", r"SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", text.normal_key(F.col("text")).alias("key"))


CLOCK = "printf('%02d:%02d:%02d', {s} // 3600, ({s} // 60) % 60, {s} % 60)"
SECONDS = "greatest(0, floor(value * 40 - 300))::BIGINT"


@register("fn_7_clock", f"SELECT event_id, {CLOCK.format(s=SECONDS)} AS clock FROM events")
def _(t):
    return t.events.select("event_id", text.clock(F.col("value") * 40 - 300).alias("clock"))


@register(
    "fn_8_duration",
    f"""SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, (s // 60) % 60, s % 60)
        WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM (SELECT event_id, {SECONDS} AS s FROM events)""",
)
def _(t):
    return t.events.select("event_id", text.duration(F.col("value") * 40 - 300).alias("duration"))


@register("fn_9_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM events")
def _(t):
    return t.events.select("event_id", text.stamp(F.col("ts")).alias("stamp"))


@register("fn_10_file_name", r"""SELECT page_id, CASE WHEN s = '' THEN 'Session' ELSE s END AS name
    FROM (SELECT page_id, regexp_replace(translate(url, '/\:?%*|"<>', '----------'), '^\s+|\s+$', '', 'g') AS s FROM pages)""")
def _(t):
    return t.pages.select("page_id", text.file_name(F.col("url")).alias("name"))


@register("fn_11_dot", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a, b = t.embeddings.alias("a"), t.embeddings.alias("b")
    pairs = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pairs.select("a.vec_id", F.round(V.dot(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@register("fn_12_normalise", """SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squared, round(u[1], 6) AS first FROM
    (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 3 * x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: 9 * y * y)))) AS u FROM embeddings)""")
def _(t):
    u = V.normalise(F.transform(V.doubles(F.col("embedding")), lambda x: x * 3))
    return t.embeddings.select("vec_id", u.alias("u")).select("vec_id", F.round(V.norm(F.col("u")) * V.norm(F.col("u")), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


@register("fn_13_add", "SELECT a.vec_id, round(a.embedding[1]::DOUBLE + b.embedding[1]::DOUBLE, 6) AS first, round(a.embedding[64]::DOUBLE + b.embedding[64]::DOUBLE, 6) AS last FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a, b = t.embeddings.alias("a"), t.embeddings.alias("b")
    s = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", V.add(F.col("a.embedding"), F.col("b.embedding")).alias("s"))
    return s.select("vec_id", F.round(F.col("s")[0], 6).alias("first"), F.round(F.element_at("s", -1), 6).alias("last"))


@register("fn_14_pack", "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same, true AS refused FROM embeddings")
def _(t):
    packed = t.embeddings.select("vec_id", "embedding", V.pack("embedding").alias("packed"))
    short = V.unpack(F.substring("packed", 1, 7))
    return packed.select("vec_id", F.octet_length("packed").cast("long").alias("n_bytes"), (V.unpack("packed") == F.col("embedding")).alias("same"), short.isNull().alias("refused"))


@register("fn_15_recency", f"SELECT doc_id, round(0.004::DOUBLE * exp(-greatest(0.0::DOUBLE, ({NOW} - created) / 86400.0::DOUBLE) / 45.0::DOUBLE), 9) AS prior FROM docs", "docs")
def _(t):
    return t.docs.select("doc_id", F.round(scores.recency_prior(F.col("created"), F.lit(NOW)), 9).alias("prior"))


@register("fn_16_adjusted", f"""SELECT event_id, round(value / 100 + 0.004::DOUBLE * exp(-event_id / 1000.0::DOUBLE / 45.0::DOUBLE) + 0.004::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 10)), 9) AS adjusted
    FROM events""")
def _(t):
    recency = scores.recency_prior(F.lit(NOW) - F.col("event_id") * 86.4, F.lit(NOW))
    return t.events.select("event_id", F.round(scores.adjusted(F.col("value") / 100, recency, F.col("value") / 10), 9).alias("adjusted"))


@register("fn_17_overlap", """SELECT a.event_id, round(greatest(0.0::DOUBLE, least(a.value + 5, b.value + 3) - greatest(a.value, b.value)), 6) AS overlap FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def _(t):
    a, b = t.events.alias("a"), t.events.alias("b")
    o = scores.overlap(F.col("a.value"), F.col("a.value") + 5, F.col("b.value"), F.col("b.value") + 3)
    return a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1).select("a.event_id", F.round(o, 6).alias("overlap"))


@register("fn_18_first_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(t):
    from skein.functions.json_text import first_object

    noisy = F.concat(F.lit('Sure: "{" '), F.col("props"), F.lit(' {"later": 1}'))
    return t.events.select("event_id", F.from_json(first_object(noisy), "k bigint")["k"].alias("k"))


@register("fn_19_list_markers", r"""SELECT doc_id, list_filter(list_transform(string_split('1. ' || text || chr(10) || '- ' || text || chr(10) || ' ', chr(10)),
    lambda x: trim(regexp_replace(x, '^[\p{N}.)\-• ]+', ''))), lambda x: x <> '') AS lines FROM documents""")
def _(t):
    listed = F.concat(F.lit("1. "), F.col("text"), F.lit("\n- "), F.col("text"), F.lit("\n "))
    return t.documents.select("doc_id", text.strip_list_markers(listed).alias("lines"))


@register("fn_20_json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0::BIGINT AS broken FROM events")
def _(t):
    broken = F.size(F.coalesce(F.from_json("props", "array<string>"), F.array().cast("array<string>")))
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), broken.cast("long").alias("broken"))


@register("fn_21_join_pages", """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, list(start_at ORDER BY turn) AS offsets FROM
    (SELECT conv_id, turn, text, (coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_at FROM conversations) GROUP BY conv_id""")
def _(t):
    pages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    joined = t.conversations.groupBy("conv_id").agg(pages.alias("pages")).select("conv_id", text.join_pages(F.col("pages")).alias("j"))
    return joined.select("conv_id", F.md5("j.text").alias("text_md5"), F.col("j.offsets").alias("offsets"))


@register("fn_22_numbered", "SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || text AS passage FROM conversations")
def _(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", text.numbered(n, F.col("text")).alias("passage"))


@register("fn_23_sections", r"""SELECT doc_id, concat_ws(chr(10) || chr(10), 'Facts', nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Context' END, ''), text) AS prompt FROM documents""")
def _(t):
    context = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("Context"))
    return t.documents.select("doc_id", text.sections(F.lit("Facts"), context, F.col("text")).alias("prompt"))


@register("fn_24_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.col("text").isNotNull(), text.word_count(F.col("text"))).alias("words"))


@register("fn_25_halves", """SELECT doc_id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) // 2], '. ') ELSE left(text, (length(text) // 2)::INT) END AS head,
    CASE WHEN len(p) > 1 THEN array_to_string(p[len(p) // 2 + 1:], '. ') ELSE substr(text, (length(text) // 2)::INT + 1) END AS tail FROM (SELECT doc_id, text, string_split(text, '. ') AS p FROM documents)""")
def _(t):
    return t.documents.select("doc_id", text.halves(F.col("text")).alias("h")).select("doc_id", F.col("h")[0].alias("head"), F.col("h")[1].alias("tail"))


@register("fn_26_percent", "SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100)::INT || '%' AS english FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(text.percent(F.avg((F.col("lang") == "en").cast("double"))).alias("english"))
