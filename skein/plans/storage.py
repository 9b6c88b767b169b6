"""Queries of sources, sinks and mutations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skein.functions import text
from skein.operators import indexing, meetings
from skein.plans.registry import EPOCH, Tables, register
from skein.plans.relational import ASSEMBLY
from skein.plans.scalars import CLEAN
from skein.sources import imports, tables
from skein.sources.corpus_cache import CorpusCache, decode_chunks
from skein.sources.shared import scratch
from skein.sources.versions import VersionedTable, sink
from skein.streaming import newest, stateful, transcripts


#: Files of a micro-batch that takes whatever is there.
ALL_FILES = 1 << 30


def _folder(t: Tables, name: str) -> str:
    """A fresh folder that the cluster shares."""
    return scratch(t.spark, name)


# Sources


def _as_files(t: Tables) -> str:
    """Benchmark texts written as one text file each below a folder."""
    folder = _folder(t, "import")
    t.benchmark.select(F.col("item_id").alias("file"), F.col("text").alias("value")).write.partitionBy("file").text(folder)
    return folder


@register("src_1_import_text", f"SELECT item_id, md5({CLEAN}) AS text_md5, NULL::VARCHAR AS import_error FROM benchmark")
def _(t: Tables) -> DataFrame:
    files = imports.import_files(t.spark, _as_files(t)).filter("file_type = 'txt'")
    return files.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"), "import_error")


@register("src_2_import_markdown", f"WITH d AS (SELECT doc_id, '# Notes' || chr(13) || chr(10) || repeat(chr(13) || chr(10), 2) || coalesce(text, '') || '  ' || chr(13) || chr(10) AS text FROM documents) SELECT doc_id, 'md' AS file_type, md5({CLEAN}) AS text_md5 FROM d")
def _(t):
    body = F.encode(F.concat(F.lit("# Notes\r\n\r\n\r\n"), F.coalesce("text", F.lit("")), F.lit("  \r\n")), "utf-8")
    rows = t.documents.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("content"))
    return rows.select("doc_id", imports.file_type(F.col("path")).alias("file_type"), F.md5(text.clean(imports.decode(F.col("content")))).alias("text_md5"))


@register("src_3_pages", f"""WITH c AS (SELECT conv_id, turn, coalesce({CLEAN}, '') AS page FROM conversations), o AS (SELECT conv_id, turn, page, (sum(length(page) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(page) - 2)::BIGINT AS off FROM c),
    g AS (SELECT conv_id, count(*) AS page_count, sum(length(page)) AS n, string_agg(page, chr(10) || chr(10) ORDER BY turn) AS body, list(off ORDER BY turn) AS page_breaks FROM o GROUP BY conv_id)
    SELECT conv_id, md5(body) AS text_md5, page_breaks, page_count::INT AS page_count, CASE WHEN conv_id % 11 = 0 THEN 'tooLarge' WHEN n < greatest(50, 10 * page_count) THEN 'scanned' WHEN trim(body) = '' THEN 'empty' END AS import_error FROM g""")
def _(t):
    """Conversations as paged files, a turn a page; every eleventh is too large."""
    pages = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("page_number"), "text")).alias("pages"))
    files = pages.withColumn("length", F.when(F.col("conv_id") % 11 == 0, F.lit(60 << 20)).otherwise(F.lit(1000)))
    return imports.import_pages(files, "conv_id").select("conv_id", F.md5("text").alias("text_md5"), "page_breaks", "page_count", "import_error")


PATH = "'/in/' || page_id || (['.txt', '.MD', '.pdf', '.docx', ''])[(page_id % 5 + 1)::INT]"


def _paths():
    ext = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".pdf", ".docx", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return F.concat(F.lit("/in/"), F.col("page_id").cast("string"), ext)


@register("src_4_dispatch", "SELECT page_id, (['txt', 'md', 'pdf', NULL, NULL])[(page_id % 5 + 1)::INT] AS kind FROM pages")
def _(t):
    return t.pages.select("page_id", imports.file_type(_paths()).alias("kind"))


@register("src_5_encoding", "SELECT doc_id, md5(unnest([coalesce(text, ''), 'it’s x'])) AS text_md5 FROM documents")
def _(t):
    utf8 = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    latin = F.unhex(F.concat(F.hex(F.lit("it")), F.lit("92"), F.hex(F.lit("s "))))
    rows = t.documents.select("doc_id", F.explode(F.array(utf8, F.concat(latin, F.lit("x").cast("binary")))).alias("content"))
    return rows.select("doc_id", F.md5(imports.decode(F.col("content"))).alias("text_md5"))


@register("src_6_guards", f"""SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 'unsupportedType' WHEN n_chars * 3000 > CASE WHEN doc_id % 5 = 2 THEN 52428800 ELSE 5242880 END THEN 'tooLarge'
    WHEN strlen(coalesce(text, '')) > 5242880 THEN 'tooLarge' WHEN trim(coalesce(text, '')) = '' THEN 'empty' END AS error FROM documents""")
def _(t):
    kind = F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("pdf"), F.lit(None), F.lit(None)), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", imports.import_error(kind, F.col("n_chars") * 3000, F.col("text")).alias("error"))


@register("src_7_scanned", "SELECT conv_id, sum(length(text)) < greatest(50, count(*) * 10) AS scanned FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("pages")).select("conv_id", imports.looks_scanned(F.col("pages")).alias("scanned"))


@register("src_8_newest_first", "SELECT doc_id, created FROM docs", "docs")
def _(t):
    return imports.newest_first(t.docs.select("doc_id", "created"), "created", "doc_id")


@register("src_9_oldest_first", "SELECT vec_id, label FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label").orderBy("vec_id")


@register("src_10_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 1")
def _(t):
    return imports.by_key(t.orders, "o_orderkey", 1).select("o_orderkey", "o_custkey")


@register("src_11_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 1)")
def _(t):
    wanted = t.orders.filter("o_custkey = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    return imports.by_keys(t.lineitem, "l_orderkey", wanted).select("l_orderkey", "l_linenumber")


@register("src_12_children", 'SELECT segment_id, start FROM segments WHERE session_id = 1', "segments")
def _(t):
    return t.segments.filter("session_id = 1").orderBy("start").select("segment_id", "start")


@register("src_13_recent", "SELECT session_id, created FROM sessions ORDER BY created DESC, session_id LIMIT 3", "sessions")
def _(t):
    return imports.newest_first(t.sessions.select("session_id", "created"), "created", "session_id", 3)


@register("src_14_conversation", "SELECT turn, role, text FROM conversations WHERE conv_id = 1")
def _(t):
    return t.conversations.filter("conv_id = 1").orderBy("turn").select("turn", "role", "text")


@register("src_15_memory_scan", "SELECT doc_id, quality FROM labels")
def _(t):
    return imports.newest_first(t.labels.select("doc_id", "quality"), "doc_id", "doc_id")


@register("src_16_corpus_decode", "SELECT vec_id, len(embedding) = 64 AND vec_id % 7 <> 0 AS usable FROM embeddings")
def _(t):
    """The decoded corpus of a table to which rows were added after the first look."""
    damaged = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vector"))
    table = VersionedTable(t.spark, _folder(t, "chunks"), ["vec_id"])
    cache = CorpusCache(t.spark, table, lambda rows: decode_chunks(rows, 64))
    for half in (0, 1):
        table.append(damaged.filter(F.col("vec_id") % 2 == half))
        corpus = cache.corpus()
    return corpus.select("vec_id", F.col("vector").isNotNull().alias("usable"))


@register("src_17_update_stream", "SELECT session_id, seq, is_final FROM updates", "updates")
def _(t):
    folder = _folder(t, "updates")
    _updates(t).write.json(folder)
    return _drain(t, transcripts.read_updates(t.spark, folder, 100).select("session_id", "seq", "is_final"), "append").drop("batch")


@register("src_18_generator", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
    SELECT doc_id AS session_id, i AS segment_id, i * 6.0::DOUBLE AS start, text FROM l WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
def _(t):
    return imports.generated_segments(t.docs.select("id", "text")).select("session_id", "segment_id", "start", "text")


@register("src_19_knowledge", "SELECT 'document' AS source_type, doc_id AS id, created FROM docs UNION ALL SELECT 'session', session_id, created FROM sessions", "docs sessions")
def _(t):
    a = t.docs.select(F.lit("document").alias("source_type"), "id", "created")
    b = t.sessions.select(F.lit("session").alias("source_type"), F.col("session_id").alias("id"), "created")
    return a.unionByName(b).orderBy(F.desc("created"), "source_type", "id")


@register("src_20_catalogue", """WITH m AS (SELECT p_partkey AS model_id, p_type AS kind, p_partkey % 5 = 0 AS is_default FROM part), d AS (SELECT kind, min(model_id) AS first FROM m WHERE is_default GROUP BY kind),
    a AS (SELECT o_orderkey AS ask_id, p_type AS kind, o_custkey AS wanted FROM orders JOIN part ON p_partkey = o_orderkey % 50 + 1)
    SELECT ask_id, coalesce(m.model_id, first) AS model_id FROM a LEFT JOIN m ON m.kind = a.kind AND m.model_id = a.wanted LEFT JOIN d ON d.kind = a.kind""")
def _(t):
    """Parts as models, their type as the kind; each order asks for a model by number, which often is of another kind."""
    models = t.part.select(F.col("p_partkey").alias("model_id"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 5 == 0).alias("is_default"))
    kinds = t.part.select(F.col("p_partkey"), F.col("p_type").alias("kind"))
    asked = t.orders.join(kinds, F.col("p_partkey") == F.col("o_orderkey") % 50 + 1).select(F.col("o_orderkey").alias("ask_id"), "kind", F.col("o_custkey").alias("wanted"))
    return imports.catalogue(models, asked)


# Sinks


def _updates(t: Tables) -> DataFrame:
    from skein.operators.relations import update_stream

    return update_stream(t.conversations).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col("seq")))


def _drain(t: Tables, stream: DataFrame, mode: str, feeds: tuple = ()) -> DataFrame:
    """All that a stream yields for what is there now, and after each of ``feeds``, as stored rows with their batch number."""
    out, marks = _folder(t, "stream-out"), _folder(t, "stream-marks")
    schema = stream.schema

    def keep(rows: DataFrame, batch: int) -> None:
        # A batch that comes again overwrites its own folder.
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for feed in (lambda: None, *feeds):
        feed()
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    return t.spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(out)


@register("snk_1_append", "SELECT vec_id, label FROM embeddings")
def _(t):
    """Two batches, the second delivered twice."""
    table = VersionedTable(t.spark, _folder(t, "chunks"), ["vec_id"])
    for batch in (0, 1, 1):
        table.append(t.embeddings.filter(F.col("vec_id") % 2 == batch).select("vec_id", "label"), ("load", batch))
    return table.read()


@register("snk_2_orphans", "SELECT e.event_id, e.event_id IN (SELECT vec_id FROM embeddings) AS has_parent FROM events e")
def _(t):
    kept, orphans = tables.split_orphans(t.events.select("event_id"), t.embeddings.select(F.col("vec_id").alias("event_id")), "event_id")
    return kept.withColumn("has_parent", F.lit(True)).unionByName(orphans.withColumn("has_parent", F.lit(False)))


@register("snk_3_update_segment", "SELECT conv_id * 1000 + turn AS segment_id, CASE WHEN turn = 0 THEN text || ' (edited)' ELSE text END AS text FROM conversations")
def _(t):
    changes = t.segments.filter("turn = 0").select("segment_id", F.concat("text", F.lit(" (edited)")).alias("text"))
    return tables.update(t.segments.select("segment_id", "text"), changes, "segment_id", ["text"])


@register("snk_4_update_session", "SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'Renamed' ELSE title END AS title, CASE WHEN session_id % 2 = 0 THEN 1.0 ELSE duration END AS duration, created FROM sessions", "sessions")
def _(t):
    changes = t.sessions.filter("session_id % 2 = 0").select("session_id", F.lit("Renamed").alias("title"), F.lit(1.0).alias("duration"))
    return tables.update(t.sessions.select("session_id", "title", "duration", "created"), changes, "session_id", ["title", "duration"])


@register("snk_5_setters", "SELECT doc_id, CASE WHEN quality = 1 THEN 'ready' ELSE 'none' END AS state FROM labels")
def _(t):
    rows = t.labels.select("doc_id", F.lit("none").alias("state"))
    return tables.update(rows, t.labels.filter("quality = 1").select("doc_id", F.lit("ready").alias("state")), "doc_id", ["state"])


@register("snk_6_rename", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Fresh ' || doc_id ELSE 'Kept' END AS title FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("lang") == "en", "Meeting").otherwise("Kept").alias("title"))
    titles = t.documents.select("doc_id", F.concat(F.lit("Fresh "), F.col("doc_id").cast("string")).alias("title"))
    return tables.rename_placeholder(rows, titles, "doc_id", F.lit("Meeting"))


@register("snk_7_reindex", "SELECT label, vec_id, 'old' AS version FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 3) UNION ALL SELECT label, vec_id + 1000000, 'new' FROM embeddings WHERE vec_id < 3")
def _(t):
    """The labels of three rows indexed anew, twice with one batch number; only their buckets are copied."""
    table = VersionedTable(t.spark, _folder(t, "index"), ["label"])
    table.append(t.embeddings.select("label", "vec_id", F.lit("old").alias("version")))
    fresh = t.embeddings.filter("vec_id < 3").select("label", (F.col("vec_id") + 1000000).alias("vec_id"), F.lit("new").alias("version"))
    for _ in range(2):
        table.replace(fresh, token=("reindex", 0))
    return table.read()


@register("snk_8_rebuild")
def _(t):
    """Documents and sessions over an older index, in one commit."""
    index = indexing.ChunkIndex.at(t.spark, _folder(t, "index"))
    index.rebuild(indexing.document_items(t.docs.filter("id % 2 = 0").select((F.col("id") + 10_000_000).alias("id"), "text")))
    statuses = index.rebuild(indexing.document_items(t.docs), indexing.session_items(t.segments))
    counts = index.table.read().groupBy(*indexing.KEYS).agg(F.count("*").alias("chunks"), F.sum("words").alias("words"))
    return statuses.join(counts, indexing.KEYS, "left").select(*indexing.KEYS, "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("words", F.lit(0)).alias("words"))


@register("snk_8_rebuild_failures", """WITH i AS (SELECT 'document' AS source_type, doc_id AS source_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'session', conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FROM conversations GROUP BY conv_id)
    SELECT source_type, source_id, CASE WHEN length(text) > 5000 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN length(text) > 5000 THEN 0 ELSE (length(text) + 499) // 500 END::BIGINT AS chunks FROM i""")
def _(t):
    """Pieces of 500 characters, ten at most: longer items fail by themselves, and what was indexed of them before is gone."""

    def pieces(body: str) -> list[tuple[str, int, int]]:
        if len(body) > 5000:
            raise ValueError("more than ten pieces")
        return [(body[k : k + 500], k, 1) for k in range(0, len(body), 500)]

    path = _folder(t, "index")
    indexing.ChunkIndex.at(t.spark, path, chunker=lambda body: [(body, 0, 1)]).rebuild(indexing.document_items(t.docs))
    index = indexing.ChunkIndex.at(t.spark, path, chunker=pieces)
    statuses = index.index(indexing.document_items(t.docs).unionByName(indexing.session_items(t.segments)))
    counts = index.table.read().groupBy(*indexing.KEYS).agg(F.count("*").alias("chunks"))
    return statuses.join(counts, indexing.KEYS, "left").select(*indexing.KEYS, "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@register("snk_9_cascade", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def _(t):
    gone = t.orders.filter("o_custkey % 10 = 0").select("o_orderkey")
    left = tables.delete(t.orders.select("o_orderkey"), gone, "o_orderkey")
    return left.unionAll(tables.delete(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), gone, "o_orderkey"))


@register("snk_10_wipe", "SELECT count(*) AS before, 0::BIGINT AS after FROM embeddings")
def _(t):
    folder = _folder(t, "wiped")
    tables.append(t.embeddings.select("vec_id", "label"), folder)
    before = t.spark.read.parquet(folder).count()
    tables.wipe(t.embeddings.select("vec_id", "label"), folder)
    return t.spark.read.parquet(folder).agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


@register("snk_11_clear", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 1")
def _(t):
    return t.conversations.filter("conv_id != 1").select("conv_id", "turn")


@register("snk_12_upsert", "SELECT vec_id, 2::BIGINT AS version FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 5 <> 0")
def _(t):
    stored = t.embeddings.select("vec_id", F.lit(1).cast("long").alias("version"))
    both = tables.upsert(stored, t.embeddings.filter("vec_id % 2 = 0").select("vec_id", F.lit(2).cast("long").alias("version")), "vec_id", "version")
    return tables.delete(both, t.embeddings.filter("vec_id % 2 = 1 and vec_id % 5 = 0").select("vec_id"), "vec_id")


CLOCK = "printf('%02d:%02d:%02d', (turn * 6) // 3600, ((turn * 6) // 60) % 60, (turn * 6) % 60)"
DUR = "CASE WHEN turns * 6 >= 60 THEN printf('%dm %ds', (turns * 6) // 60, (turns * 6) % 60) ELSE printf('%ds', turns * 6) END"
DATE = "strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M')"


def _sessions(t):
    return t.sessions.withColumn("created_at", F.timestamp_seconds("created"))


@register("snk_13_markdown", f"""WITH b AS (SELECT conv_id, string_agg('**[' || {CLOCK} || ']** ' || text, chr(10) ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
    SELECT session_id, '# ' || title || chr(10) || chr(10) || '**Date:** ' || {DATE} || chr(10) || '**Duration:** ' || {DUR} || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || l || chr(10) AS body
    FROM sessions JOIN b ON conv_id = session_id""", "sessions")
def _(t):
    return tables.transcript(_sessions(t), t.segments)


@register("snk_14_plain", f"""WITH b AS (SELECT conv_id, string_agg('[' || {CLOCK} || '] ' || text, chr(10) ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
    SELECT session_id, title || chr(10) || 'Date: ' || {DATE} || chr(10) || 'Duration: ' || {DUR} || chr(10) || chr(10) || l || chr(10) AS body FROM sessions JOIN b ON conv_id = session_id""", "sessions")
def _(t):
    return tables.transcript(_sessions(t), t.segments, markdown=False)


@register("snk_15_summary", """SELECT doc_id, text || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '**Key Decisions**' || chr(10) || '- ' || text || chr(10) || chr(10) ELSE '' END ||
    '**Action Items**' || chr(10) || '- call' || CASE WHEN doc_id % 3 = 0 THEN ' (Dana)' ELSE '' END || chr(10) || '- write' || chr(10) AS body FROM documents""")
def _(t):
    none = F.array().cast("array<string>")
    owner = F.when(F.col("doc_id") % 3 == 0, F.lit("Dana"))
    summary = F.struct(
        F.col("text").alias("overview"), F.when(F.col("doc_id") % 2 == 0, F.array("text")).otherwise(none).alias("key_decisions"),
        F.array(F.struct(F.lit("call").alias("text"), owner.alias("owner")), F.struct(F.lit("write").alias("text"), F.lit(None).cast("string").alias("owner"))).alias("action_items"),
        none.alias("risks"), none.alias("open_questions"),
    )
    return t.documents.select("doc_id", summary.alias("s")).select("doc_id", tables.summary_markdown(F.col("s")).alias("body"))


@register("snk_16_export_all", f"""WITH b AS (SELECT conv_id, string_agg('**[' || {CLOCK} || ']** ' || text, chr(10) ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
    n AS (SELECT *, regexp_replace(translate(title, '/\\:?%*|"<>', '----------'), '^\\s+|\\s+$', '', 'g') AS s FROM sessions)
    SELECT CASE WHEN s = '' THEN 'Session' ELSE s END || '-' || session_id AS file_name, length('# ' || title || chr(10) || chr(10) || '**Date:** ' || {DATE} || chr(10) || '**Duration:** ' || {DUR} || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || l || chr(10) || chr(10))::BIGINT AS n_chars
    FROM n JOIN b ON conv_id = session_id""", "sessions")
def _(t):
    bodies = tables.transcript(_sessions(t), t.segments).join(t.sessions.select("session_id", "title"), "session_id")
    name = F.concat(text.file_name(F.col("title")), F.lit("-"), F.col("session_id").cast("string"))
    folder = _folder(t, "export")
    tables.export_all(bodies.select(name.alias("file_name"), "body"), folder)
    return tables.exported(t.spark, folder).select("file_name", F.length("value").cast("long").alias("n_chars"))


@register("snk_17_reminders", r"""SELECT conv_id, turn, s AS reminder, 'From meeting: ' || conv_id || CASE WHEN role <> 'system' THEN chr(10) || 'Owner: ' || role ELSE '' END AS notes FROM
    (SELECT *, regexp_replace(CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END, '^\s+|\s+$', '', 'g') AS s FROM conversations) WHERE s <> ''""")
def _(t):
    items = t.conversations.select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("role") != "system", F.col("role")).alias("owner"), F.col("conv_id").cast("string").alias("title"),
    )
    return tables.reminders(items).select("conv_id", "turn", "reminder", "notes")


# Streams


@register("str_1_latest_volatile", """SELECT user_id::VARCHAR AS session_id, max(event_id) AS seq, max_by(event_type, event_id) AS text FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'purchase'""")
def _(t):
    updates = t.events.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), (F.col("event_type") == "purchase").alias("is_final"))
    return transcripts.latest_volatile(updates)


@register("str_2_assembly_stream", ASSEMBLY, "updates")
def _(t):
    """Three parts in order of seq, each a micro-batch whatever its files, so that the state goes on from batch to batch."""
    folder = _folder(t, "updates")
    updates = _updates(t)
    cuts = updates.agg(F.max("seq").alias("n")).first()["n"] or 0

    def feed(k: int) -> None:
        part = updates.filter((F.col("seq") > cuts * k // 3 - (k == 0)) & (F.col("seq") <= cuts * (k + 1) // 3))
        part.repartition("session_id").sortWithinPartitions("session_id", "seq").write.mode("append").json(folder)

    feed(0)
    stream = transcripts.read_updates(t.spark, folder, ALL_FILES)
    changed = _drain(t, stateful.assemble_stream(stream), "update", tuple(partial(feed, k) for k in (1, 2)))
    newest = Window.partitionBy("session_id", "line").orderBy(F.desc("batch"))
    return changed.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("session_id", "line", "text", "start", "end")


@register("str_3_running_text", """WITH u AS (SELECT conv_id::VARCHAR AS session_id, turn AS seq, text, turn % 2 = 0 AS f FROM conversations)
    SELECT session_id, seq, trim(coalesce(string_agg(CASE WHEN f THEN text END, ' ') OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') || ' ' || CASE WHEN f THEN '' ELSE text END) AS combined FROM u""")
def _(t):
    updates = t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "text", (F.col("turn") % 2 == 0).alias("is_final"))
    return transcripts.running_text(updates)


@register("str_4_sentences")
def _(t):
    from skein.operators.sentences import sentences

    return t.documents.select("doc_id", sentences("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("md5"))


@register("str_5_pauses", """SELECT event_id, round(gap, 3) AS gap FROM (SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1000000.0::DOUBLE AS gap FROM events) WHERE gap IS NULL OR gap >= 1800 - 0.000001""")
def _(t):
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return transcripts.pauses(events, "user_id", "ts", 1800.0).select("event_id", F.round("gap", 3).alias("gap"))


@register("str_5_turn_ends", """WITH e AS (SELECT user_id::VARCHAR AS session_id, event_type AS text, epoch_us(ts) // 1000 AS ms FROM events),
    c AS (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY ms, text) AS before FROM e),
    d AS (SELECT *, lead(ms) OVER (PARTITION BY session_id ORDER BY ms, text) AS following FROM c WHERE before IS NULL OR before <> text)
    SELECT session_id, text, ms + 1800000 AS ended_ms FROM d WHERE following - ms >= 1800000 OR following IS NULL AND ms + 1800000 <= (SELECT max(ms) FROM e)""")
def _(t):
    """Each user's events as partial texts, in files by time that are a micro-batch each; half an hour without a change ends a turn."""
    folder = _folder(t, "partials")
    rows = t.events.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        lo, hi = (first + (last - first) * n / 4 for n in (k, k + 1))
        part = rows.filter((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if k < 3 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema("session_id string, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    ended = _drain(t, stateful.turn_ends(stream, 1_800_000), "append")
    return ended.select("session_id", "text", F.unix_millis("ended_at").alias("ended_ms"))


@register("str_6_interruptions", """WITH e AS (SELECT user_id AS key, event_id AS seq, (map {'view': 'start', 'click': 'began', 'purchase': 'ended_resume', 'error': 'reset', 'login': 'ended'})[event_type] AS n, event_id % 10 AS z FROM events),
    v AS (SELECT key, seq, CASE z WHEN 7 THEN 'route_changed' WHEN 9 THEN 'stop' ELSE coalesce(n, 'other') END AS event FROM e),
    f AS (SELECT key, list_prepend([{'q': -1::BIGINT, 'e': '', 's': 'idle', 'c': NULL::VARCHAR}], list([{'q': seq, 'e': event, 's': '', 'c': NULL::VARCHAR}] ORDER BY seq)) AS u FROM v GROUP BY key),
    l AS (SELECT key, list_reduce(u, lambda a, x: list_append(a, {'q': x[1].q, 'e': x[1].e,
        's': CASE WHEN x[1].e = 'start' AND a[-1].s = 'idle' THEN 'recording' WHEN x[1].e = 'began' AND a[-1].s = 'recording' THEN 'paused' WHEN x[1].e = 'ended_resume' AND a[-1].s = 'paused' THEN 'recording' WHEN x[1].e = 'stop' THEN 'idle' ELSE a[-1].s END,
        'c': CASE WHEN x[1].e = 'began' AND a[-1].s = 'recording' THEN 'pauseCapture' WHEN x[1].e = 'ended_resume' AND a[-1].s = 'paused' THEN 'resumeCapture' WHEN x[1].e = 'ended' AND a[-1].s = 'paused' THEN 'surfacePausedState'
             WHEN x[1].e = 'route_changed' AND a[-1].s = 'recording' THEN 'reinstallTap' WHEN x[1].e = 'reset' AND a[-1].s <> 'idle' THEN 'rebuildEngine' END})) AS a FROM f)
    SELECT key, r.q AS seq, r.e AS event, r.s AS state, r.c AS command FROM (SELECT key, unnest(a) AS r FROM l) WHERE r.q >= 0""")
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("view", "start", "click", "began", "purchase", "ended_resume", "error", "reset", "login", "ended")])
    event = F.when(F.col("event_id") % 10 == 7, "route_changed").when(F.col("event_id") % 10 == 9, "stop").otherwise(F.coalesce(names[F.col("event_type")], F.lit("other")))
    return meetings.run_states(t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), event.alias("event")))


@register("str_7_tee", "SELECT 'first' AS sink, count(*) AS updates FROM updates UNION ALL SELECT 'second', count(*) FROM updates WHERE is_final", "updates")
def _(t):
    folder, one, two = (_folder(t, name) for name in ("updates", "tee-first", "tee-second"))
    _updates(t).write.json(folder)
    kept = lambda path: VersionedTable(t.spark, path, ["session_id"])
    every, final = sink(kept(one), "tee"), sink(kept(two), "tee")
    transcripts.tee(transcripts.read_updates(t.spark, folder, 100), every, lambda rows, batch: final(rows.filter("is_final"), batch), _folder(t, "tee-marks")).awaitTermination()
    counted = lambda name, path: kept(path).read().agg(F.lit(name).alias("sink"), F.count("*").alias("updates"))
    return counted("first", one).union(counted("second", two))


@register("str_8_newest", "SELECT event_id, event_type, (SELECT greatest(count(*) - 64, 0) FROM events)::BIGINT AS dropped FROM events ORDER BY event_id DESC LIMIT 64")
def _(t):
    """All events came before the reader's first look: the newest 64 are kept."""
    folder = _folder(t, "log")
    t.events.select("event_id", "event_type").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    t.spark.dataSource.register(newest.NewestRows)
    stream = t.spark.readStream.format(newest.NewestRows.name()).schema("event_id long, event_type string, dropped long").load(folder)
    return _drain(t, stream, "append").drop("batch")
