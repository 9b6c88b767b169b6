"""Deterministic sharded WARC writer and reader.

Records are dealt by ranges of page ids into shards. The number of shards follows from the bytes alone and their
bounds from a sample of page ids chosen by hash, so that neither depends on the cluster's settings. A task sorts its
shards, rolls their files by compressed size, makes all headers and digests anew from the payload, writes under a
temporary name and renames when a file is whole; a shard's manifest, renamed last, names its files with sizes and
digests. The manifest table, committed when all tasks have ended, names the files of the whole run, and readers take
only files named there. Names and bytes depend on the rows alone, so an attempt that finds a file already in place
leaves it. Paths may be of any file system that pyarrow opens.

Equal payloads of at least ``min_revisit`` bytes: the smallest page id has a response record, the others revisit it.
Blocks are HTTP messages: a regenerated head, and in responses the payload. Null html is the empty payload; rows with
a null page id are responses, never referred to, in shards of their own. Rows with equal page id and payload are
responses alike. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, read, scratch, stored
from skein.sources.shared import file_system as _filesystem

#: All records carry this date: output depends on the input only.
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
#: Shards of SHARD_BYTES, but up to MOST_SHARDS only; beyond, of 256 MB.
SHARD_BYTES, MOST_SHARDS, LARGE_SHARD_BYTES = 16 << 20, 2000, 256 << 20
#: Sampled page ids for each bound between shards (8 bytes each).
SAMPLED = 64
#: File lists up to this length are broadcast.
MANY_FILES = 10_000
#: Revisits up to this number (about 100 bytes each) are broadcast.
MANY_REVISITS = 200_000
EOL = b"\r\n"
#: Bytes given to the decompressor at once.
PIECE = 1 << 14


def _commit(files, temporary: str, final: str) -> None:
    """Rename a whole file to its name, unless an earlier attempt has put the equal file there."""
    from pyarrow import fs

    size = files.get_file_info(temporary).size
    for attempt in (0, 1):
        there = files.get_file_info(final)
        if there.type != fs.FileType.NotFound and there.size == size:
            return
        try:
            files.move(temporary, final)
            return
        except OSError:  # another attempt was faster: its file is looked at once more
            if attempt:
                raise


def record_id(page_id: int | None, digest: str) -> str:
    """A UUID-shaped name made of a record's own content."""
    h = hashlib.sha256(f"{page_id}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + EOL + block + EOL + EOL


def _gzip(data: bytes) -> bytes:
    """One gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def http_head(size: int) -> bytes:
    """The regenerated head of the HTTP response that brought a payload."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + EOL + EOL


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response with the payload, or a revisit of the page it equals."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    block = http_head(len(payload)) + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _record(headers, block)


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page id with an equal payload, null for responses.

    Digests are pre-aggregated before the shuffle, and only those of several pages are joined back.
    """
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)
    sized = pages.select("page_id", "url", "html").withColumn("digest", digest)
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit
    firsts = sized.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("digest", "first")
    keys = pages.select("page_id", F.when(large, digest).alias("digest")).filter("digest is not null and page_id is not null")
    revisits = keys.join(firsts, "digest").filter("page_id <> first").select("page_id", "digest", "first").distinct()
    # Only the short keys of revisits travel; up to a checked number they are broadcast and the html stays in place.
    revisits = stored(revisits, "warc-revisits")
    if revisits.limit(MANY_REVISITS + 1).count() <= MANY_REVISITS:
        revisits = F.broadcast(revisits)
    joined = sized.join(revisits, ["page_id", "digest"], "left")
    return joined.select("page_id", "url", "html", F.col("first").alias("refers_to"))


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Sorted page ids at which shards begin, by bytes, from page ids sampled by hash: about SAMPLED for each shard."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    total, n = pages.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("page_id")).first()
    shards = max(1, min(-(-total // shard_bytes), max(MOST_SHARDS, -(-total // LARGE_SHARD_BYTES))))
    if shards == 1 or n == 0:
        return []
    rate = max(1, n // (SAMPLED * shards))
    picked = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(rate)) == 0).groupBy("page_id").agg(F.sum(size).alias("bytes"))
    sample = sorted((r.page_id, r.bytes) for r in picked.filter("page_id is not null").collect())
    weight, bounds, at = sum(b for _, b in sample), [], 0
    for page, size_here in sample:
        if at * shards >= weight * (len(bounds) + 1):
            bounds.append(page)
        at += size_here
    return bounds


def _sharded(marked: DataFrame, bounds: list[int]) -> DataFrame:
    """``marked`` with its shard: the number of bounds up to the page id; null page ids have shards after those, by hash."""
    from pyspark.ml.feature import Bucketizer

    shards = len(bounds) + 1
    key = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(shards)) + shards)
    splits = sorted({float(b) for b in bounds})  # doubles keep the order
    if splits:
        found = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="place", outputCol="bucket", handleInvalid="keep")
        marked = found.transform(marked.withColumn("place", F.col("page_id").cast("double"))).drop("place")
    else:
        marked = marked.withColumn("bucket", F.lit(0.0))
    return marked.select(F.coalesce(key, F.col("bucket").cast("long")).cast("long").alias("shard"), "page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, root: str, bounds: list[int], roll_bytes: int = ROLL_BYTES) -> str:
    """Write the records below ``root``, in shards that begin at ``bounds``; the path of the manifest that commits them."""
    tasks = 2 * (len(bounds) + 1)
    ordered = _sharded(marked, bounds).repartition(tasks, "shard").sortWithinPartitions("shard", "page_id", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = _filesystem(root)
        temporary = f"{path}/_temporary/{TaskContext.get().taskAttemptId()}"
        done: list[dict] = []  # of all shards of the task
        listed: list[dict] = []  # of the shard at hand
        buffer: list[bytes] = []
        held = records = 0
        shard = None

        def put(name: str, data: bytes) -> None:
            files.create_dir(temporary, recursive=True)
            with files.open_output_stream(f"{temporary}/{name}", compression=None) as f:
                f.write(data)
            _commit(files, f"{temporary}/{name}", f"{path}/{name}")

        def roll() -> None:
            nonlocal held, records
            if buffer:
                name, data = f"part-{shard:06d}-{len(listed):05d}.warc.gz", b"".join(buffer)
                put(name, data)
                listed.append({"name": name, "bytes": len(data), "records": records, "sha256": hashlib.sha256(data).hexdigest()})
            buffer.clear()
            held = records = 0

        def finish() -> None:
            roll()
            if listed:
                put(f"part-{shard:06d}.manifest.json", json.dumps({"shard": shard, "files": listed}, sort_keys=True).encode())
            done.extend(listed)
            listed.clear()

        slices = (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256))
        for part in slices:
            for own, page, url, html, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != shard:
                    finish()
                    shard = own
                if not buffer:
                    info = _record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(-1, f"{shard}/{len(listed)}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "18")],
                        b"format: WARC/1.1\r\n",
                    )
                    buffer.append(_gzip(info))
                    held = len(buffer[0])
                member = _gzip(make_record(page, url, (html or "").encode("utf-8"), refers))
                buffer.append(member)
                held += len(member)
                records += 1
                if held >= roll_bytes:
                    roll()
        finish()
        rows = [[x[k] for x in done] for k in ("name", "bytes", "records", "sha256")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())],
            ["name", "bytes", "records", "sha256"],
        )

    manifest = f"{root}/manifest"
    schema = "name string, bytes long, records long, sha256 string"
    map_batches(ordered, write, schema).write.parquet(manifest)
    files, path = _filesystem(root)
    if files.get_file_info(f"{path}/_temporary").type.name == "Directory":
        files.delete_dir(f"{path}/_temporary")
    return manifest


RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, read in pieces: what follows a member is looked at once."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        out = []
        while not z.eof and at < len(view):
            piece = view[at : at + PIECE]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError("an archive ends inside a record")
        yield b"".join(out)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; digests are checked."""
    head, _, rest = member.partition(EOL + EOL)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != EOL + EOL:
        raise ValueError("a record's length is wrong")
    stated = headers.get("warc-block-digest")
    if stated and stated != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's block digest is wrong")
    return headers, block


def read_archives(spark, root: str) -> DataFrame:
    """The page records of the archives that the manifest names. Payloads of revisits are null."""
    listed = spark.read.schema("name string, bytes long, records long, sha256 string").parquet(f"{root}/manifest")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = F.broadcast(listed.select("name")) if listed.limit(MANY_FILES + 1).count() <= MANY_FILES else listed.select("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for member in _members(content.as_py()):
                    headers, block = parse_record(member)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    payload = block.partition(EOL + EOL)[2]
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a record's payload digest is wrong")
                    page, refers = headers["x-page-id"], headers.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, headers["warc-target-uri"], None if revisit else payload, int(headers["x-payload-length"]), digest, headers["warc-type"], int(refers) if refers else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    archives = found.join(named, "name", "left_semi")
    return map_batches(archives.select("content"), run, RECORD_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORD_SCHEMA.split(", ")])


def op6_warc(spark, sf_dir):
    root = scratch(spark, "warc")
    pages = read(spark, sf_dir, "pages")
    write_archives(mark_revisits(pages), root, shard_bounds(pages))
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
