"""WARC archives: writing pages as records, and reading records by verified boundary chains.

Writing.  The first page (smallest id) of those with equal payloads becomes a ``response``, the others
``revisit`` records that refer to it.  A record's block is an HTTP head and the payload (revisits: the
head alone).  A row of the written frame is one record, the text writer puts the record's end mark
between rows, so the archives come out of Spark's own committer on any file system it can write to.

Reading.  Files are split by Spark.  Each task cuts its split at the record magic and emits, for each
cut, the offset of the magic and the offset at which the record announced there would end.  Bytes that
only look like a record, inside a payload, are candidates like any other.  Pointer jumping from the
start of each file keeps what can be reached from there: in every round the set of reached offsets
grows by the successors 2^k steps on, and the successor table is squared, so n records take log2(n)
rounds.  Pieces between reached offsets belong to the record before them.

Edge cases: null html has an empty payload; null URLs leave out their header; control characters and
blanks in a URL are percent-encoded.  Pages without an id are responses.  Rows that share the smallest
id of their payload are all responses.  A payload may contain whole archives.  An empty table gives no
file, and an empty folder no rows.  A record that is cut off at the end of its file is not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgrid.llm.common import hinted, let
from rillgrid.staging import release, settle

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HTTP_BYTES = len(HTTP)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PER_FILE = 20_000  # records of a file


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of the 40 hexadecimal digits of a SHA-1."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column) -> Column:
    """The text of a record without its end mark, from the columns id, url, payload, digest, bytes, first."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = kind == "revisit"
    target = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), "[\u0080-   ]", "%20")
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", kind), F.coalesce(line("WARC-Record-ID", name(F.col("id"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")), F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.lit(HTTP_BYTES) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = PER_FILE, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "none") -> None:
    """Write a record per row of ``pages``; payloads of fewer than ``least`` bytes are never revisits."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    # only payloads that repeat are joined; while they are few, the pages stay where they are
    firsts = rows.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = settle(firsts, "firsts")
    met = rows.join(hinted(firsts, firsts.count()), "sha", "left").withColumn("digest", base32(F.col("sha")))
    kind = F.when((F.col("bytes") >= least) & (F.col("id") > F.col("first")), "revisit").otherwise("response")
    lines = met.select(_record(kind).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between one magic and the next: file, place in the file (block, seq), text, bytes."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.octet_length("value").cast("long").alias("bytes"), "value",
    )


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head, F.lit("\r\n")), rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def candidates(cut: DataFrame) -> DataFrame:
    """A row per piece with its header fields, and what can be said of it from the piece alone.

    ``body`` is the number of bytes from the magic to the block, ``length`` that of the block; ``sha`` is of the
    payload if the piece holds the whole block, else null.
    """
    head = F.substring_index("value", END, 1)
    named = cut.withColumn("head", F.when(F.locate(END, F.col("value")) > 0, head))
    length = F.expr("try_cast(length_text AS BIGINT)")
    named = named.withColumn("length_text", _header(F.col("head"), "Content-Length")).withColumn("length", length)
    named = named.withColumn("body", F.octet_length("head") + len(MAGIC) + len(END))
    whole = F.col("bytes") + len(MAGIC) >= F.col("body") + F.col("length")
    return named.select(
        "file", "block", "seq", "bytes", "length", "body",
        _header(F.col("head"), "WARC-Type").alias("type"), _header(F.col("head"), "WARC-Record-ID").alias("name"),
        _header(F.col("head"), "WARC-Refers-To").alias("refers"), _header(F.col("head"), "WARC-Payload-Digest").alias("said"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"), _header(F.col("head"), "X-Payload-Length").cast("long").alias("full"),
        F.when(whole, _payload_sha(F.col("value").cast("binary"), F.col("body") - len(MAGIC), F.col("length"))).alias("found"),
    )


def _payload_sha(raw: Column, at: Column, length: Column) -> Column:
    """(bytes, sha) of the payload in ``length`` bytes of ``raw`` after ``at``: what follows the HTTP head."""

    def of(block: Column) -> Column:
        skip = F.locate(END, block.cast("string"))
        head = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
        return F.when(
            skip > 0,
            let(F.substring(block, (head + 1).cast("int"), (F.octet_length(block) - head).cast("int")), lambda p: F.struct(F.octet_length(p).cast("long").alias("n"), F.sha1(p).alias("sha"))),
        )

    return let(F.substring(raw, (at + 1).cast("int"), length.cast("int")), of)


def _placed(rows: DataFrame) -> DataFrame:
    """Offsets: a running sum inside a block on top of the sum of the blocks before it."""
    step = F.col("bytes") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("sum"), F.min("seq").alias("first_seq"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("inner", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    # the text of a piece begins behind its magic
    return near.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("inner") - len(MAGIC)).drop("base", "inner")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at) of the candidates of ``chain`` (file, at, next) that the start of their file leads to."""
    spark = chain.sparkSession
    jump = settle(chain.select("file", "at", "next").where("next IS NOT NULL"), "jump")
    # a successor that is no candidate ends the chain
    jump_now = jump
    reached = settle(chain.where("at = 0").select("file", "at"), "reached")
    longest = chain.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < max(2, 2 * longest):
        more = reached.join(jump_now, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = settle(reached.union(more).distinct(), "reached")
        step *= 2
        if step < max(2, 2 * longest):
            squared = jump_now.join(jump_now.select("file", F.col("at").alias("next"), F.col("next").alias("next2")), ["file", "next"])
            squared = settle(squared.select("file", "at", F.col("next2").alias("next")), "jump")
            release(spark, jump_now)
            jump_now = squared
        release(spark, reached)
        reached = grown
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``.

    Columns: file, at, type, name, refers, url, payload_bytes, payload_digest, intact.  Responses are measured
    from their payload, and ``intact`` tells whether the digest in the header agrees; revisits carry what their
    header says of the payload they refer to.
    """
    cut = pieces(spark, path)
    rows = settle(_placed(candidates(cut)), "candidates")
    ends = rows.groupBy("file").agg(F.max(F.col("at") + len(MAGIC) + F.col("bytes")).alias("size"))
    valid = rows.where("at >= 0 AND length >= 0 AND type IS NOT NULL").withColumn("next", F.col("at") + F.col("body") + F.col("length") + len(END))
    fitting = valid.join(ends, "file").where(F.col("next") <= F.col("size"))
    kept = reachable(fitting.select("file", "at", "next"))
    records = settle(fitting.join(kept, ["file", "at"]), "records")
    parted = settle(_parted(records.where("found IS NULL").select("file", "at", "body", "length"), rows, cut), "parted")
    whole = records.join(parted, ["file", "at"], "left").withColumn("found", F.coalesce("found", "parted"))
    response = F.col("type") == "response"
    digest = F.when(response, base32(F.col("found.sha"))).otherwise(F.regexp_replace("said", "^sha1:", ""))
    return whole.select(
        "file", "at", "type", "name", "refers", "url",
        F.when(response, F.col("found.n")).otherwise(F.col("full")).alias("payload_bytes"), digest.alias("payload_digest"),
        F.when(response, F.concat(F.lit("sha1:"), digest) == F.col("said")).alias("intact"),
    )


def _parted(split: DataFrame, rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, at, parted) of records whose block holds the magic: their pieces are put together again."""
    if not split.take(1):
        return split.select("file", "at", F.lit(None).cast("struct<n:bigint,sha:string>").alias("parted"))
    heads = split.select("file", F.col("at").alias("p"), F.lit(True).alias("own"))
    order = Window.partitionBy("file").orderBy("at")
    # small rows only: each piece learns the record it lies in
    owned = rows.where("at >= 0").select("file", "block", "seq", "at", "bytes").join(heads, (rows.file == heads.file) & (F.col("at") == F.col("p")), "left").drop(heads.file)
    owned = owned.withColumn("record", F.last("p", ignorenulls=True).over(order)).where("record IS NOT NULL")
    owned = owned.join(split.select("file", F.col("at").alias("record"), "body", "length"), ["file", "record"]).where(
        F.col("at") < F.col("record") + F.col("body") + F.col("length")
    )
    texts = cut.select("file", "block", "seq", "value").join(owned.select("file", "block", "seq", "at", "record", "body", "length"), ["file", "block", "seq"])
    # a record's block is one value, as it was before it was written
    joined = texts.groupBy("file", "record", "body", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    raw = F.concat_ws(MAGIC, F.transform("parts", lambda x: x["value"])).cast("binary")
    return joined.select("file", F.col("record").alias("at"), _payload_sha(raw, F.col("body") - len(MAGIC), F.col("length")).alias("parted"))
