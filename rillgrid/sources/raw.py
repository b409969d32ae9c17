"""Raw text inputs: CSV in mixed encodings, nested API pages, feature collections."""

from __future__ import annotations

import bz2
import gzip
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgrid.session import ship

FILES = 100_000  # names of files that may be broadcast
KOREAN = "MS949"


def files_not_utf8(spark: SparkSession, path: str) -> DataFrame:
    """``(_file)``: the files with a line whose bytes are no UTF-8."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return lines.where(~F.is_valid_utf8("value")).select("_file").distinct()


def read_csv_kr(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV as UTF-8; files that hold bytes which are no UTF-8 are read as cp949 instead.

    The choice is made per file on the bytes of its lines, so a replacement character that stands in a valid
    file changes nothing.  The Korean charset needs ``spark.sql.legacy.javaCharsets``, which is set where
    such a file is found.
    """
    columns = T.StructType.fromDDL(schema)
    reader = spark.read.schema(columns).option("header", header)
    source = F.col("_metadata.file_path").alias("_file")
    bad = files_not_utf8(spark, path)
    utf8 = reader.option("encoding", "UTF-8").csv(path)
    n = bad.count()
    if not n:
        return utf8
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = F.broadcast(bad) if n <= FILES else bad
    good = utf8.select("*", source).join(names, "_file", "left_anti")
    cp949 = reader.option("encoding", KOREAN).csv(path).select("*", source).join(names, "_file", "left_semi")
    return good.unionByName(cp949).drop("_file")


def load_years(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a glob in one scan, with their names; broken rows keep their text in ``_corrupt``.

    A file that cannot be read to its end, such as a broken archive, gives the rows before the break and stops
    no other file; ``file_status`` tells such files.
    """
    full = T.StructType.fromDDL(schema).add("_corrupt", "string")
    return (
        spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("ignoreCorruptFiles", True).csv(pattern).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    )


def file_status(spark: SparkSession, pattern: str) -> DataFrame:
    """``(file, path, bytes, lines, status)`` for every file of a glob, in one pass: ``ok``, or ``broken`` where an archive cannot be unpacked to its end.

    ``lines`` are those before the break.  Tasks unpack piece by piece, so a file takes its stored size in memory (at most 2 GB, the limit
    of a value).  Files of no bytes have no row, as Spark's readers pass them over.
    """
    ship(spark)

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(path.rsplit("/", 1)[-1], path, len(body), *_unpacked(path, body)) for path, body in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(out, columns=["file", "path", "bytes", "lines", "status"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(tried, "file string, path string, bytes long, lines long, status string")


def _unpacked(path: str, body: bytes) -> tuple[int, str]:
    opened = {".gz": gzip.open, ".bz2": bz2.open}.get(path[path.rfind("."):].lower(), lambda raw: raw)
    lines, last = 0, b""
    try:
        with opened(io.BytesIO(body)) as whole:
            while piece := whole.read(1 << 20):
                lines, last = lines + piece.count(b"\n"), piece[-1:]
    except (EOFError, OSError, zlib.error):
        return lines, "broken"
    return lines + (last not in (b"", b"\n")), "ok"


def broken_files(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files of a glob that cannot be read to their end."""
    return [r["file"] for r in file_status(spark, pattern).where("status <> 'ok'").select("file").orderBy("file").collect()]


def api_items(raw: DataFrame, column: str, item_schema: str) -> DataFrame:
    """Items of ``response.body.items.item`` as rows, a list of them or a single one; pages without the path give none."""
    item = T.StructType.fromDDL(item_schema)
    found = F.get_json_object(column, "$.response.body.items.item")
    listed = F.when(found.startswith("["), F.from_json(found, T.ArrayType(item))).when(found.startswith("{"), F.array(F.from_json(found, item)))
    return raw.select(F.explode(listed).alias("i")).select("i.*")


def unreadable_pages(raw: DataFrame, column: str) -> DataFrame:
    """One row: how many pages there are, and how many of them are no JSON and so give no items."""
    broken = F.col(column).isNull() | F.try_parse_json(column).isNull()
    return raw.agg(F.count(F.lit(1)).alias("pages"), F.count_if(broken).alias("unreadable"))


def union_pages(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Every stored page below a folder in one scan; empty pages add nothing."""
    return api_items(spark.read.text(path, wholetext=True), "value", item_schema)


def geojson_features(raw: DataFrame, column: str, properties: str) -> DataFrame:
    """FeatureCollection texts to one row per vertex: properties, ring, seq, x, y.

    Polygons and multi-polygons are accepted; the closing vertex of a ring is dropped.
    """
    def shape(coordinates):
        return T.StructType().add("features", T.ArrayType(
            T.StructType()
            .add("properties", T.StructType.fromDDL(properties))
            .add("geometry", T.StructType().add("type", "string").add("coordinates", coordinates))
        ))

    ring = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    one = raw.select(F.explode(F.from_json(column, shape(ring)).getField("features")).alias("f")).where(
        F.col("f.geometry.type") == "Polygon"
    ).select("f.properties", F.lit(0).alias("part"), F.posexplode("f.geometry.coordinates").alias("ring", "pts"))
    many = raw.select(F.explode(F.from_json(column, shape(T.ArrayType(ring))).getField("features")).alias("f")).where(
        F.col("f.geometry.type") == "MultiPolygon"
    ).select("f.properties", F.posexplode("f.geometry.coordinates").alias("part", "rings")).select(
        "properties", "part", F.posexplode("rings").alias("ring", "pts")
    )
    return one.unionByName(many).select("properties.*", "part", "ring", F.size("pts").alias("_n"), F.posexplode("pts").alias("seq", "pt")).where(
        F.col("seq") < F.col("_n") - 1
    ).select("*", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y")).drop("pt", "_n")
