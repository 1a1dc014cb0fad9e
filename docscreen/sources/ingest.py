"""Files in: type by first bytes, acceptance, content hashes, duplicates; reference files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 25 * 1024 * 1024
MAX_FILES = 200
ALLOWED = ("image/jpeg", "image/png", "application/pdf")
#: First bytes of the accepted types.
MAGIC = ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"%PDF-", "application/pdf"))

OCR_LINES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("x", "y", "w", "h")), T.StructField("conf", T.DoubleType())])


def mime(content: Column) -> Column:
    out = F.lit("application/octet-stream")
    for head, kind in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(head)) == F.lit(head), kind).otherwise(out)
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, mime and content of the files below a folder. Files that are too large aren't read: their
    length is known to the source, and sha256, mime and content are null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = identified(raw.where(F.col("length") <= MAX_BYTES))
    large = raw.where(F.col("length") > MAX_BYTES).select(*(c for c in raw.columns if c != "content"))
    return whole.unionByName(large, allowMissingColumns=True)


def identified(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"sha256": F.sha2("content", 256), "mime": mime(F.col("content"))})


def accepted(rows: DataFrame) -> DataFrame:
    """All rows with error: null for those that are taken."""
    kind = F.concat(F.lit("unsupported or corrupt file (detected "), F.col("mime"), F.lit(")"))
    return rows.withColumn("error", F.when(F.col("length") > MAX_BYTES, f"file too large (> {MAX_BYTES >> 20} MB)").when(~F.col("mime").isin(*ALLOWED), kind))


def upload(rows: DataFrame, most: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of one upload; an upload of more than ``most`` files is refused as a whole."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files in one upload")
    told = accepted(rows)
    return told.where("error is null").drop("error"), told.where("error is not null").select("path", "error")


def totals(batches: DataFrame, documents: DataFrame) -> DataFrame:
    """batches with total, the number of their documents."""
    n = documents.groupBy("batch_id").agg(F.count("*").alias("__n"))
    return batches.join(n, "batch_id", "left").withColumn("total", F.coalesce("__n", F.lit(0))).drop("__n")


def to_process(documents: DataFrame) -> DataFrame:
    """Documents that processing takes up: queued ones, and those that failed before."""
    return documents.where(F.col("status").isin("QUEUED", "ERROR"))


def page_id(sha: Column, page_no: Column) -> Column:
    return F.sha2(F.concat(sha, page_no.cast("string")).cast("binary"), 256)


def duplicates(documents: DataFrame, key: str = "sha256") -> DataFrame:
    """duplicate_of: the smallest earlier doc_id with the same content, or null.

    The smallest id of a content is a partial aggregate joined back, so a content that many rows share isn't sorted in
    one task.
    """
    first = documents.groupBy(key).agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(key, "__first")
    return documents.join(first, key, "left").withColumn("duplicate_of", F.when(F.col("__first") < F.col("doc_id"), F.col("__first"))).drop("__first")


def reference_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A reference file as strings with file_pos, the order of its lines; a byte order mark is no part of the header."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    picked = clean.select(*(F.col(c) if c in clean.columns else F.lit(None).cast("string").alias(c) for c in columns))
    return picked.withColumn("file_pos", F.monotonically_increasing_id())


def batch(companies: list[str], defaults: list[str], rules_version: str) -> dict:
    """A new batch's row: companies trimmed, the default if there are none."""
    own = [c.strip() for c in companies if c and c.strip()]
    return {"status": "QUEUED", "companies": own or list(defaults), "rules_version": rules_version, "total": 0, "processed": 0}


def batch_table(spark: SparkSession, requests: DataFrame, defaults: list[str], rules_version: str) -> DataFrame:
    """New batches from requests (batch_id, name, companies, project): companies trimmed, the defaults if there are none."""
    own = F.filter(F.transform(F.coalesce("companies", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, defaults)).cast("array<string>"))
    return requests.select("batch_id", "name", F.lit("QUEUED").alias("status"), F.to_json(kept).alias("companies_json"), F.to_json(F.coalesce("project", F.create_map().cast("map<string, string>"))).alias("project_json"), F.lit(rules_version).alias("rules_version"), F.lit(0).alias("total"), F.lit(0).alias("processed"))


class Providers:
    """Sources of recognised boxes by name: functions from a session to a table of OCR_LINES, made when first asked."""

    def __init__(self):
        self._makers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, maker: Callable[[SparkSession], DataFrame]) -> None:
        self._makers[name] = maker

    def lines(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._makers:
            raise KeyError(f"no provider {name}; there are {sorted(self._makers)}")
        df = self._makers[name](spark)
        return df.select(*(F.col(f.name).cast(f.dataType) for f in OCR_LINES))


def canned(rows: list[tuple]) -> Callable[[SparkSession], DataFrame]:
    """A provider of given rows, for tests."""
    return lambda spark: spark.createDataFrame(rows, OCR_LINES)


def polygons(boxes: DataFrame, points: str = "points") -> DataFrame:
    """x, y, w, h around arrays of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return boxes.withColumns({"x": F.array_min(xs).cast("int"), "y": F.array_min(ys).cast("int"), "w": (F.array_max(xs) - F.array_min(xs)).cast("int"), "h": (F.array_max(ys) - F.array_min(ys)).cast("int")})


def first_seen(documents: DataFrame, key: str = "sha256") -> DataFrame:
    """The window form of duplicates(), for contents that few rows share."""
    w = Window.partitionBy(key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return documents.withColumn("duplicate_of", F.min("doc_id").over(w))


def unseen(documents: DataFrame, history: DataFrame, key: str = "sha256") -> DataFrame:
    """Documents whose content isn't in the history, which has no end."""
    return documents.join(history.select(key).distinct(), key, "left_anti")
