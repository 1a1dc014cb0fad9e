"""The audit log, masking on the way in, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.functions import text

ACTIONS = (
    "BATCH_CREATED", "UPLOAD_REJECTED", "DOCUMENT_UPLOADED", "DOCUMENT_REQUEUED", "BATCH_PROCESS_STARTED",
    "BATCH_PROCESS_DONE", "DOCUMENT_PROCESSED", "DOCUMENT_FAILED", "IMAGE_DELETED", "COMPANY_SET", "FIELDS_CORRECTED",
    "REVIEW_SUBMITTED", "REPORT_EXPORTED", "PERMIT_TEMPLATE_UPLOADED", "PERMIT_EXPORTED", "DOCUMENT_DELETED",
    "BATCH_DELETED", "RETENTION_PURGE", "BATCH_PROJECT_UPDATED", "PII_UNMASKED_LIST", "PII_UNMASKED", "IMAGE_VIEWED",
    "RULES_UPDATED", "RULES_RELOADED", "OCCUPATION_UPSERTED",
)


def masked(c: Column, kind: T.DataType) -> Column:
    """Every string inside a column with its identifiers masked, whatever the nesting."""
    if isinstance(kind, T.StringType):
        return text.mask_identifiers(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: masked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: masked(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(masked(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def masked_rows(df: DataFrame) -> DataFrame:
    return df.select(*(masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def filtered(log: DataFrame, action: str | None = None, actor: str | None = None, since=None, limit: int = 200) -> DataFrame:
    """Newest rows under all filters at once; filters reach the scan."""
    out = log
    for column, wanted in (("action", action), ("actor", actor)):
        out = out.where(F.col(column) == wanted) if wanted is not None else out
    out = out.where(F.col("ts") >= F.lit(since)) if since is not None else out
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(min(limit, 2000))


def expired(batches: DataFrame, now: Column, days: int) -> DataFrame:
    return batches.where(F.col("created_at") < now - F.make_dt_interval(F.lit(days)))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A cascade: rows whose key is not among those that went."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def tombstoned(documents: DataFrame, final: DataFrame, now: Column) -> DataFrame:
    """Images of documents with a final decision (or exported) deleted, with the time; earlier times stay."""
    hit = final.select("doc_id").distinct().withColumn("__gone", F.lit(True))
    out = documents.join(hit, "doc_id", "left")
    return out.withColumns({"image_deleted_at": F.coalesce("image_deleted_at", F.when(F.col("__gone"), now)), "image": F.when(F.col("__gone").isNull(), F.col("image"))}).drop("__gone")


def requeued(documents: DataFrame) -> DataFrame:
    """Rows left in work by a stopped process go back to the queue."""
    return documents.withColumn("status", F.when(F.col("status") == "PROCESSING", "QUEUED").otherwise(F.col("status")))


def stale_batches(documents: DataFrame) -> DataFrame:
    return documents.where("status = 'PROCESSING'").select("batch_id").distinct().orderBy("batch_id")


def purged(batches: DataFrame, children: dict[str, DataFrame], now: Column, days: int, actor: str = "retention") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """A retention run: the batches that stay, the child tables (with batch_id) without those that went, and the audit
    rows of what went."""
    gone = expired(batches, now, days).select("batch_id")
    log = gone.select(F.lit("RETENTION_PURGE").alias("action"), F.lit(actor).alias("actor"), F.lit("batch").alias("entity_type"), F.col("batch_id").cast("string").alias("entity_id"), now.alias("ts"))
    return without(batches, gone, "batch_id"), {k: without(v, gone, "batch_id") for k, v in children.items()}, log


def appended(rows: DataFrame, path: str) -> None:
    """Audit rows at the end of a table, with identifiers masked and their date as partition."""
    if bad := [r["action"] for r in rows.where(~F.col("action").isin(*ACTIONS)).select("action").distinct().limit(5).collect()]:
        raise ValueError(f"unknown actions {bad}")
    masked_rows(rows).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def requeue_log(documents: DataFrame, now: Column, actor: str = "startup") -> DataFrame:
    """An audit row for each document that requeued() takes back."""
    return documents.where("status = 'PROCESSING'").select(F.lit("DOCUMENT_REQUEUED").alias("action"), F.lit(actor).alias("actor"), F.lit("document").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"), now.alias("ts"))
