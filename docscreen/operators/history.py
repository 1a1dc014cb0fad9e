"""Versioned rows: what is current, corrections, sign-off, the review queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscreen.functions import text


def current(rows: DataFrame, *keys: str, version: str = "version") -> DataFrame:
    """The row with the highest version of each key: a partial aggregate, so no key's rows meet before they are few."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("__r"))
    return best.select(*keys, *(F.col("__r")[c].alias(c) for c in others)).select(rows.columns)


def flagged(rows: DataFrame, *keys: str, version: str = "version") -> DataFrame:
    """All rows with is_current."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("is_current", F.row_number().over(w) == 1)


def manual_value(field: Column, value: Column, date: Column, code: Column) -> Column:
    """struct(value, error) of a typed-in value; date and code are what dates.parse_date and lookups.code_of made of it."""
    v = F.trim(value)
    digits = F.regexp_replace(text.normalize_digits(v), "[^0-9]", "")
    dates, numbers = field.isin("expiry_date", "birth_date"), field.isin("iqama_no", "employer_id")
    empty = F.coalesce(v, F.lit("")) == ""
    out = F.when(dates, F.date_format(date, "yyyy-MM-dd")).when(numbers, F.when(F.length(digits) == 10, digits)).when(field == "nationality", code).otherwise(v)
    why = F.when(dates, F.concat(field, F.lit(": cannot parse date '"), v, F.lit("' (use YYYY-MM-DD)"))).when(numbers, F.concat(field, F.lit(": must be 10 digits"))).otherwise(F.concat(field, F.lit(": '"), v, F.lit("' not in the list")))
    return F.struct(F.when(~empty, out).alias("value"), F.when(~empty & out.isNull(), why).alias("error"))


def corrected(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Field rows (doc_id, field, value, confidence, source, version) after edits (doc_id, field, value, by): each edit
    is a new version with confidence 1 and source manual; older rows stay, no longer current."""
    last = fields.groupBy("doc_id", "field").agg(F.max("version").alias("__v"))
    new = edits.join(last, ["doc_id", "field"], "left").select("doc_id", "field", "value", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), (F.coalesce("__v", F.lit(0)) + 1).alias("version"))
    return flagged(fields.select(new.columns).unionByName(new), "doc_id", "field")


def redecided(fields: DataFrame, edits: DataFrame, decisions: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Fields after edits, and the decisions they lead to: corrected documents alone are validated and decided again by
    ``decide`` (current fields in, doc_id and decision out), each a version above its last; older ones stay."""
    after = corrected(fields, edits)
    now = after.where("is_current").join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
    last = decisions.groupBy("doc_id").agg(F.max("version").alias("__v"))
    by = edits.groupBy("doc_id").agg(F.min("by").alias("decided_by"))
    fresh = decide(now).select("doc_id", "decision").join(last, "doc_id", "left").join(by, "doc_id")
    new = fresh.select("doc_id", F.col("decision.status").alias("status"), (F.coalesce("__v", F.lit(0)) + 1).alias("version"), F.lit(False).alias("is_final"), "decided_by")
    return after, flagged(decisions.select(new.columns).unionByName(new), "doc_id")


def latest_review(reviews: DataFrame) -> DataFrame:
    """The last review of each document, by its number."""
    return current(reviews, "doc_id", version="review_id")


def with_company(documents: DataFrame, found: DataFrame, manual: DataFrame) -> DataFrame:
    """documents with company and company_source: what a person set (manual: doc_id, company; the last row by set_at)
    stays, whatever is found again (found: doc_id, company, company_source)."""
    own = current(manual, "doc_id", version="set_at").select("doc_id", F.trim("company").alias("__own"))
    out = documents.join(found.select("doc_id", F.col("company").alias("__auto"), F.col("company_source").alias("__source")), "doc_id", "left").join(own, "doc_id", "left")
    return out.withColumns({"company": F.coalesce("__own", "__auto"), "company_source": F.when(F.col("__own").isNotNull(), "MANUAL").otherwise(F.col("__source"))}).drop("__own", "__auto", "__source")


def signed_off(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """The decisions that reviews (doc_id, status, reasons, reviewer) make final: version + 1, the human status wins."""
    now = current(decisions, "doc_id").select("doc_id", F.col("version").alias("__v"), F.col("reasons").alias("__reasons"))
    own = F.coalesce(F.filter("reasons", lambda x: F.trim(x) != ""), F.array().cast("array<string>"))
    held = F.when(F.size(own) > 0, own).otherwise(F.coalesce("__reasons", F.array().cast("array<string>")))
    reasons = F.when(F.col("status") == "APPROVED", F.array().cast("array<string>")).when((F.col("status") == "REJECTED") & (F.size(held) == 0), F.array(F.lit("Rejected by reviewer"))).otherwise(held)
    return reviews.join(now, "doc_id").select("doc_id", "status", reasons.alias("reasons"), (F.col("__v") + 1).alias("version"), F.lit(True).alias("is_final"), F.col("reviewer").alias("decided_by"))


def queue(documents: DataFrame, decisions: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Documents whose current decision is open for a person; None is every batch, and 0 is batch 0."""
    open_ = current(decisions, "doc_id").where("status = 'MANUAL_REVIEW' and not is_final")
    out = documents.join(open_.select("doc_id"), "doc_id", "left_semi")
    return out if batch_id is None else out.where(F.col("batch_id") == batch_id)
