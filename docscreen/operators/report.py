"""Summaries, filters and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen.functions import text
from docscreen.operators import lookups

DISCLAIMER = "Decision support only; a person remains responsible for the outcome."


def batch_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters of each batch over rows with status, error and the checks' labels."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = F.col("status")
    return rows.groupBy(*(keys or ("batch_id",))).agg(
        F.count("*").alias("total"),
        n(s == "APPROVED").alias("approved"),
        n(s == "REJECTED").alias("rejected"),
        n(s == "MANUAL_REVIEW").alias("manual_review"),
        n(F.col("expiry_label") == "EXPIRED").alias("expired"),
        n(F.col("employer_label") == "INDIVIDUAL").alias("individual_employer"),
        n(F.col("occupation_label").isin("EXCLUDED", "EXCLUDED_FUZZY")).alias("excluded_occupation"),
        n(F.col("nationality_label") == "NOT_APPROVED").alias("nationality_not_approved"),
        n(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def confidence_stats(fields: DataFrame, critical: tuple[str, ...]) -> DataFrame:
    """Least and mean confidence of a document's critical fields."""
    return fields.where(F.col("field").isin(*critical)).groupBy("doc_id").agg(F.round(F.min("confidence"), 2).alias("conf_min"), F.round(F.avg("confidence"), 2).alias("conf_avg"))


def progress(documents: DataFrame) -> DataFrame:
    return documents.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("DONE", "ERROR")).alias("processed"))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "; ")


def note_of(triggers: Column, prefix: str) -> Column:
    """What follows the first ": " of the first trigger with a prefix."""
    hit = F.get(F.filter(triggers, lambda t: t.startswith(prefix)), F.lit(0))
    return F.when(hit.contains(": "), F.substr(hit, F.instr(hit, ": ") + 2))


def by_decision(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of a decision; ERROR is a status of the document."""
    return rows.where(F.col("document_status" if wanted == "ERROR" else "status") == wanted)


def by_trigger(rows: DataFrame, wanted: str) -> DataFrame:
    return rows.where(F.lower(F.array_join(F.concat("triggers", "reasons"), " ")).contains(wanted.lower()))


def by_text(rows: DataFrame, fields: Column, filename: Column, wanted: str) -> DataFrame:
    """Case-insensitive, over the fields as JSON (names included) and the file's name."""
    return rows.where(F.lower(F.concat(F.to_json(fields), F.coalesce(filename, F.lit("")))).contains(wanted.lower()))


def newest(rows: DataFrame, limit: int, most: int, *order: str) -> DataFrame:
    return rows.orderBy(*(F.desc(c) for c in order)).limit(max(0, min(limit, most)))


def export_rows(rows: DataFrame, unmask: bool = False) -> DataFrame:
    """The wide report, a row for each document, from rows of checks.decided()."""
    hide = (lambda c: F.col(c)) if unmask else (lambda c: text.mask_id(F.col(c)))
    label = lambda k: F.col(f"check_{k}.label")
    d = F.col("decision")
    opt = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    name = F.concat(opt("file_name"), F.when(F.coalesce(opt("page_no").cast("int"), F.lit(1)) > 1, F.concat(F.lit(" (p"), opt("page_no"), F.lit(")"))).otherwise(""))
    return rows.select(
        "doc_id",
        name.alias("file_name"),
        hide("iqama_no").alias("iqama_no"),
        opt("name_ar"),
        opt("name_en"),
        "nationality",
        "occupation",
        F.col("match.name_en").alias("occupation_en"),
        opt("occupation_code"),
        "employer_name",
        hide("employer_id").alias("employer_id"),
        label("EMPLOYER").alias("employer_type"),
        opt("issue_place"),
        "expiry_date",
        F.datediff("expiry_date", "as_of").alias("days_remaining"),
        label("EXPIRY").alias("expiry_status"),
        label("NATIONALITY").alias("nationality_status"),
        label("OCCUPATION").alias("occupation_status"),
        label("EMPLOYER").alias("employer_status"),
        F.coalesce(d["status"], opt("document_status")).alias("final_decision"),
        numbered(d["reasons"]).alias("rejection_reasons"),
        F.array_join(d["triggers"], "; ").alias("review_triggers"),
        opt("conf_min"),
        opt("conf_avg"),
        "quality",
        opt("reviewed_by"),
        opt("reviewed_at"),
        d["rules_version"].alias("rules_version"),
        "layout",
        note_of(d["triggers"], "OLD_LAYOUT").alias("note"),
        opt("error"),
    )


def export_feed(rows: DataFrame, entries: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """What the permit form is filled from: allowed statuses, the list's names joined by code, in document order."""
    one = lookups.one_per_key(entries, "code", F.desc("file_pos"))  # a code that the file repeats is one
    names = one.select(F.col("code").alias("__c"), F.col("name_en").alias("list_name_en"), F.col("name_ar").alias("list_name_ar"))
    out = rows.where(F.col("status").isin(*statuses)).join(names, F.col("nationality") == F.col("__c"), "left")
    return out.select("doc_id", F.coalesce("name_en", "name_ar").alias("name"), F.coalesce("list_name_en", "list_name_ar", "nationality").alias("nationality_name"), "iqama_no", "occupation", "company").orderBy("doc_id")


def shown_fields(fields: DataFrame, sensitive: tuple[str, ...] = ("iqama_no", "employer_id"), unmask: bool = False) -> DataFrame:
    """Fields (doc_id, field, raw, normalized, ...) as people see them: sensitive values masked, their raw text only where
    it is nothing but digits."""
    hide = F.lit(not unmask) & F.col("field").isin(*sensitive)
    digits = F.coalesce(F.trim("raw").rlike("^[0-9٠-٩۰-۹]+$"), F.lit(False))
    return fields.withColumns({"normalized": F.when(hide, text.mask_id(F.col("normalized"))).otherwise(F.col("normalized")), "raw": F.when(hide & digits, text.mask_id(F.col("raw"))).otherwise(F.col("raw"))})


def batch_rows(batches: DataFrame) -> DataFrame:
    """Batches as they are listed, with companies and project read from their JSON."""
    return batches.select(
        F.col("batch_id").alias("id"), "name", "status", "total", "processed", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "rules_version",
        F.coalesce(F.from_json("companies_json", "array<string>"), F.array().cast("array<string>")).alias("companies"),
        F.coalesce(F.from_json("project_json", "map<string, string>"), F.create_map().cast("map<string, string>")).alias("project"),
    )


_LIST = "array<string>"


def stored(decisions: DataFrame) -> DataFrame:
    """Decisions as they are kept: lists as JSON."""
    return decisions.withColumns({"reasons": F.to_json("reasons"), "triggers": F.to_json("triggers")})


def restored(decisions: DataFrame) -> DataFrame:
    """Decisions with their lists read from JSON; what is malformed or null is an empty list."""
    read = lambda c: F.coalesce(F.from_json(c, _LIST), F.array().cast(_LIST))
    return decisions.withColumns({"reasons": read("reasons"), "triggers": read("triggers")})


def collected(batches: DataFrame, documents: DataFrame, fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each batch with its documents in order, each document with its fields and decisions; none lacks for having none.

    Fields and decisions are gathered by document before documents are gathered by batch: one document's are few.
    """
    fs = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "normalized", "confidence"))).alias("fields"))
    ds = decisions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("version", "status"))).alias("decisions"))
    docs = documents.select("batch_id", "doc_id").join(fs, "doc_id", "left").join(ds, "doc_id", "left")
    each = F.array_sort(F.collect_list(F.struct("doc_id", "fields", "decisions")))
    return batches.join(docs.groupBy("batch_id").agg(each.alias("documents")), "batch_id", "left")


def column_widths(rows: DataFrame, least: int = 10, most: int = 60) -> DataFrame:
    """Width of each column of a sheet: its longest text and two, in bounds."""
    return rows.agg(*(F.least(F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) + 2, F.lit(max(least, min(most, len(c) + 2)))), F.lit(most)).alias(c) for c in rows.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    """A report file for people: UTF-8 with a byte order mark, header, rows, a blank line, the disclaimer.

    Rows stream through the driver one partition at a time; it is meant for one batch's report. Bulk exports take
    rows.write.csv().
    """
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if x is None else x for x in r])
        out.writerow([])
        out.writerow([DISCLAIMER])
