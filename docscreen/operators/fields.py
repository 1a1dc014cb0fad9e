"""From labels' values to normalised fields: each kind of field by its own rule, with the confidence it deserves.

Input rows: doc_id, field, raw, value_conf, score (the label's), is_national, and second, what the other script's copy of
a date says, if any. Every rule gives (normalized, confidence, note, warning). Second looks at an image are not made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen.functions import dates, fuzzy, numbers, text
from docscreen.operators import lookups

NUMBERS, DATES = ("iqama_no", "employer_id"), ("expiry_date", "birth_date")
#: First digits that an employer's identifier may have; a holder's begins with 1 or 2 by the kind of document.
EMPLOYER_PREFIXES = "127"
#: The least confidence of an identifier with length, prefix and check digit in order; of an exact name; of two dates.
SURE_NUMBER, SURE_NAME, SURE_DATE = 0.86, 0.8, 0.9


def _number(raw: Column, prefixes: Column) -> Column:
    number = lambda r: F.struct(F.when(F.length(r["number"]) == 10, r["number"]).alias("number"), r["multiplier"].alias("m"), r["note"].alias("note"), numbers.luhn_ok_10(r["number"]).alias("ok"), prefixes.contains(r["number"].substr(1, 1)).alias("prefix"))
    return numbers.bound(numbers.resolve_ten_digits(raw, prefixes), number)


def normalised(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows with normalized, confidence, note and warning. entries is the coded list of nationalities."""
    f = F.col("field")
    base = F.col("value_conf") * fuzzy.label_factor(F.col("score"))
    df = rows.withColumn("base", base)
    # each expensive reading once, in a column of its own
    prefixes = F.when(f == "employer_id", EMPLOYER_PREFIXES).when(F.col("is_national"), "1").otherwise("2")
    df = df.withColumn("num", F.when(f.isin(*NUMBERS), _number(F.col("raw"), prefixes)))
    df = df.withColumns({"as_date": F.when(f.isin(*DATES), F.col("raw")), "other_date": F.when(f.isin(*DATES), F.col("second")), "as_name": F.when(f == "nationality", F.col("raw"))})
    # a card's dates are few: each different text is read once
    printed = df.select(F.explode(F.array("as_date", "other_date")).alias("printed")).where("printed is not null").distinct()
    read = dates.resolve_date(printed, "printed", "read")
    df = df.join(read.withColumnsRenamed({"printed": "__1", "read": "d"}), F.col("as_date") == F.col("__1"), "left").join(read.withColumnsRenamed({"printed": "__2", "read": "d2"}), F.col("other_date") == F.col("__2"), "left")
    nothing = F.struct(F.lit(None).cast("date").alias("date"), F.lit(0.0).alias("multiplier"), F.lit("empty").alias("note"))
    df = df.withColumn("d", F.coalesce("d", nothing))
    df = lookups.code_of(df, entries, "as_name", "code")
    n, d, d2 = F.col("num"), F.col("d"), F.col("d2.date")
    number_conf = F.round(F.col("base") * F.when(n["number"].isNotNull(), n["m"]).otherwise(0.3), 3)
    sure = n["number"].isNotNull() & (n["m"] >= 1) & n["ok"] & n["prefix"]
    date_conf = F.round(F.col("base") * F.when(d["date"].isNotNull(), d["multiplier"]).otherwise(0.0), 3)
    met = d["date"].isNotNull() & d2.isNotNull()
    alike = met & (F.abs(F.datediff(d2, d["date"])) <= 2)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    exact = F.col("code").isNotNull() & (F.col("code_multiplier") == 1)
    name_conf = F.when(exact, F.greatest("base", F.lit(SURE_NAME))).otherwise(F.col("base") * F.when(F.col("code").isNotNull(), F.col("code_multiplier")).otherwise(0.0))
    digits = F.nullif(F.regexp_replace(text.normalize_digits(F.col("raw")), "[^0-9]", ""), F.lit(""))
    return df.select(
        *rows.columns,
        F.when(f.isin(*NUMBERS), n["number"]).when(f.isin(*DATES), day(d["date"])).when(f == "nationality", F.col("code")).when(f == "version_no", digits).otherwise(text.clean(F.col("raw"))).alias("normalized"),
        F.when(f.isin(*NUMBERS), F.when(sure, F.greatest(number_conf, F.lit(SURE_NUMBER))).otherwise(number_conf))
        .when(f.isin(*DATES), F.when(alike, F.greatest(date_conf, F.lit(SURE_DATE))).when(met, F.round(date_conf * 0.6, 3)).otherwise(date_conf))
        .when(f == "nationality", F.round(name_conf, 3))
        .otherwise(F.round("base", 3)).alias("confidence"),
        F.when(f.isin(*NUMBERS), n["note"])
        .when(f.isin(*DATES), F.concat(d["note"], F.when(alike, " xcheck_ok").when(met, F.concat(F.lit(" xcheck_mismatch("), day(d2), F.lit(")"))).otherwise("")))
        .when(f == "nationality", F.when(F.coalesce("raw", F.lit("")) == "", "empty").when(exact, "exact").when(F.col("code").isNotNull(), "fuzzy").otherwise("unmatched")).alias("note"),
        F.when(met & ~alike, F.concat(f, F.lit(": the two printed dates differ ("), day(d["date"]), F.lit(" and "), day(d2), F.lit(")"))).alias("warning"),
    )


def forced_nationality(fields: DataFrame, kinds: DataFrame, code: str) -> DataFrame:
    """Fields (doc_id, field, raw, normalized, confidence, source, note) of which identity cards (kinds: doc_id,
    doc_type) have the country's own nationality, whatever was read."""
    national = kinds.where("doc_type = 'NATIONAL_ID'").select("doc_id").distinct()
    own = national.select("doc_id", F.lit("nationality").alias("field"), F.lit(None).cast("string").alias("raw"), F.lit(code).alias("normalized"), F.lit(1.0).alias("confidence"), F.lit("derived").alias("source"), F.lit("national_id").alias("note"))
    others = fields.join(national.withColumn("__national", F.lit(True)), "doc_id", "left").where(F.col("__national").isNull() | (F.col("field") != "nationality")).drop("__national")
    return others.select(own.columns).unionByName(own)


def wide(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row for each document: a column for each field's value, and its confidence in <field>_conf."""
    pick = lambda n, c: F.max(F.when(F.col("field") == n, F.col(c)))
    return fields.groupBy("doc_id").agg(*(pick(n, "normalized").alias(n) for n in names), *(pick(n, "confidence").alias(f"{n}_conf") for n in names))
