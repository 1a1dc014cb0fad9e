"""Dimension lookups: exact, alias, and fuzzy for what those miss. Dimensions carry file_pos, the order of their file.

Whether a dimension is broadcast is left to Spark, which knows its bytes when it runs. Names are brought to their
canonical form once for each distinct value. The fuzzy measures run over pairs that share two neighbouring letters; any
two names that reach the thresholds in use do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscreen.functions import fuzzy, text


def spelled(rows: DataFrame, column: str, into: str) -> DataFrame:
    """rows with a column's canonical form, made once for each distinct value."""
    forms = rows.select(F.col(column).alias("__raw")).where("__raw is not null").distinct().withColumn(into, text.canonical(F.col("__raw")))
    return rows.join(forms, F.col(column) == F.col("__raw"), "left").drop("__raw")


def _grams(c: Column) -> Column:
    """The distinct pairs of neighbouring letters of sorted words, edges included."""
    words = F.concat(F.lit(" "), F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " "), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(words) - 1), lambda i: F.substring(words, i, F.lit(2))))


def alike(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs of a value v and the rows of keys whose key shares a pair of letters with it."""
    left = values.select("v", F.explode(_grams(F.col("v"))).alias("__g"))
    right = keys.select("key", F.explode(_grams(F.col("key"))).alias("__g")).distinct()
    return left.join(right, "__g").select("v", "key").distinct().join(keys, "key")


def one_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def occupation_keys(occupations: DataFrame) -> DataFrame:
    """(key, method, row columns): exact keys (Arabic over English; of Arabic ones the last row, of English ones the
    first), then aliases (the first)."""
    o = occupations.withColumns({"ar": text.canonical(F.col("name_ar")), "en": text.canonical(F.col("name_en"))})
    cols = ["name_ar", "name_en", "category", "eligible", "file_pos"]
    ar = o.where("ar <> ''").select(F.col("ar").alias("key"), F.lit(0).alias("p"), (-F.col("file_pos")).alias("q"), *cols)
    en = o.where("en <> ''").select(F.col("en").alias("key"), F.lit(1).alias("p"), F.col("file_pos").alias("q"), *cols)
    exact = one_per_key(ar.unionByName(en), "key", F.col("p"), F.col("q")).drop("p", "q").withColumn("method", F.lit("exact"))
    al = o.select(F.explode(text.canonical_each(text.aliases(F.col("aliases")))).alias("key"), *cols).where("key <> ''")
    al = one_per_key(al, "key", F.col("file_pos")).withColumn("method", F.lit("alias"))
    return exact.unionByName(al)


def occupation_match(subjects: DataFrame, occupations: DataFrame, threshold: float, column: str = "occupation") -> DataFrame:
    """subjects with match: struct(name_ar, name_en, category, eligible, method, score), null if nothing matches.

    Exact and alias keys are hash joins. The fuzzy measure runs once for each distinct value that they miss.
    """
    keys = occupation_keys(occupations)
    found = F.struct("name_ar", "name_en", "category", "eligible", "method", F.col("s").alias("score"))
    rows = spelled(subjects, column, "__v")
    values = rows.select(F.col("__v").alias("v")).where("v <> ''").distinct()
    hits = values.join(keys, values["v"] == keys["key"])
    rank = F.when(F.col("method") == "exact", 0).otherwise(1)
    sure = one_per_key(hits, "v", rank).withColumn("s", F.when(F.col("method") == "exact", 1.0).otherwise(0.95))
    missed = values.join(sure.select("v"), "v", "left_anti")
    pos = F.struct(rank, "file_pos")
    pairs = alike(missed, keys).withColumn("s", fuzzy.token_set_ratio_of(F.col("v"), F.col("key")) / 100)
    best = pairs.where(F.col("s") >= threshold).groupBy("v").agg(F.max_by(F.struct("name_ar", "name_en", "category", "eligible", F.lit("fuzzy").alias("method"), F.round("s", 3).alias("score")), F.struct("s", (-pos["col1"]).alias("a"), (-pos["file_pos"]).alias("b"))).alias("match"))
    table = sure.select("v", found.alias("match")).unionByName(best)
    return rows.join(table, F.col("__v") == F.col("v"), "left").drop("v", "__v")


def list_keys(entries: DataFrame) -> DataFrame:
    """(key, code, file_pos, k): every name, code and alias of a coded list in its order; the first row wins."""
    names = F.array_compact(F.concat(F.array("name_ar", "name_en", "code"), text.aliases(F.col("aliases"))))
    keys = entries.select(F.posexplode(text.canonical_each(names)).alias("k", "key"), "code", "file_pos").where("key <> ''")
    return one_per_key(keys, "key", F.col("file_pos"), F.col("k")).select("key", "code", "file_pos", "k")


def code_of(subjects: DataFrame, entries: DataFrame, column: str, into: str = "code") -> DataFrame:
    """The code of a printed name: exact over every key, else by plain ratio of at least 80, of equal ones the first."""
    keys, rows = list_keys(entries), spelled(subjects, column, "__v")
    values = rows.select(F.col("__v").alias("v")).where("v <> ''").distinct()
    sure = values.join(keys, values["v"] == keys["key"]).select("v", "code", F.lit(1.0).alias("s"))
    missed = alike(values.join(sure.select("v"), "v", "left_anti"), keys).withColumn("s", fuzzy.ratio_of(F.col("v"), F.col("key")))
    first = F.struct("s", (-F.col("file_pos")).alias("f"), (-F.col("k")).alias("k"))
    near = missed.where("s >= 80").groupBy("v").agg(F.max_by("code", first).alias("code"), (F.round(F.max("s") / 100, 2)).alias("s"))
    table = sure.unionByName(near).select("v", F.col("code").alias(into), F.col("s").alias(f"{into}_multiplier"))
    return rows.join(table, F.col("__v") == F.col("v"), "left").drop("v", "__v")


def by_code(subjects: DataFrame, entries: DataFrame, column: str = "code") -> DataFrame:
    """Adds listed, approved and list_name by upper-cased code; the last row of a code wins."""
    one = one_per_key(entries.withColumn("__k", F.upper(F.trim("code"))), "__k", F.desc("file_pos"))
    one = one.select("__k", F.lit(True).alias("listed"), F.col("approved"), F.coalesce("name_en", "code").alias("list_name"))
    return subjects.join(one, F.upper(F.trim(F.col(column))) == one["__k"], "left").drop("__k").withColumn("listed", F.coalesce("listed", F.lit(False)))


def employer_reference(subjects: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ref_type: by id, else by canonical name; of either the last row wins."""
    ids = one_per_key(reference.where("employer_id <> ''"), "employer_id", F.desc("file_pos")).select(F.col("employer_id").alias("__i"), F.col("employer_type").alias("__ti"))
    names = reference.withColumn("__m", text.canonical(F.col("employer_name"))).where("__m <> ''")
    names = one_per_key(names, "__m", F.desc("file_pos")).select("__m", F.col("employer_type").alias("__tn"))
    out = spelled(subjects.join(ids, F.col("employer_id") == F.col("__i"), "left"), "employer_name", "__m").join(names, "__m", "left")
    return out.withColumn("ref_type", F.coalesce("__ti", "__tn")).drop("__i", "__ti", "__m", "__tn")


def company(subjects: DataFrame, threshold: float, defaults: tuple[str, ...] = ()) -> DataFrame:
    """Adds company, company_source, needs_choice from employer_name, companies (an array) and doc_type."""
    asked = F.filter(F.transform(F.coalesce("companies", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    asked = F.when(F.size(asked) > 0, asked).otherwise(F.array(*map(F.lit, defaults)).cast("array<string>"))
    subjects = subjects.withColumns({"__e": F.coalesce(text.canonical(F.col("employer_name")), F.lit("")), "__keys": text.canonical_each(asked)})
    emp = F.col("__e")
    rate = lambda x: F.greatest(fuzzy.token_set_ratio(emp, x), fuzzy.partial_ratio(emp, x)) / 100
    scored = F.transform(F.arrays_zip(asked.alias("name"), F.col("__keys").alias("key")), lambda x, i: F.struct(rate(x["key"]).alias("s"), (-i).alias("p"), x["name"].alias("name")))
    best = F.array_max(F.filter(scored, lambda x: x["s"] >= threshold))
    first = F.get(asked, F.lit(0))
    identity = F.col("doc_type") == "NATIONAL_ID"
    return subjects.withColumn("__b", F.when(~identity & (emp != ""), best)).select(
        "*",
        F.when(identity | (emp == ""), first).otherwise(F.coalesce(F.col("__b.name"), F.col("employer_name"))).alias("company"),
        F.when(identity, "NATIONAL_ID").when(F.col("__b").isNotNull(), "AUTO").otherwise("CARD").alias("company_source"),
        (~identity & F.col("__b").isNull()).alias("needs_choice"),
    ).drop("__b", "__e", "__keys")


def upsert(table: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Rows whose canonical key is new or replaced, and all others as they were."""
    key = rows.select(text.canonical(F.col(column)).alias("__k")).distinct()
    return table.withColumn("__k", text.canonical(F.col(column))).join(key, "__k", "left_anti").drop("__k").unionByName(rows, allowMissingColumns=True)


def options(card: Column, companies: Column) -> Column:
    """The card's employer and the companies without it, in order."""
    return F.concat(F.when(card.isNotNull(), F.array(card)).otherwise(F.array().cast("array<string>")), F.filter(companies, lambda x: ~x.eqNullSafe(card)))
