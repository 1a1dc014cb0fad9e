"""Dates on cards, Gregorian and Hijri, as Column expressions.

The Hijri calendar is a table of month starts, made once on the driver from the JVM's Umm al-Qura chronology: 2,400
numbers for the years 1300 to 1499, which expressions hold as a constant array. The JVM's calendar may differ by a day
from other tables in early years.
"""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.functions import text

YEARS = (1300, 1499)
_YMD = r"([0-9]{4})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})"
_DMY = r"([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{4})"


@functools.cache
def _months(_: int, jvm) -> tuple[tuple[int, int, int, int], ...]:
    """(year, month, first day as days since 1970, length)."""
    chrono = jvm.java.time.chrono.HijrahChronology.INSTANCE
    out, at = [], None
    for y in range(YEARS[0], YEARS[1] + 1):
        for m in range(1, 13):
            at = chrono.date(y, m, 1).toEpochDay() if at is None else at
            n = chrono.date(y, m, 1).lengthOfMonth()
            out.append((y, m, int(at), int(n)))
            at += n
    return tuple(out)


def month_table(spark: SparkSession) -> DataFrame:
    rows = _months(0, spark._jvm)
    return spark.createDataFrame(list(rows), "hy int, hm int, first int, days int")


def hijri(year: Column, month: Column, day: Column) -> Column:
    """The date of a Hijri day, or null where there is no such day."""
    rows = _months(0, SparkSession.active()._jvm)
    starts = F.split(F.lit(",".join(str(r[2]) for r in rows) + f",{rows[-1][2] + rows[-1][3]}"), ",").cast("array<int>")
    at = ((year - YEARS[0]) * 12 + month - 1).cast("int")
    inside = year.between(*YEARS) & month.between(1, 12) & (day >= 1)
    first, after = F.get(starts, at), F.get(starts, at + 1)
    return F.when(inside & (day <= after - first), F.date_add(F.lit(datetime.date(1970, 1, 1)), (first + day - 1).cast("int")))


def hijri_to_gregorian(df: DataFrame, year: str, month: str, day: str, into: str) -> DataFrame:
    """df with a date column: null where the day doesn't exist."""
    return df.withColumn(into, hijri(F.col(year), F.col(month), F.col(day)))


def gregorian_to_hijri(df: DataFrame, date: str, into: str) -> DataFrame:
    """df with dd/mm/yyyy in the Hijri calendar; an equi-join on the Gregorian month brings the two months in question."""
    t = month_table(df.sparkSession)
    first = F.date_add(F.lit(datetime.date(1970, 1, 1)), F.col("first"))
    t = t.select("hy", "hm", first.alias("f"), F.date_add(first, F.col("days") - 1).alias("l"))
    months = F.sequence(F.trunc("f", "month"), F.trunc("l", "month"), F.expr("interval 1 month"))
    t = F.broadcast(t.withColumn("gm", F.explode(months)))
    out = df.join(t, (F.trunc(date, "month") == t["gm"]) & F.col(date).between(t["f"], t["l"]), "left")
    told = F.concat(F.lpad(F.datediff(date, "f") + 1, 2, "0"), F.lit("/"), F.lpad("hm", 2, "0"), F.lit("/"), F.col("hy").cast("string"))
    return out.withColumn(into, told).drop("hy", "hm", "f", "l", "gm")


def parts(c: Column) -> Column:
    """struct(y, m, d) of the first year-month-day in a text, else day-month-year; nulls if there is none."""
    t = text.normalize_digits(c)
    ymd, number = t.rlike(_YMD), lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    pick = lambda a, b: F.when(ymd, number(_YMD, a)).otherwise(number(_DMY, b))
    return F.struct(pick(1, 3).alias("y"), pick(2, 2).alias("m"), pick(3, 1).alias("d"))


def gregorian(y: Column, m: Column, d: Column) -> Column:
    """The date, or null if there is no such day."""
    joined = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), F.try_to_date(joined, "yyyy-MM-dd"))


def parse_date(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with the date a text holds; years of the Hijri range are converted. Columns beginning with __p are taken."""
    df = df.withColumn("__p", parts(F.col(column))).withColumns({"__y": F.col("__p.y"), "__m": F.col("__p.m"), "__d": F.col("__p.d")})
    df = hijri_to_gregorian(df, "__y", "__m", "__d", "__h")
    lunar = F.col("__y").between(*YEARS)
    return df.withColumn(into, F.when(lunar, F.col("__h")).otherwise(gregorian(F.col("__y"), F.col("__m"), F.col("__d")))).drop("__p", "__y", "__m", "__d", "__h")


def _plausible(d: Column) -> Column:
    return F.when(F.year(d).between(1900, 2100), d)


def find_dates(c: Column) -> Column:
    """Every year-month-day of a text that is a Gregorian date, in order."""
    each = F.regexp_extract_all(text.normalize_digits(F.coalesce(c, F.lit(""))), F.lit(_YMD), F.lit(0))
    number = lambda x, k: F.regexp_extract(x, _YMD, k).try_cast("int")
    return F.array_compact(F.transform(each, lambda x: gregorian(number(x, 1), number(x, 2), number(x, 3))))


def _cuts(s: Column) -> list[tuple[Column, int, int]]:
    """Where 9 or 10 digits may hold misread separators: (condition, place of the month, place of the day)."""
    at = lambda k: s.substr(k + 1, 1)
    nine, ten = F.length(s) == 9, F.length(s) == 10
    return [(nine & (at(6) == "8"), 4, 7), (nine & (at(4) == "8"), 5, 7), (ten & (at(4) == at(7)) & at(4).isin("7", "8", "1"), 5, 8)]


def repair_separators(df: DataFrame, digits: str, into: str) -> DataFrame:
    """df with the date that a column of 9 or 10 digits holds, one or two of which are misread separators. Years of the
    Hijri range are converted."""
    s, found = F.col(digits), []
    for k, (hit, month, day) in enumerate(_cuts(s)):
        cut = lambda at, n: F.when(hit, s.substr(at + 1, n).try_cast("int"))  # noqa: B023, E731
        df = df.withColumns({"__ry": cut(0, 4), "__rm": cut(month, 2), "__rd": cut(day, 2)})
        df = hijri_to_gregorian(df, "__ry", "__rm", "__rd", "__lunar")
        own = F.when(F.col("__ry").between(*YEARS), F.col("__lunar")).otherwise(_plausible(gregorian(F.col("__ry"), F.col("__rm"), F.col("__rd"))))
        df = df.withColumn(f"__r{k}", own).drop("__ry", "__rm", "__rd", "__lunar")
        found.append(f"__r{k}")
    return df.withColumn(into, F.coalesce(*found)).drop(*found)


def _held(df: DataFrame) -> DataFrame:
    """df, its columns worked out here: Spark puts expressions into each other over projections, but not over explode."""
    return df.select(F.explode(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("__held")).select("__held.*")


def resolve_date(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with struct(date, multiplier, note): the first reading that gives a date, from the surest to the least.

    What the readings share is held before they use it, which keeps it out of the generated code above them.
    """
    c = F.col(column)
    chunks = text.digit_chunks(c)
    own = {"__k": chunks, "__year": F.regexp_extract(text.normalize_digits(c), "([0-9]{4})", 1).try_cast("int")}
    for how, seq in (("natural", chunks), ("reversed", F.reverse(chunks))):
        s = F.array_join(seq, "")
        own |= {f"__{how}": s, f"__j_{how}": parts(F.array_join(seq, "/"))}
    df = _held(parse_date(_held(df.withColumns(own)), column, "__direct"))
    readings = {}
    for how in ("natural", "reversed"):
        s = F.col(f"__{how}")
        df = df.withColumns({"__y": s.substr(1, 4).try_cast("int"), "__m": s.substr(5, 2).try_cast("int"), "__d": s.substr(7, 2).try_cast("int")})
        j = F.col(f"__j_{how}")
        df = df.withColumns({
            f"__head_{how}": _plausible(gregorian(F.col("__y"), F.col("__m"), F.col("__d"))),
            f"__short_{how}": gregorian(F.lit(2000) + s.substr(1, 2).try_cast("int"), s.substr(3, 2).try_cast("int"), s.substr(5, 2).try_cast("int")),
            f"__again_{how}": _plausible(gregorian(j["y"], j["m"], j["d"])),
        })
        df = hijri_to_gregorian(df, "__y", "__m", "__d", f"__lunar_{how}").drop("__y", "__m", "__d")
        df = _held(repair_separators(_held(df), f"__{how}", f"__rep_{how}"))
        n = F.length(s)
        lunar, head = F.col(f"__lunar_{how}"), F.col(f"__head_{how}")
        readings |= {
            f"sep_repair_{how}": (F.col(f"__rep_{how}"), 0.7),
            f"8digits_hijri_{how}": (F.when(n == 8, lunar), 0.7 if how == "natural" else 0.65),
            f"8digits_{how}": (F.when(n == 8, head), 0.7 if how == "natural" else 0.65),
            f"8digits_trailing_{how}": (F.when(n.isin(9, 10), F.coalesce(lunar, head)), 0.7),
            f"yymmdd_{how}": (F.when((n == 6) & (F.size("__k") == 3), F.col(f"__short_{how}")), 0.6),
            f"rejoined_{how}": (F.col(f"__again_{how}"), 0.6),
        }
    out = lambda d, m, note: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(m).cast("double").alias("multiplier"), F.lit(note).alias("note")))
    direct = _plausible(F.col("__direct"))
    first = [out(F.when(F.col("__year").between(*YEARS), direct), 0.7, "direct_hijri"), out(direct, 1.0, "direct")]
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit(0.0).alias("multiplier"), F.when(F.coalesce(c, F.lit("")) == "", "empty").when(F.size("__k") == 0, "no_digits").otherwise("unparseable").alias("note"))
    told = df.withColumn(into, F.coalesce(*first, *(out(d, m, note) for note, (d, m) in readings.items()), none))
    return told.drop(*(x for x in told.columns if x.startswith("__")))
