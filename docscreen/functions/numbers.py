"""Identifiers, checksums, geometry and quality as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docscreen.functions import text


def luhn_ok(c: Column) -> Column:
    """Digits at even places from the left (from 0) doubled; false for empty, null or anything but digits."""
    digits = F.transform(F.split(c, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    twice = F.transform(digits, lambda x, i: F.when(i % 2 == 0, F.floor(x * 2 / 10).cast("int") + x * 2 % 10).otherwise(x))
    return F.coalesce(c.rlike("^[0-9]+$") & (F.aggregate(twice, F.lit(0), lambda s, x: s + x) % 10 == 0), F.lit(False))


def luhn_ok_10(c: Column) -> Column:
    """luhn_ok for ten digits, where it is the usual checksum: stays in generated code."""
    return F.coalesce((F.length(c) == 10) & c.rlike("^[0-9]+$") & F.call_function("luhn_check", c), F.lit(False))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def resolve_ten_digits(c: Column, prefixes: str | Column) -> Column:
    """struct(number, multiplier, note) of a ten-digit identifier whose chunks may come in reversed order."""
    allowed = F.lit(prefixes) if isinstance(prefixes, str) else prefixes
    valid = lambda x: F.coalesce((x != "") & allowed.contains(x.substr(1, 1)), F.lit(False))
    yes = lambda x: F.when(x, "True").otherwise("False")
    out = lambda n, m, note: F.struct(n.alias("number"), F.lit(m).cast("double").alias("multiplier"), note.alias("note"))
    none = F.lit(None).cast("string")

    def rated(x: Column) -> Column:
        ok = luhn_ok_10(x)
        return F.struct(x.alias("n"), valid(x).alias("fits"), ok.alias("ok"), (F.when(valid(x), 2).otherwise(0) + F.when(ok, 1).otherwise(0)).alias("score"))

    def told(v: Column) -> Column:
        use_turned = v["turned"]["score"] >= v["natural"]["score"]
        best = lambda f: F.when(use_turned, v["turned"][f]).otherwise(v["natural"][f])
        top, other = F.greatest(v["natural"]["score"], v["turned"]["score"]), F.least(v["natural"]["score"], v["turned"]["score"])
        how = F.when(use_turned, "reversed").otherwise("natural")
        one = F.concat(F.lit("single_chunk(prefix_ok="), yes(best("fits")), F.lit(",luhn="), yes(best("ok")), F.lit(")"))
        order = F.concat(how, F.lit("(luhn="), yes(best("ok")), F.lit(")"))
        chunks, whole = v["chunks"], v["natural"]["n"]
        return (
            F.when(F.size(chunks) == 0, out(none, 0.0, F.lit("no_digits")))
            .when(F.size(v["exact"]) == 1, out(F.get(v["exact"], F.lit(0)), 1.0, F.lit("exact_chunk(luhn=True)")))
            .when(F.length(whole) != 10, out(whole, 0.5, F.concat(F.lit("length_"), F.length(whole))))
            .when((F.size(chunks) == 1) & (top >= 2), out(best("n"), 1.0, one))
            .when(F.size(chunks) == 1, out(best("n"), 0.7, one))
            .when(top == 0, out(best("n"), 0.5, F.lit("no_candidate_valid")))
            .when(other >= 2, out(best("n"), 0.75, F.concat(F.lit("ambiguous_order("), how, F.lit(")"))))
            .when(top >= 3, out(best("n"), 1.0, order))
            .otherwise(out(best("n"), 0.9, order))
        )

    exact = lambda ch: F.filter(ch, lambda x: (F.length(x) == 10) & valid(x) & luhn_ok_10(x))
    rate = lambda ch: F.struct(ch.alias("chunks"), rated(F.array_join(ch, "")).alias("natural"), rated(F.array_join(F.reverse(ch), "")).alias("turned"), exact(ch).alias("exact"))
    found = bound(text.digit_chunks(c), lambda ch: bound(rate(ch), told))
    return F.when(F.coalesce(c, F.lit("")) == "", out(none, 0.0, F.lit("empty"))).otherwise(found)


def differing_places(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def quality_score(width: Column, sharpness: Column, brightness: Column, glare: Column) -> Column:
    """0 to 1 from an image's metrics; narrow images never pass 0.4."""
    one = F.lit(1.0)
    size = F.when(width < 400, 0.0).otherwise(F.least(one, (width - 400) / 800.0))
    score = 0.55 * size + 0.25 * F.least(one, sharpness / 150.0) + 0.10 * (1.0 - F.least(one, F.abs(brightness - 170) / 170.0)) + 0.10 * (1.0 - F.least(one, glare / 0.30))
    return F.round(F.when(width < 600, F.least(score, F.lit(0.40))).otherwise(score), 3)


def vertical_overlap(a_top: Column, a_bottom: Column, b_top: Column, b_bottom: Column) -> Column:
    """The common height over the smaller height."""
    common = F.greatest(F.lit(0), F.least(a_bottom, b_bottom) - F.greatest(a_top, b_top))
    return common / F.greatest(F.lit(1), F.least(a_bottom - a_top, b_bottom - b_top))
