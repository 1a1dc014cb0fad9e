"""Printed labels on recognised boxes: found, ranked and, where they can't be read, made up for.

Label dictionaries and headers are parameters of bounded size. Similarity runs once for each distinct head of a text
against the broadcast dictionary; everything else is expressions, windows over a document's boxes and joins on doc_id.

Lines have doc_id, line, text, x, y, w, h, conf, card_w, card_h. An anchor is a label that was found: doc_id, line, part
(its place in the line), field, score, inline (the value beside it, if any), until (where the label ends in the line), ltr.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscreen.functions import fuzzy, numbers, text
from docscreen.operators import lookups

# The least scores for a label, for a box that is nothing else, and for one in the right-hand column; what
# short labels need on top; where labels and the right-hand column begin; the top band; separators.
LEAST, PURE, COLUMN = 68, 62, 58
SHORT, STRICTER = 7, 6
ZONE, RIGHT, TOP = 0.35, 0.88, 0.12
SEPARATORS = "[:：;؛]"
CROSS_CHECKED = ("expiry_date", "birth_date", "iqama_no", "employer_id")
PRINTED_DATE = r"(?<![0-9])([0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})(?![0-9])"
YEAR_FIRST = r"[0-9٠-٩]{4}/[0-9٠-٩]{1,2}/[0-9٠-٩]{1,2}"


def dictionary(spark: SparkSession, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(pos, field, label) of the labels in Arabic script, canonical and without their colon."""
    rows = [(f, v) for f, vs in labels.items() for v in vs]
    d = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(rows)], "pos int, field string, label string")
    return d.where(text.has_arabic(F.col("label")) | ~text.has_latin(F.col("label"))).withColumn("label", F.trim(F.regexp_replace(text.canonical(F.col("label")), ":+$", "")))


def latin_label(c: Column, labels: Mapping[str, Sequence[str]]) -> Column:
    """struct(field, score, until, inline) of the longest Latin label that a text begins with; null without one.

    Words of a label stand alone and may be apart or not. Labels of eight characters or more are also found by
    similarity in the text's head.
    """
    low, t = F.lower(F.trim(c)), F.trim(c)
    found = F.lit(None).cast("struct<field: string, score: double, until: int, inline: string>")
    pairs = [(f, v.lower().strip()) for f, vs in labels.items() for v in vs if re.search("[A-Za-z]", v) and not re.search("[؀-ۿ]", v)]
    for field, label in sorted(pairs, key=lambda p: len(p[1])):  # the last one tried is the first to win
        exact = F.regexp_extract(low, "^(.{0,2}(?<![a-z])" + r"\s*".join(map(re.escape, label.split())) + r"(?![a-z])\s*[:.]?\s*)", 1)
        until = F.when(exact != "", F.length(exact))
        if len(label) >= 8:
            near = fuzzy.alignment(F.lit(label), F.left(low, F.lit(len(label) + 3)))
            after = lambda n: n["end"] + F.length(F.regexp_extract(F.substring(low, n["end"] + 1, F.length(low)), r"^(\s*[:.]?\s*)", 1))
            until = until.otherwise(numbers.bound(near, lambda n: F.when((n["score"] >= 80) & (n["start"] <= 2), after(n))))  # noqa: B023
        rest = lambda u: F.regexp_replace(F.substring(t, u + 1, F.length(t)), "^[ :.]+|[ :.]+$", "")
        hit = lambda u: F.when(u.isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(100 + 0.01 * len(label)).alias("score"), u.cast("int").alias("until"), F.nullif(rest(u), F.lit("")).alias("inline")))  # noqa: B023, E731
        found = F.coalesce(numbers.bound(until, hit), found)
    return found


def is_header(c: Column, headers: Sequence[str], least: float = 80) -> Column:
    """Whether a canonical text is nearly one of the header words that are never labels."""
    return F.coalesce(F.exists(F.array(*map(F.lit, headers)).cast("array<string>"), lambda x: fuzzy.ratio(c, x) >= least), F.lit(False))


def ranked_labels(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """(head, at_start, relaxed, field, score, start, end): the best label in each distinct text.

    A label where it belongs (at the text's start, or at its end) comes before any other; then the score, to which a
    hundredth of the label's length is added; then the order of the dictionary.
    """
    pairs = heads.distinct().where(F.length("head") >= 3).crossJoin(F.broadcast(labels))  # a dictionary, of bounded size
    a = pairs.withColumn("a", fuzzy.alignment(F.col("label"), F.col("head")))
    strict = F.when(F.col("relaxed"), COLUMN).otherwise(LEAST + STRICTER)
    a = a.where((F.length("label") > SHORT) | (F.col("a.score") >= strict))
    placed = F.when(F.col("at_start"), F.col("a.start") <= 2).otherwise(F.col("a.end") >= F.length("head") - 2)
    score = F.col("a.score") + 0.01 * F.length("label")
    best = F.max_by(F.struct("field", score.alias("score"), "a.start", "a.end"), F.struct(placed.alias("p"), score.alias("s"), (-F.col("pos")).alias("o")))
    return a.groupBy("head", "at_start", "relaxed").agg(best.alias("b")).select("head", "at_start", "relaxed", "b.*")


def anchors(lines: DataFrame, labels: Mapping[str, Sequence[str]], headers: Sequence[str]) -> DataFrame:
    """Every label found in lines; a line may have several.

    What a line's label is depends on its text and its place alone (searched at all, in the right-hand column or not), so
    labels are found once for each distinct pair of both and joined to the lines.
    """
    right = F.col("x") + F.col("w")
    searched = F.coalesce((right >= ZONE * F.col("card_w")) & ~(F.col("y") + F.col("h") < TOP * F.col("card_h")), F.lit(False))
    place = F.when(~searched, 0).when(right >= RIGHT * F.col("card_w"), 2).otherwise(1)
    keyed = lines.select("doc_id", "line", "text", place.alias("place")).where("text is not null")
    found = _found(keyed.select("text", "place").distinct(), labels, headers)
    told = ["doc_id", "line", "part", "field", "score", "inline", "until", "ltr"]
    return keyed.join(found, ["text", "place"]).select(told)


def _found(texts: DataFrame, labels: Mapping[str, Sequence[str]], headers: Sequence[str]) -> DataFrame:
    """The labels of distinct (text, place), with part, field, score, inline, until and ltr."""
    key = ["text", "place"]
    # explode keeps the conditions on a text's form above distinct(): below it they would be judged for every line
    forms = texts.withColumn("norm", F.coalesce(text.canonical(F.col("text")), F.lit("")))
    forms = forms.select(F.explode(F.array(F.struct(*key, "norm", text.has_arabic(F.col("norm")).alias("arabic")))).alias("f")).select("f.*")
    known = forms.where(~F.col("arabic")).withColumn("l", latin_label(F.col("text"), labels)).where("l is not null")
    latin = known.select(*key, F.lit(0).alias("part"), "l.field", "l.score", "l.inline", "l.until", F.lit(True).alias("ltr"))
    arabic = forms.where(F.col("arabic") & (F.col("place") > 0)).where(~is_header(F.col("norm"), headers)).withColumn("column", F.col("place") == 2)
    words = dictionary(texts.sparkSession, labels)
    split = F.transform(F.split("norm", SEPARATORS), lambda x: F.trim(x))
    parts = arabic.select(*key, "column", split.alias("all"), F.posexplode(split).alias("part", "head"))
    before_last = F.col("part") < F.size("all") - 1
    # a head's own label, relaxed in the right-hand column; the next part's, by the strict measure
    asked = parts.where(before_last).select("head", F.lit(False).alias("at_start"), F.col("column").alias("relaxed"))
    asked = asked.unionByName(parts.where(before_last).select("head", F.lit(False).alias("at_start"), F.lit(False).alias("relaxed")))
    asked = asked.unionByName(arabic.select(F.col("norm").alias("head"), F.lit(True).alias("at_start"), F.col("column").alias("relaxed")))
    best = ranked_labels(asked, words)
    heads = parts.where(before_last).join(best.where("not at_start").withColumnRenamed("relaxed", "column").drop("at_start"), ["head", "column"])
    heads = heads.where(F.col("score") >= F.when(F.col("column"), COLUMN).otherwise(LEAST))
    following = best.where(f"not at_start and not relaxed and score >= {LEAST}").select(F.col("head").alias("next"), F.col("start").alias("cut"))
    inner = F.col("part") + 1 < F.size("all") - 1
    heads = heads.withColumn("next", F.get("all", F.col("part") + 1)).join(following, "next", "left")
    own = F.trim(F.when(inner & F.col("cut").isNotNull(), F.left("next", F.col("cut"))).otherwise(F.col("next")))
    w = Window.partitionBy(*key).orderBy("part")
    lead = F.nullif(F.lead(F.trim(F.left("head", F.col("start")))).over(w), F.lit(""))
    until = F.aggregate(F.slice("all", F.lit(1), F.col("part") + 1), F.lit(0), lambda s, x: s + F.length(x) + 1)
    colon = heads.select(*key, "part", "field", "score", F.nullif(F.coalesce(lead, own), F.lit("")).alias("inline"), until.alias("until"), F.lit(False).alias("ltr"))
    rest = arabic.join(colon.select(*key).distinct(), key, "left_anti")
    rest = rest.withColumnRenamed("norm", "head").join(best.where("at_start").withColumnRenamed("relaxed", "column"), ["head", "column"])
    after = F.regexp_replace(F.substring("head", F.col("end") + 1, F.length("head")), "^[ :;،.]+|[ :;،.]+$", "")
    beside = (F.col("score") >= LEAST) & (F.col("start") <= 2) & (F.length(after) >= 2)
    alone = (F.col("score") >= F.when(F.col("column"), COLUMN).otherwise(PURE)) & (F.col("end") - F.col("start") >= 0.6 * F.length("head"))
    whole = rest.where(beside | alone).select(*key, F.lit(0).alias("part"), "field", "score", F.when(beside, after).alias("inline"), F.when(beside, F.col("end")).alias("until"), F.lit(False).alias("ltr"))
    return latin.unionByName(colon).unionByName(whole)


def chosen(found: DataFrame) -> DataFrame:
    """(doc_id, field, best, second): each field's anchor and, for dates and identifiers, the runner-up.

    A Latin label beats the others; then the score, but a value beside the label makes up for five points. That is no
    order, so a field's anchors of a document are folded as they come.
    """
    cols = ["line", "part", "score", "inline", "until", "ltr"]
    each = F.struct(*cols)
    kind = dict(found.select(each.alias("a")).dtypes)["a"]
    none = F.lit(None).cast(kind)

    def step(s: Column, a: Column) -> Column:
        cur = s["best"]
        higher = (a["score"] > cur["score"]) | (a["inline"].isNotNull() & cur["inline"].isNull() & (a["score"] >= cur["score"] - 5))
        wins = cur.isNull() | (a["ltr"] & ~cur["ltr"]) | ((a["ltr"] == cur["ltr"]) & higher)
        return F.when(wins, F.struct(a.alias("best"), F.coalesce(cur, s["second"]).alias("second"))).otherwise(F.struct(cur.alias("best"), F.coalesce(s["second"], a).alias("second")))

    folded = F.aggregate(F.array_sort(F.collect_list(each)), F.struct(none.alias("best"), none.alias("second")), step)
    out = found.groupBy("doc_id", "field").agg(folded.alias("r"))
    return out.select("doc_id", "field", "r.best", F.when(F.col("field").isin(*CROSS_CHECKED), F.col("r.second")).alias("second"))


def value_boxes(parts: Column, until: Column) -> Column:
    """The boxes of a merged line behind its label, which ends at character until.

    parts: array of struct(text, x, y, w, h, conf) in reading order, one character apart. A box that the label ends in
    keeps its left share, by characters.
    """

    def step(s: Column, p: Column) -> Column:
        n = F.length(p["text"])
        end = s["at"] + n
        share = F.greatest(F.lit(1), F.floor(p["w"] * (end - until) / F.greatest(n, F.lit(1))).cast("int"))
        cut = F.struct(*(share.alias("w") if k == "w" else p[k].alias(k) for k in ("text", "x", "y", "w", "h", "conf")))
        same = F.struct(*(p[k].alias(k) for k in ("text", "x", "y", "w", "h", "conf")))
        more = F.when(s["at"] >= until - 1, F.array(same)).when((end > until + 1) & (n > 0), F.array(cut)).otherwise(F.array().cast(_BOXES))
        return F.struct((end + 1).alias("at"), F.concat(s["out"], more).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(_BOXES).alias("out")), step)["out"]


_BOXES = "array<struct<text: string, x: int, y: int, w: int, h: int, conf: double>>"


def stray_dates(free: DataFrame, date_labels: DataFrame) -> DataFrame:
    """(doc_id, line, field, raw, conf): printed dates on boxes that no label took, with the date label (doc_id, field,
    pos, y, h) that they overlap most, 0.4 at least."""
    raw = F.regexp_extract(normalized_null(F.col("text")), PRINTED_DATE, 1)
    d = free.select("doc_id", "line", "y", "h", "conf", raw.alias("raw")).where("raw <> ''")
    a = date_labels.select("doc_id", "field", "pos", F.col("y").alias("ay"), F.col("h").alias("ah"))
    over = numbers.vertical_overlap(F.col("ay"), F.col("ay") + F.col("ah"), F.col("y"), F.col("y") + F.col("h"))
    pairs = d.join(a, "doc_id").withColumn("over", over).where("over >= 0.4")
    best = F.max_by("field", F.struct("over", (-F.col("pos")).alias("o")))
    return pairs.groupBy("doc_id", "line", "raw", "conf").agg(best.alias("field"))


def normalized_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def crosschecked(read: Column, stray: Column, conf: Column) -> Column:
    """struct(confidence, note) of a stray date against what its field was read as: alike within two days, or not."""
    low = F.greatest(conf, F.lit(0.8))
    out = lambda c, n: F.struct(F.round(c, 3).alias("confidence"), n.alias("note"))
    return F.when(read.isNull(), out(low, F.lit("gregorian_line"))).when(F.abs(F.datediff(read, stray)) <= 2, out(F.lit(0.95), F.lit("gregorian_line xcheck_ok"))).otherwise(
        out(F.lit(0.5), F.concat(F.lit("gregorian_line xcheck_mismatch("), read.cast("string"), F.lit(")")))
    )


def pattern_identifiers(boxes: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, iqama_no, employer_id): structs (number, confidence, raw) for identifiers that no label gave.

    boxes: doc_id, line, part, text, conf, line_text. fields: doc_id, iqama_no, employer_id, is_national, old_layout.
    Lines with a date aren't searched. An employer's number must be whole, pass its check digit and differ from the
    holder's in more than two places; the old layout has none.
    """
    dated = normalized_null(F.col("line_text"))
    b = boxes.where(~dated.rlike(PRINTED_DATE) & ~dated.rlike(YEAR_FIRST)).withColumn("r", numbers.resolve_ten_digits(F.col("text"), "127"))
    b = b.where("length(r.number) = 10").select("doc_id", "line", "part", "text", F.col("r.number").alias("number"), numbers.luhn_ok(F.col("r.number")).alias("ok"), F.col("conf"), F.col("r.multiplier").alias("m"))
    b = b.withColumn("c", F.col("conf") * F.col("m") * F.when(F.col("ok"), 1.0).otherwise(0.7))
    order = F.struct("c", (-F.col("line")).alias("l"), (-F.col("part")).alias("p"))

    def told(least: float) -> Column:
        sure = F.greatest(F.col("c") * 0.95, F.when(F.col("ok"), least).otherwise(0.0))
        return F.struct("number", F.round(sure, 3).alias("confidence"), F.col("text").alias("raw"))

    open_ = fields.select("doc_id", F.col("iqama_no").alias("had"), F.col("employer_id").alias("had_employer"), "is_national", "old_layout")
    j = b.join(open_, "doc_id")
    own = j.where(F.col("had").isNull() & (F.left("number", F.lit(1)) == F.when(F.col("is_national"), "1").otherwise("2"))).groupBy("doc_id").agg(F.max_by(told(0.8), order).alias("iqama_no"))
    k = j.join(own, "doc_id", "left").withColumn("iq", F.coalesce("had", "iqama_no.number", F.lit("")))
    whole = text.normalize_digits(F.col("text")).rlike("(?<![0-9])[0-9]{10}(?![0-9])")
    n = F.least(F.length("iq"), F.lit(10))
    other = F.when(n == 0, 0).otherwise(numbers.differing_places(F.left("number", n), F.left("iq", n)))
    k = k.where(F.col("had_employer").isNull() & ~F.col("old_layout") & F.col("ok") & F.left("number", F.lit(1)).isin("1", "2", "7") & whole & (other > 2))
    employer = k.groupBy("doc_id").agg(F.max_by(told(0.78), order).alias("employer_id"))
    return own.join(employer, "doc_id", "full")


def nationality_by_vocabulary(free: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, line, raw, code, confidence): of the free boxes in the value column, the one that a country's name fits
    best (0.85 at least), the first of equals."""
    b = free.where(text.has_arabic(F.col("text")) & (F.col("x") >= 0.7 * F.col("card_w"))).withColumn("raw", text.clean(F.col("text")))
    m = lookups.code_of(b, entries, "raw").where("code is not null and code_multiplier >= 0.85")
    conf = F.round(F.greatest(F.col("conf") * F.col("code_multiplier"), F.when(F.col("code_multiplier") == 1, 0.8).otherwise(0.0)), 3)
    best = F.max_by(F.struct("line", "raw", "code", conf.alias("confidence")), F.struct("code_multiplier", (-F.col("line")).alias("l")))
    return m.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def layout(header_lines: Column, hijri_expiry: Column, short_labels: Column, employer_value: Column, employer_label: Column, both_cues: Column) -> Column:
    """old, new or unknown from counted evidence: header lines (three at most) and short labels count once, a Hijri
    expiry date twice for the old layout; an employer's number twice, its label and the new cues once for the new."""
    one = lambda c, k: F.when(c, k).otherwise(0)
    old = F.least(header_lines, F.lit(3)) + one(hijri_expiry, 2) + short_labels
    new = one(employer_value, 2) + one(employer_label, 1) + one(both_cues, 1)
    return F.when((old >= 3) & (old > new), "old").when((new >= 2) & (new >= old), "new").otherwise("unknown")


# What an identity card's text has, what a permit's has, and the old layout's header.
IDENTITY_CUES = ("الهويه الوطنيه", "بطاقه الهويه")
IDENTITY_LATIN = ("id number", "date of birth", "expiry date", "dob:", "doe:", "dob", "doe")
PERMIT_CUE, VERSION_CUE = "هويه مقيم", "رقم النسخه"
OLD_HEADER = ("kingdom of saudi arabia", "ministry of interior", "resident identity")
OLD_SHORT = ("iqama_no", "expiry_date", "birth_date", "employer_name", "issue_place")


def evidence(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, header_lines, short_labels, employer_label, identity_cues, permit, both_cues) of every document's text
    and the labels chosen in it (doc_id, field, best). A document's boxes are few; its text is gathered in one row."""
    norm, low = F.coalesce(text.canonical(F.col("text")), F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    header = text.has_latin(F.col("text")) & (F.col("y") < 0.25 * F.col("card_h")) & (F.greatest(*(fuzzy.partial_ratio(F.lit(h), low) for h in OLD_HEADER)) >= 80)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", c.alias("t")))), lambda x: x["t"]), " ")
    whole = lines.groupBy("doc_id").agg(F.sum(header.cast("int")).alias("header_lines"), ordered(norm).alias("t"), ordered(low).alias("l"))
    cues = sum((F.col(c).contains(k).cast("int") for c, ks in (("t", IDENTITY_CUES), ("l", IDENTITY_LATIN)) for k in ks), F.lit(0))
    head = F.trim(F.get(F.split(text.canonical(F.col("text")), ":"), F.lit(0)))
    short = F.col("field").isin(*OLD_SHORT) & (F.length(F.coalesce(head, F.lit(""))) <= 9)
    each = found.select("doc_id", "field", "best.line").join(lines.select("doc_id", "line", "text"), ["doc_id", "line"])
    counted = each.groupBy("doc_id").agg(F.sum(short.cast("int")).alias("short_labels"), F.max(F.col("field") == "employer_id").alias("employer_label"))
    permit, version = F.col("t").contains(PERMIT_CUE), F.col("t").contains(VERSION_CUE)
    return whole.join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("header_lines", F.lit(0)).cast("int").alias("header_lines"), F.coalesce("short_labels", F.lit(0)).cast("int").alias("short_labels"), F.coalesce("employer_label", F.lit(False)).alias("employer_label"),
        cues.alias("identity_cues"), permit.alias("permit"), (permit & version).alias("both_cues"),
    )


def document_kind(identity_cues: Column, number: Column, permit: Column) -> Column:
    """NATIONAL_ID by a cue or, without the permit's, by a number that begins with 1; else IQAMA."""
    return F.when((identity_cues >= 1) | (F.coalesce(number, F.lit("")).startswith("1") & ~permit), "NATIONAL_ID").otherwise("IQAMA")
