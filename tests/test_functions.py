"""Scalar functions against values worked out by hand."""

import hashlib
import hmac
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docscreen.functions import crypto, dates, fuzzy, numbers, text


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_digits, "٢٠۲٦", "2026"),
        (text.numeric_only, "2O1l-S", "20115"),
        (text.numeric_with_separators, "2O/Zx", "20/  "),
        (text.canonical, " إلـى  مدرسة ", "الي مدرسه"),
        (text.clean, " : ز  value ه", "value"),
        (text.clean, " .: ", None),
        (text.mask_id, "2999999999", "2999******"),
        (text.mask_id, "299", "***"),
        (text.mask_id, "", ""),
        (text.mask_id, None, None),
        (text.mask_identifiers, "a 2999999999, 12345678901", "a 2999******, 12345678901"),
        (numbers.luhn_ok, "125", False),
        (numbers.luhn_ok, "", False),
        (numbers.luhn_ok, "12x", False),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, f(F.col("c")), value) == want


def test_compatibility_forms_are_composed(spark):
    assert one(spark, text.canonical(F.col("c"), compose=True), "ﻻ ①") == "لا 1"


def test_truthy_and_aliases(spark):
    assert one(spark, text.truthy(F.col("c")), " Yes ") and not one(spark, text.truthy(F.col("c")), "") and one(spark, text.truthy(F.col("c"), empty=True), None)
    assert one(spark, text.aliases(F.col("c")), "a | |b") == ["a", "b"]


def luhn(s):
    digits = [int(x) * (1 + (i % 2 == 0)) for i, x in enumerate(s)]
    return sum(d // 10 + d % 10 for d in digits) % 10 == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("0123456789", min_size=1, max_size=12), min_size=20, max_size=20))
def test_luhn_from_the_left(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "c string").select("c", numbers.luhn_ok(F.col("c")).alias("a"), numbers.luhn_ok_10(F.col("c")).alias("b")).collect()
    assert all(r.a == luhn(r.c) and r.b == (len(r.c) == 10 and luhn(r.c)) for r in rows)


def valid(nine):
    return next(nine + str(k) for k in range(10) if luhn(nine + str(k)))


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, (None, 0.0, "empty")),
        ("abc", (None, 0.0, "no_digits")),
        (f"x {valid('200000001')} 7", (valid("200000001"), 1.0, "exact_chunk(luhn=True)")),
        ("12 345", ("12345", 0.5, "length_5")),
        ("33333 44444", ("4444433333", 0.5, "no_candidate_valid")),
    ],
)
def test_ten_digits(spark, value, want):
    assert tuple(one(spark, numbers.resolve_ten_digits(F.col("c"), "2"), value)) == want


def test_ten_digits_in_reversed_order(spark):
    n = valid("234567891")
    got = one(spark, numbers.resolve_ten_digits(F.col("c"), "2"), f"{n[5:]} {n[:5]}")
    assert got["number"] == n and got["multiplier"] == 1.0


@pytest.mark.parametrize(
    ("value", "date", "multiplier"),
    [
        ("2026/04/02", "2026-04-02", 1.0),
        ("02-04-2026", "2026-04-02", 1.0),
        ("٢٠٢٦/٠٤/٠٢", "2026-04-02", 1.0),
        ("2026/02/30", None, 0.0),
        ("1436/06/12", "2015-04-01", 0.7),
        ("20260402", "2026-04-02", 0.7),
        ("202604802", "2026-04-02", 0.7),
        ("26 04 02", "2026-04-02", 0.6),
        ("no", None, 0.0),
        (None, None, 0.0),
    ],
)
def test_dates(spark, value, date, multiplier):
    r = dates.resolve_date(spark.createDataFrame([(value,)], "c string"), "c", "r").first()["r"]
    assert (str(r["date"]) if r["date"] else None, r["multiplier"]) == (date, multiplier)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=8), st.text("abc ", max_size=8)), min_size=15, max_size=15))
def test_ratio_is_the_indel_similarity(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        n = len(r.a) + len(r.b)
        assert r.r == pytest.approx(200 * lcs(r.a, r.b) / n if n else 100)


def test_set_and_partial_ratio(spark):
    got = spark.createDataFrame([("new york mets", "mets york new"), ("a b", "a b c"), ("", "x"), ("abc", "xxabcxx")], "a string, b string")
    rows = got.select(fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("t"), fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.t for r in rows][:3] == [100.0, 100.0, 0.0] and rows[3].p == 100.0


def test_keyed_hash_and_encryption(spark):
    key = bytes(range(32))
    assert one(spark, crypto.keyed_hash(F.col("c"), key), "2999999999") == hmac.new(key, b"2999999999", hashlib.sha256).hexdigest()
    assert one(spark, crypto.decrypt(crypto.encrypt(F.col("c"), key), key), "é") == "é"


def test_quality(spark):
    df = spark.createDataFrame([(300, 100.0, 170.0, 0.0), (1200, 150.0, 170.0, 0.0)], "w int, s double, b double, g double")
    assert [r.x for r in df.select(numbers.quality_score(F.col("w"), F.col("s"), F.col("b"), F.col("g")).alias("x")).collect()] == [0.367, 1.0]


def test_canonical_composes_whatever_may_change(spark):
    safe = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and re.match(text.COMPOSED, chr(i)) and chr(i) != "\n"]
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in safe for b in safe)  # and so no longer text of theirs changes
    values = [(" ﻣﺪﺭﺳﺔ ﺍﻻﻣﻞ ", "مدرسه الامل"), ("Ｍｉｎｉｓｔｒｙ　ﬁ x", "ministry fi x"), ("مُدرسة", "مدرسه"), ("ab", "ab"), ("", ""), (None, None)]
    df = spark.createDataFrame([(v, [v, "ﬀ"]) for v, _ in values], "c string, a array<string>")
    got = df.select(text.canonical(F.col("c")).alias("c"), text.canonical_each(F.col("a")).alias("a")).collect()
    assert [r.c for r in got] == [w for _, w in values] and [list(r.a) for r in got] == [[w, "ff"] for _, w in values]
