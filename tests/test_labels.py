"""Label finding and its fallbacks on invented boxes."""

import datetime

from pyspark.sql import functions as F

from docscreen.functions import fuzzy
from docscreen.operators import labels

LABELS = {"iqama_no": ["رقم الهوية", "ID Number"], "expiry_date": ["تاريخ الانتهاء", "Expiry Date"], "occupation": ["المهنة"]}
LINE = "doc_id long, line int, text string, x int, y int, w int, h int, conf double, card_w int, card_h int"


def line(n, text, x=700, w=290, y=200, conf=0.9):
    return (1, n, text, x, y, w, 20, conf, 1000, 600)


def test_alignment_is_the_leftmost_best_stretch(spark):
    rows = [("abc", "xxabcxabc"), ("abcd", "ab"), ("", "a"), ("abc", "abx")]
    got = spark.createDataFrame(rows, "a string, b string").select(fuzzy.alignment(F.col("a"), F.col("b")).alias("x"), fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.x.start, r.x.end) for r in got][:3] == [(2, 5), (0, 2), (0, 0)]
    assert all(r.x.score == r.p for r in (got[0], got[1], got[3]))


def test_anchors_with_and_without_colons(spark):
    rows = [line(0, "رقم الهوية: 2000000014"), line(1, "المهنة"), line(2, "Expiry Date: 26/02/2033", x=10), line(3, "Expiry Dale 01/01/2030", x=10), line(4, "هوية مقيم"), line(5, "رقم الهوية", x=10, w=20), line(6, "تاريخ الانتهاء: ١٢ المهنة: مهندس"), line(7, "رقم الهوية", y=10), line(8, None)]
    found = labels.anchors(spark.createDataFrame(rows, LINE), LABELS, ["هويه مقيم"])
    got = {(r.line, r.part): (r.field, r.inline, r.ltr) for r in found.collect()}
    assert got == {
        (0, 0): ("iqama_no", "2000000014", False), (1, 0): ("occupation", None, False), (2, 0): ("expiry_date", "26/02/2033", True),
        (3, 0): ("expiry_date", "01/01/2030", True), (6, 0): ("expiry_date", "١٢", False), (6, 1): ("occupation", "مهندس", False),
    }
    best = {r.field: (r.best.line, r.second.line if r.second else None) for r in labels.chosen(found).collect()}
    assert best == {"iqama_no": (0, None), "occupation": (6, None), "expiry_date": (2, 3)}


def test_a_value_beside_the_label_makes_up_for_five_points(spark):
    rows = [(1, 0, 0, "occupation", 90.0, None, 3, False), (1, 1, 0, "occupation", 86.0, "x", 3, False), (1, 2, 0, "occupation", 88.0, None, 3, False), (1, 3, 0, "iqama_no", 70.0, None, 3, True), (1, 4, 0, "iqama_no", 99.0, "y", 3, False)]
    found = spark.createDataFrame(rows, "doc_id long, line int, part int, field string, score double, inline string, until int, ltr boolean")
    got = {r.field: (r.best.line, r.second and r.second.line) for r in labels.chosen(found).collect()}
    assert got == {"occupation": (2, None), "iqama_no": (3, 4)}


def test_boxes_behind_a_label(spark):
    box = "struct<text: string, x: int, y: int, w: int, h: int, conf: double>"
    rows = [([("abcd", 80, 0, 40, 9, 0.9), ("efghijkl", 0, 0, 80, 9, 0.8), ("mn", 0, 0, 8, 9, 0.7)], 7), ([("ab", 0, 0, 9, 9, 0.9)], 2), (None, 1)]
    df = spark.createDataFrame(rows, f"parts array<{box}>, until int").select(labels.value_boxes(F.col("parts"), F.col("until")).alias("v"))
    got = [r.v and [(b.text, b.w) for b in r.v] for r in df.collect()]
    assert got == [[("efghijkl", 60), ("mn", 8)], [], None]


def test_stray_dates_and_their_check(spark):
    free = spark.createDataFrame([line(0, "DOB 03/05/1994", y=100), line(1, "03/05/94", y=100), line(2, "x 01/01/2030", y=400), line(3, None)], LINE)
    date_labels = spark.createDataFrame([(1, "birth_date", 0, 95, 20), (1, "expiry_date", 1, 108, 20)], "doc_id long, field string, pos int, y int, h int")
    assert [(r.line, r.field, r.raw) for r in labels.stray_dates(free, date_labels).collect()] == [(0, "birth_date", "03/05/1994")]
    d = datetime.date
    df = spark.createDataFrame([(None, d(2030, 1, 1)), (d(2030, 1, 3), d(2030, 1, 1)), (d(2030, 1, 4), d(2030, 1, 1))], "a date, b date")
    assert [tuple(r.x) for r in df.select(labels.crosschecked(F.col("a"), F.col("b"), F.lit(0.7)).alias("x")).collect()] == [(0.8, "gregorian_line"), (0.95, "gregorian_line xcheck_ok"), (0.5, "gregorian_line xcheck_mismatch(2030-01-04)")]


def test_identifiers_by_pattern(spark):
    texts = ["2000000014", "7000000047", "1999/1/1 2000000022", "700 000 0054", None]
    boxes = spark.createDataFrame([(1, i, 0, t, 0.9, t) for i, t in enumerate(texts)] + [(2, 0, 0, "7000000047", 0.9, "7000000047")], "doc_id long, line int, part int, text string, conf double, line_text string")
    fields = spark.createDataFrame([(1, None, None, False, False), (2, "2000000014", None, False, True)], "doc_id long, iqama_no string, employer_id string, is_national boolean, old_layout boolean")
    got = {r.doc_id: (r.iqama_no.number, r.employer_id.number) for r in labels.pattern_identifiers(boxes, fields).collect()}
    assert got == {1: ("2000000014", "7000000047")}


def test_nationality_by_vocabulary_and_layout(spark):
    entries = spark.createDataFrame([("AA", "Aland", "الهند", "", True, 0)], "code string, name_en string, name_ar string, aliases string, approved boolean, file_pos int")
    free = spark.createDataFrame([line(0, "الهند", x=100), line(1, "الهند", x=800), line(2, "غيره", x=800), line(3, "Aland", x=800)], LINE)
    assert [(r.doc_id, r.line, r.code) for r in labels.nationality_by_vocabulary(free, entries).collect()] == [(1, 1, "AA")]
    rows = [(5, False, 0, False, False, False), (0, True, 1, True, True, True), (0, False, 0, True, False, False), (0, False, 2, False, False, False)]
    df = spark.createDataFrame(rows, "a int, b boolean, c int, d boolean, e boolean, f boolean")
    assert [r.x for r in df.select(labels.layout(*(F.col(c) for c in "abcdef")).alias("x")).collect()] == ["old", "new", "new", "unknown"]


def test_evidence_for_kind_and_layout(spark):
    rows = [line(0, "Kingdom of Saudi Arabla", y=10), line(1, "Ministry of Interior", y=500), line(2, "هوية مقيم", y=90), line(3, "رقم النسخة: 2"), line(4, "الرقم: 2"), (2, 0, "DOB: 1", 0, 300, 9, 9, 0.9, 1000, 600), (3, 0, None, 0, 0, 9, 9, 0.9, 1000, 600)]
    found = spark.createDataFrame([(1, "iqama_no", (4,)), (1, "employer_id", (3,))], "doc_id long, field string, best struct<line: int>")
    e = labels.evidence(spark.createDataFrame(rows, LINE), found)
    got = {r.doc_id: tuple(r)[1:] for r in e.collect()}
    assert got == {1: (1, 1, True, 0, True, True), 2: (0, 0, False, 2, False, False), 3: (0, 0, False, 0, False, False)}
    kinds = spark.createDataFrame([(1, None, False), (0, "1000000032", False), (0, "1000000032", True), (0, None, False)], "c int, n string, p boolean")
    assert [r.k for r in kinds.select(labels.document_kind(F.col("c"), F.col("n"), F.col("p")).alias("k")).collect()] == ["NATIONAL_ID", "NATIONAL_ID", "IQAMA", "IQAMA"]
