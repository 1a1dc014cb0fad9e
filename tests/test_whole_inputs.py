"""Queries that must read all of their input, on rows whose end or kind a cut would lose."""

import os

from docscreen import catalogue
from docscreen.operators import fields, labels
from docscreen.plans import subjects as S

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_identifiers_behind_the_first_characters_are_masked(spark, tmp_path):
    far = "x" * 100
    rows = [(1, f"{far} 2999999999 2888888888, ٢٩٩٩٩٩٩٩٩٩ {far} 1777777777"), (2, None), (3, f"{far} 12345678901 {far}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.masked.split(": ", 1)[1] for r in catalogue.QUERIES["pii_mask_documents"](spark, str(tmp_path)).collect()}
    assert got == {1: f"{far} 2999****** 2888******, ٢٩٩٩****** {far} 1777******", 2: "", 3: rows[2][1]}


def luhn(s):
    return sum(sum(divmod(int(x) * (1 + (i % 2 == 0)), 10)) for i, x in enumerate(s)) % 10 == 0


def resolved(chunks):
    """number, multiplier, note of chunks of digits by the written rules; prefix 2."""
    exact = [c for c in chunks if len(c) == 10 and c[0] == "2" and luhn(c)]
    if len(exact) == 1:
        return exact[0], 1.0, "exact_chunk(luhn=True)"
    if len("".join(chunks)) != 10:
        return "".join(chunks), 0.5, f"length_{len(''.join(chunks))}"
    orders = [("reversed", "".join(chunks[::-1])), ("natural", "".join(chunks))]  # the first of equals wins
    (a, how, n), (b, _, _) = sorted(((2 * (x[0] == "2") + luhn(x), how, x) for how, x in orders), key=lambda x: -x[0])
    if len(chunks) == 1:
        return n, 1.0 if a >= 2 else 0.7, f"single_chunk(prefix_ok={n[0] == '2'},luhn={luhn(n)})"
    if a == 0:
        return n, 0.5, "no_candidate_valid"
    return (n, 0.75, f"ambiguous_order({how})") if b >= 2 else (n, 1.0 if a == 3 else 0.9, f"{how}(luhn={luhn(n)})")


def test_every_subject_is_resolved_and_none_is_turned_back(spark):
    cards = {r.doc_id: r.iqama_no for r in S.subjects(spark, DATA).select("doc_id", "iqama_no").collect()}
    # the o of "no" is read as a zero
    want = {k: resolved(["0", c] if k % 2 == 0 else [c[:5], c[5:]]) for k, c in cards.items()}
    got = {r.doc_id: (r.number, r.multiplier, r.note) for r in catalogue.QUERIES["ten_digit_resolve"](spark, DATA).collect()}
    assert got == want
    assert {n for _, _, n in want.values()} >= {"exact_chunk(luhn=True)", "length_11", "natural(luhn=True)", "natural(luhn=False)"}


def _nodes(df):
    """The nodes of an optimized plan."""
    open_, out = [df._jdf.queryExecution().optimizedPlan()], []
    while open_:
        out.append(open_.pop())
        open_ += [out[-1].children().apply(i) for i in range(out[-1].children().size())]
    return out


def test_labels_are_judged_once_for_each_text(spark):
    """Below the distinct texts of lines no label is looked for; a text's labels come to every line of it."""
    rows = [(i, i % 7, t, x, 300, 290, 20, 0.9, 1000, 600) for i in range(40) for t, x in (("المهنة: مهندس", 700), ("المهنة", 600), ("ID Number: 12", 0), (None, 700))]
    lines = spark.createDataFrame(rows, "doc_id long, line int, text string, x int, y int, w int, h int, conf double, card_w int, card_h int").where("conf > 0")
    found = labels.anchors(lines, {"iqama_no": ["ID Number"], "occupation": ["المهنة"]}, ["هويه مقيم"])
    distinct = [n for n in _nodes(found) if n.nodeName() == "Aggregate" and n.groupingExpressions().size() == 2 and n.output().apply(0).name() == "text" and n.output().apply(1).name() == "place"]
    lowest = [x for x in (n.child().toString() for n in distinct) if "Generate" not in x]
    assert lowest and not any("RLIKE" in x or "lambda" in x for x in lowest)
    got = sorted(((r.doc_id, r.field, r.inline) for r in found.collect()), key=str)
    assert got == sorted([(i, f, v) for i in range(40) for f, v in (("occupation", "مهندس"), ("iqama_no", "12"), ("occupation", None))], key=str)


def test_dates_are_read_once_for_each_text(spark):
    """Fields' dates are read from distinct texts, by expressions that aren't put into each other; null dates are empty."""
    rows = [(i, "expiry_date", d, e, 0.8, 80.0, False) for i in range(30) for d, e in (("2030/01/02", "03/01/2030"), (None, "03/01/2030"), ("", None), ("1447/01/01", None))]
    entries = spark.createDataFrame([], "code string, name_en string, name_ar string, aliases string, file_pos int")
    out = fields.normalised(spark.createDataFrame(rows, "doc_id int, field string, raw string, second string, value_conf double, score double, is_national boolean").where("score > 0"), entries)
    assert any(n.nodeName() == "Aggregate" and n.output().size() == 1 and n.output().apply(0).name() == "printed" for n in _nodes(out))
    got = sorted({(r.raw or "", r.normalized, r.note) for r in out.collect()}, key=str)
    assert got == [("", None, "empty"), ("1447/01/01", "2025-06-26", "direct_hijri"), ("2030/01/02", "2030-01-02", "direct xcheck_ok")] and out.count() == 120
