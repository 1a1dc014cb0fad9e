"""Files, keys, registries and logs that no table query reaches, and cases that a table doesn't have."""

import datetime
import stat

import pytest
from pyspark.sql import functions as F

from docscreen.functions import crypto, dates, numbers, text
from docscreen.operators import audit, extract, fields, history, lookups, report, rules
from docscreen.sources import ingest

BOX = "doc_id long, line int, text string, x int, y int, w int, h int, conf double"


def test_a_key_is_made_once_for_the_owner(tmp_path):
    path = str(tmp_path / "key")
    one = crypto.key(path)
    assert len(one) == 32 and crypto.key(path) == one and stat.S_IMODE((tmp_path / "key").stat().st_mode) == 0o600
    (tmp_path / "short").write_text("AAAA")
    with pytest.raises(ValueError, match="3 bytes"):
        crypto.key(str(tmp_path / "short"))


def test_lists_of_words_come_from_files(tmp_path):
    (tmp_path / "e.yaml").write_text("﻿government: [' office ', '']\nlegal_forms: [inc]\n", encoding="utf-8")
    lists = rules.load_lists(str(tmp_path / "e.yaml"))
    assert lists == {"government": ("office",), "legal_forms": ("inc",)}
    base = rules.Rules().validate()
    own = rules.with_employer_rules(base, lists)
    assert own.government == ("office",) and own.version != base.version
    with pytest.raises(ValueError, match="unknown lists"):
        rules.with_employer_rules(base, {"x": ()})
    (tmp_path / "bad.yaml").write_text("a: 1\n")
    with pytest.raises(ValueError, match="not lists"):
        rules.load_lists(str(tmp_path / "bad.yaml"))


def test_providers_give_one_form_and_unknown_ones_are_named(spark):
    p = ingest.Providers()
    p.register("mock", ingest.canned([(1, 0, "a", 1, 2, 3, 4, 0.5)]))
    assert p.lines(spark, "mock").first().text == "a" and p.lines(spark, "mock").schema == ingest.OCR_LINES
    with pytest.raises(KeyError, match="mock"):
        p.lines(spark, "other")


def test_an_upload_of_too_many_files_is_refused(spark):
    rows = spark.createDataFrame([(str(i), 1, b"%PDF-") for i in range(3)], "path string, length long, content binary")
    with pytest.raises(ValueError, match="more than 2 files"):
        ingest.upload(ingest.identified(rows), most=2)
    taken, refused = ingest.upload(ingest.identified(rows.withColumn("content", F.when(F.col("path") == "1", F.lit(b"xx")).otherwise(F.col("content")))))
    assert taken.count() == 2 and [r.path for r in refused.collect()] == ["1"]


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_BYTES", 10)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256 is None, r.error) for r in ingest.accepted(ingest.files(spark, tmp_path.as_uri())).collect()}
    assert got["a.pdf"] == (False, None) and got["b.pdf"][0] and "too large" in got["b.pdf"][1]


def test_the_log_is_appended_masked_and_checked(spark, tmp_path):
    path = (tmp_path / "log").as_uri()
    row = [("PII_UNMASKED", "ann 2000000014", datetime.datetime(2026, 1, 2))]
    for _ in range(2):
        audit.appended(spark.createDataFrame(row, "action string, actor string, ts timestamp_ntz"), path)
    assert [(r.actor, str(r.day)) for r in spark.read.parquet(path).collect()] == [("ann 2000******", "2026-01-02")] * 2
    with pytest.raises(ValueError, match="unknown actions"):
        audit.appended(spark.createDataFrame([("NO", "x", row[0][2])], "action string, actor string, ts timestamp_ntz"), path)
    docs = spark.createDataFrame([(1, "PROCESSING"), (2, "DONE")], "doc_id long, status string")
    assert [r.entity_id for r in audit.requeue_log(docs, F.lit(row[0][2])).collect()] == ["1"]


def test_a_box_joins_the_first_chain_that_takes_it(spark):
    # two rows whose heights overlap in part: the cursor of each chain moves on, and a later box goes to the first fit
    rows = [(1, 0, "a", 300, 100, 50, 20, 1.0), (1, 1, "b", 240, 108, 50, 20, 1.0), (1, 2, "c", 180, 118, 50, 20, 0.5), (1, 3, "d", 300, 125, 50, 20, 1.0), (1, 4, "e", 239, 126, 50, 20, 1.0), (2, 0, "z", 0, 0, 5, 5, 0.1)]
    got = sorted((r.doc_id, r.text, r.parts, round(r.conf, 3)) for r in extract.merged_rows(spark.createDataFrame(rows, BOX)).collect())
    assert got == [(1, "a b c", [0, 1, 2], 0.833), (1, "d e", [3, 4], 1.0), (2, "z", [0], 0.1)]


def test_a_taken_box_is_gone_and_inline_labels_only_bound(spark):
    label = "field string, inline string, ltr boolean"
    rows = [
        (1, 0, "L1", 500, 100, 80, 20, 0.9, "one", None, False), (1, 1, "L2", 505, 104, 80, 20, 0.9, "two", None, False),
        (1, 2, "v", 400, 102, 60, 20, 0.8, None, None, False), (1, 3, "L3", 200, 100, 50, 20, 0.9, "three", "inside", False),
        (1, 4, "far", 100, 100, 50, 20, 0.8, None, None, False), (1, 5, "12", 600, 101, 40, 20, 0.6, None, None, False), (1, 6, "word", 660, 101, 40, 20, 0.6, None, None, False),
        (1, 7, "E", 520, 101, 70, 20, 0.9, "right", None, True),
    ]
    got = {r.field: (r.text, r.x1, r.x2) for r in extract.values(spark.createDataFrame(rows, f"{BOX}, {label}")).collect()}
    assert got == {"one": ("v", 400, 460), "right": ("12", 600, 640)}


def test_the_value_of_a_row_is_the_widest_box_between(spark):
    missing = spark.createDataFrame([(1, "occupation", 100, 200), (1, "employer_id", 100, 200)], "doc_id long, field string, after int, before int")
    free = [(1, 0, "مهندس مدني", 600, 140, 200, 20, 0.8, 1000), (1, 1, "فني", 600, 140, 90, 20, 0.9, 1000), (1, 2, "المهنة", 850, 140, 140, 20, 0.9, 1000), (1, 3, "text", 600, 150, 300, 20, 0.9, 1000), (1, 4, "عمل عمل عمل", 600, 190, 380, 20, 0.9, 1000)]
    out = extract.row_values(missing, spark.createDataFrame(free, f"{BOX}, card_w int")).collect()
    assert [(r.field, r.line, r.confidence) for r in out] == [("occupation", 0, 0.68)]


def test_codes_of_equal_likeness_go_to_the_first_row(spark):
    entries = spark.createDataFrame([("B2", "landb", "x", "", 0), ("A1", "landa", "y", "", 1)], "code string, name_en string, name_ar string, aliases string, file_pos int")
    assert lookups.code_of(spark.createDataFrame([("landc",)], "n string"), entries, "n").first().code == "B2"


def test_pairs_that_reach_the_thresholds_share_two_letters(spark):
    import random

    rng = random.Random(2)
    names = sorted({"".join(rng.choices("abc ", k=rng.randrange(2, 9))).strip() for _ in range(60)} - {""})
    v = spark.createDataFrame([(x,) for x in names], "v string")
    k = spark.createDataFrame([(x,) for x in names], "key string")
    from docscreen.functions import fuzzy

    measure = lambda df: df.withColumn("r", fuzzy.ratio(F.col("v"), F.col("key"))).withColumn("t", fuzzy.token_set_ratio(F.col("v"), F.col("key"))).where("r >= 80 or t >= 85").select("v", "key")
    every = measure(v.join(k, F.lit(True)))
    assert set(map(tuple, measure(lookups.alike(v, k)).collect())) == set(map(tuple, every.collect()))


def test_measures_over_columns_equal_the_expressions(spark):
    import random

    from docscreen.functions import fuzzy

    rng = random.Random(4)
    rows = [tuple("".join(rng.choices("ab c é", k=rng.randrange(0, 14))) for _ in range(2)) for _ in range(80)] + [("x" * 70 + "ab", "ab" + "x" * 65), ("", ""), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(fuzzy.ratio(a, b), fuzzy.ratio_of(a, b), fuzzy.token_set_ratio(a, b), fuzzy.token_set_ratio_of(a, b)).collect()
    assert all(r[0] == pytest.approx(r[1]) and r[2] == pytest.approx(r[3]) for r in got[:-1]) and got[-1][1] is None


def test_hijri_years_with_misread_separators(spark):
    df = spark.createDataFrame([("14458608",), ("144508810",), ("1445808810",), ("2026128301",), ("144513801",)], "t string")
    got = {r.t: str(r.d) for r in dates.repair_separators(df, "t", "d").collect()}
    assert got["144508810"] == "2024-02-20" and got["14458608"] == "None" and got["144513801"] == "None"


def test_times_of_a_zone(spark):
    day = spark.range(1).select(rules.today(rules.Rules(time_zone="Asia/Riyadh")).alias("d"), F.current_timestamp().alias("t")).first()
    assert abs((datetime.datetime.combine(day.d, datetime.time()) - day.t.replace(tzinfo=None)).total_seconds()) < 2 * 86_400


def test_presentation_forms_match_lookups(spark):
    entries = spark.createDataFrame([("IN", "India", "الهند", "", 0)], "code string, name_en string, name_ar string, aliases string, file_pos int")
    asked = spark.createDataFrame([("ﺍﻟﻬﻨﺪ",), (" ＩＮＤＩＡ ",)], "n string")
    assert [r.code for r in lookups.code_of(asked, entries, "n").collect()] == ["IN", "IN"]


def test_feeds_have_one_row_for_a_repeated_code(spark):
    rows = spark.createDataFrame([(1, "APPROVED", "n", None, "AA", "1", "o", "c")], "doc_id long, status string, name_en string, name_ar string, nationality string, iqama_no string, occupation string, company string")
    entries = spark.createDataFrame([("AA", "old", "x", 0), ("AA", "new", "x", 1)], "code string, name_en string, name_ar string, file_pos int")
    assert [r.nationality_name for r in report.export_feed(rows, entries, ("APPROVED",)).collect()] == ["new"]


def test_malformed_json_is_an_empty_list(spark):
    df = spark.createDataFrame([("[\"a\"]", None), ("nonsense", "[]")], "reasons string, triggers string")
    assert [(r.reasons, r.triggers) for r in report.restored(df).collect()] == [(["a"], []), ([], [])]


def test_wide_rows_and_identity_cards(spark):
    f = "doc_id long, field string, raw string, normalized string, confidence double, source string, note string"
    rows = spark.createDataFrame([(1, "nationality", "x", "XX", 0.4, "ocr", None), (1, "occupation", "o", "o", 0.7, "ocr", None), (2, "nationality", "y", "YY", 0.6, "ocr", None)], f)
    kinds = spark.createDataFrame([(1, "NATIONAL_ID"), (2, "IQAMA"), (3, "NATIONAL_ID")], "doc_id long, doc_type string")
    got = {r.doc_id: (r.nationality, r.nationality_conf, r.occupation) for r in fields.wide(fields.forced_nationality(rows, kinds, "SA"), ("nationality", "occupation")).collect()}
    assert got == {1: ("SA", 1.0, "o"), 2: ("YY", 0.6, None), 3: ("SA", 1.0, None)}


def test_numbers_of_either_order(spark):
    df = spark.createDataFrame([("00014 20000",), ("20000 00014",), ("",)], "t string").select("t", numbers.resolve_ten_digits(F.col("t"), "2").alias("r"))
    got = {r.t: (r.r.number, r.r.multiplier) for r in df.collect()}
    assert got["20000 00014"][0] == "2000000014" and got["00014 20000"][0] == "2000000014" and got[""] == (None, 0.0)


def test_history_keeps_manual_companies_and_versions(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = spark.createDataFrame([(1, "A", "AUTO"), (2, "B", "CARD")], "doc_id long, company string, company_source string")
    none = spark.createDataFrame([], "doc_id long, company string, set_at int")
    assert {r.doc_id: r.company_source for r in history.with_company(docs, found, none).collect()} == {1: "AUTO", 2: "CARD"}
    assert text.COMPOSED
