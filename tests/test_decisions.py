"""Checks, gates, history, reports on invented subjects."""

import datetime

import pytest
from pyspark.sql import functions as F

from docscreen.operators import audit, checks, extract, history, lookups, report
from docscreen.operators.rules import Rules, fingerprint
from docscreen.sources import ingest

TODAY = datetime.date(2026, 9, 4)
GOOD = {
    "doc_id": 1, "doc_type": "IQAMA", "layout": "new", "quality": 0.9, "iqama_no": "2000000017", "expiry_date": datetime.date(2027, 9, 4), "birth_date": datetime.date(1990, 1, 1),
    "nationality": "AA", "occupation": "welder", "occupation_raw": "welder", "employer_id": "7000000004", "employer_name": "north company", "ref_type": None,
    "listed": True, "approved": True, "list_name": "Aland",
}
SCHEMA = "doc_id long, doc_type string, layout string, quality double, iqama_no string, expiry_date date, birth_date date, nationality string, occupation string, occupation_raw string, employer_id string, employer_name string, ref_type string, listed boolean, approved boolean, list_name string"
OCCUPATIONS = [("لحام", "welder", "weld man", "c", True, 0), ("حارس", "guard", "", "c", False, 1)]


def decide(spark, rules=None, conf=0.95, **changes):
    rules = (rules or Rules()).validate()
    df = spark.createDataFrame([GOOD | changes], SCHEMA)
    df = df.withColumns({f"{f}_conf": F.lit(conf) for f in ("iqama_no", "expiry_date", "birth_date", "nationality", "occupation", "employer_id", "employer_name")})
    occ = spark.createDataFrame(OCCUPATIONS, "name_ar string, name_en string, aliases string, category string, eligible boolean, file_pos int")
    df = lookups.occupation_match(df, occ, rules.fuzzy_threshold)
    return checks.decided(checks.checked(df, rules, F.lit(TODAY)), rules).first()


def test_all_passed_waits_for_a_person(spark):
    d = decide(spark)["decision"]
    assert (d["status"], d["recommendation"], d["triggers"]) == ("MANUAL_REVIEW", "RECOMMEND_APPROVE", ["ALL_CHECKS_PASSED_AWAITING_HUMAN_APPROVAL"])
    assert decide(spark, Rules(auto_approve=True))["decision"]["status"] == "APPROVED"


def test_poor_image_ends_it(spark):
    d = decide(spark, quality=0.2, expiry_date=datetime.date(2020, 1, 1), nationality=None)["decision"]
    assert d["status"] == "MANUAL_REVIEW" and d["reasons"] == [] and len(d["triggers"]) == 1 and d["triggers"][0].startswith("POOR_IMAGE (quality 0.20")


def test_expired_rejects_only_when_sure(spark):
    old = datetime.date(2026, 4, 2)
    d = decide(spark, expiry_date=old)["decision"]
    assert d["status"] == "REJECTED" and "-155 days" in d["reasons"][0]
    d = decide(spark, expiry_date=old, conf=0.74)["decision"]
    assert d["status"] == "MANUAL_REVIEW" and any("low confidence 0.74" in t for t in d["triggers"])
    d = decide(spark, Rules(confirm_rejections=True), expiry_date=old)["decision"]
    assert (d["status"], d["recommendation"], d["triggers"]) == ("MANUAL_REVIEW", "RECOMMEND_REJECT", ["HUMAN_CONFIRMATION_REQUIRED"])


def test_expiring_soon_is_reviewed(spark):
    assert decide(spark, expiry_date=datetime.date(2026, 9, 20))["check_EXPIRY"]["label"] == "EXPIRING_SOON"


@pytest.mark.parametrize(("mode", "listed", "approved", "want"), [("ALL_APPROVED", True, False, "PASS"), ("BLOCKLIST", True, False, "FAIL"), ("BLOCKLIST", False, None, "PASS"), ("ALLOWLIST", True, True, "PASS"), ("ALLOWLIST", False, None, "FAIL")])
def test_list_modes(spark, mode, listed, approved, want):
    assert decide(spark, Rules(list_mode=mode), listed=listed, approved=approved)["check_NATIONALITY"]["outcome"] == want


def test_employer_layers(spark):
    c = lambda **x: decide(spark, **x)["employer_class"]
    assert tuple(c(ref_type="INDIVIDUAL")) == ("INDIVIDUAL", 1.0, "L1")
    assert c(employer_name="city ministry")["confidence"] == 0.99
    assert c(employer_name="one two three")["confidence"] == 0.69
    assert c(employer_id="9000000000", employer_name="x trading y z q")["layer"] == "L4"
    assert c(employer_id=None, employer_name=None)["type"] == "UNKNOWN"


def test_individual_with_eligible_occupation_goes_to_a_person(spark):
    r = decide(spark, employer_id="1000000008", employer_name=None)
    assert r["check_EMPLOYER"]["outcome"] == "REVIEW" and "eligible occupation" in r["check_EMPLOYER"]["reason"]
    r = decide(spark, Rules(individual_with_eligible="REJECT"), employer_id="1000000008", employer_name=None)
    assert r["decision"]["status"] == "REJECTED"


def test_occupation_outcomes(spark):
    label = lambda **x: decide(spark, **x)["check_OCCUPATION"]["label"]
    assert label() == "ELIGIBLE" and label(occupation="Weld  man") == "ELIGIBLE" and label(occupation="guard") == "EXCLUDED"
    assert label(occupation="zzz") == "UNKNOWN" and label(occupation=None, occupation_raw=None) == "UNREADABLE"
    assert label(occupation="weldr") == "ELIGIBLE_FUZZY"


def test_identity_cards_skip_checks(spark):
    r = decide(spark, doc_type="NATIONAL_ID", occupation=None, employer_id=None)
    assert r["check_EMPLOYER"]["label"] == "NOT_APPLICABLE" and r["decision"]["recommendation"] == "RECOMMEND_APPROVE"


def test_rules_are_validated_and_named():
    with pytest.raises(ValueError):
        Rules(warn_days=-1).validate()
    with pytest.raises(ValueError):
        Rules(list_mode="X").validate()
    assert Rules().validate().version != Rules(warn_days=5).validate().version and len(fingerprint({"a": "b"})) == 12


def test_lookup_precedence(spark):
    occ = spark.createDataFrame([("ab", "x", "k", "1", True, 0), ("ab", "x", "k", "2", True, 1), ("cd", "ab", "", "3", True, 2)], "name_ar string, name_en string, aliases string, category string, eligible boolean, file_pos int")
    keys = {(r.method, r.key): r.category for r in lookups.occupation_keys(occ).collect()}
    assert keys[("exact", "ab")] == "2" and keys[("exact", "x")] == "1" and keys[("alias", "k")] == "1"


def test_history(spark):
    fields = spark.createDataFrame([(1, "occupation", "a", 0.5, "ocr", 1), (1, "nationality", "b", 0.5, "ocr", 1)], "doc_id long, field string, value string, confidence double, source string, version int")
    edits = spark.createDataFrame([(1, "occupation", "c", "me")], "doc_id long, field string, value string, by string")
    now = {r.field: r for r in history.corrected(fields, edits).where("is_current").collect()}
    assert (now["occupation"].value, now["occupation"].version, now["occupation"].confidence, now["nationality"].value) == ("c", 2, 1.0, "b")
    dec = spark.createDataFrame([(1, "MANUAL_REVIEW", ["r"], 1, False), (2, "MANUAL_REVIEW", ["r"], 1, False)], "doc_id long, status string, reasons array<string>, version int, is_final boolean")
    rev = spark.createDataFrame([(1, "APPROVED", [], "me"), (2, "REJECTED", [], "me")], "doc_id long, status string, reasons array<string>, reviewer string")
    done = {r.doc_id: r for r in history.signed_off(dec, rev).collect()}
    assert done[1].reasons == [] and done[1].version == 2 and done[2].reasons == ["r"]
    docs = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, batch_id long")
    assert history.queue(docs, dec, 0).count() == 2


def test_report_helpers(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"], ["OLD_LAYOUT: x: y"])], "r array<string>, t array<string>")
    got = df.select(report.numbered(F.col("r")).alias("n"), report.note_of(F.col("t"), "OLD_LAYOUT").alias("o")).first()
    assert tuple(got) == ("1. a; 2. b", "x: y")
    report.write_csv(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "r.csv"))
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfa,b") and raw.decode("utf-8-sig").split("\r\n")[2] == ""


def test_masking_of_nested_rows(spark):
    df = spark.createDataFrame([({"k": ["2999999999"]},)], "m map<string, array<string>>")
    assert audit.masked_rows(df).first()["m"] == {"k": ["2999******"]}


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "b.txt").write_bytes(b"hello")
    rows = ingest.accepted(ingest.files(spark, tmp_path.as_uri())).collect()
    assert sorted((r.mime, r.error is None) for r in rows) == [("application/octet-stream", False), ("image/png", True)]
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id long, sha256 string")
    assert {r.doc_id: r.duplicate_of for r in ingest.duplicates(docs).collect()} == {1: None, 2: None, 3: 1} == {r.doc_id: r.duplicate_of for r in ingest.first_seen(docs).collect()}
    (tmp_path / "r.csv").write_bytes("﻿code,name\nA,b\n".encode())
    assert ingest.reference_csv(spark, (tmp_path / "r.csv").as_uri(), ["code", "aliases"]).first()["code"] == "A"


BOX = "doc_id long, line int, text string, x int, y int, w int, h int, conf double"


def test_rows_merge_and_values_are_assigned(spark):
    lines = spark.createDataFrame([(1, 0, "right", 100, 0, 40, 20, 0.9), (1, 1, "next", 50, 2, 45, 20, 0.7), (1, 2, "far", 0, 100, 10, 20, 0.5)], BOX)
    rows = {r.text: r for r in extract.merged_rows(lines).collect()}
    assert set(rows) == {"right next", "far"} and rows["right next"].conf == pytest.approx(0.8) and rows["right next"].x == 50
    boxes = lines.withColumns({"field": F.when(F.col("line") == 0, "name"), "inline": F.lit(False), "ltr": F.lit(False)})
    assert [(r.field, r.text) for r in extract.values(boxes).collect()] == [("name", "next")]
    got = extract.values_by_range(boxes.where("line = 0"), lines.where("line > 0"))
    assert [(r.field, r.text) for r in got.collect()] == [("name", "next")]


def test_permuted_boxes_give_the_same_rows(spark):
    data = [(1, i, f"t{i}", 200 - 30 * i, 0, 28, 20, 0.9) for i in range(5)]
    a, b = (sorted(r.text for r in extract.merged_rows(spark.createDataFrame(d, BOX)).collect()) for d in (data, data[::-1]))
    assert a == b


def test_lookups_compose_presentation_forms(spark):
    occ = spark.createDataFrame([("مدرسة", "teacher", "ﻣﻌﻠﻢ|Ｐｅｄａｇｏｇｕｅ", "c", True, 0)], "name_ar string, name_en string, aliases string, category string, eligible boolean, file_pos int")
    asked = ["ﻣﺪﺭﺳﺔ", "ｔｅａｃｈｅｒ", "معلم", "pedagogue", " teacher ", "none"]
    got = lookups.occupation_match(spark.createDataFrame([(a,) for a in asked], "occupation string"), occ, 2.0).collect()
    assert {r.occupation: r.match and r.match.method for r in got} == dict(zip(asked, ["exact", "exact", "alias", "alias", "exact", None]))
    entries = spark.createDataFrame([("SA", "السعودية", "Saudi Arabia", "", 0)], "code string, name_ar string, name_en string, aliases string, file_pos int")
    codes = lookups.code_of(spark.createDataFrame([("ﺍﻟﺴﻌﻮﺩﻳﺔ",), ("saudi arabia",)], "n string"), entries, "n").collect()
    assert [(r.code, r.code_multiplier) for r in codes] == [("SA", 1.0)] * 2
    ref = spark.createDataFrame([("", "ﺷﺮﻛﺔ ﺍﻻﻣﻞ", "COMPANY", 0)], "employer_id string, employer_name string, employer_type string, file_pos int")
    cards = spark.createDataFrame([("7", "شركة الامل", "IQAMA", ["x", "ﺷﺮﻛﺔ ﺍﻻﻣﻞ"])], "employer_id string, employer_name string, doc_type string, companies array<string>")
    assert lookups.employer_reference(cards, ref).first()["ref_type"] == "COMPANY"
    assert lookups.company(cards, 0.9).first()["company"] == "ﺷﺮﻛﺔ ﺍﻻﻣﻞ"
    named = spark.createDataFrame([("9", "Ｍｉｎｉｓｔｒｙ of x", None)], "employer_id string, employer_name string, ref_type string")
    assert checks.with_employer_class(named, Rules(government=("ministry",))).first()["employer_class"]["type"] == "GOVERNMENT"
    left = lookups.upsert(ref, ref.withColumn("employer_name", F.lit("شركة الامل")), "employer_name").collect()
    assert [r.employer_name for r in left] == ["شركة الامل"]
    lines = spark.createDataFrame([(1, "ﺍﻟﻬﻮﻳﺔ ﺍﻟﻮﻃﻨﻴﺔ")], "doc_id int, text string")
    assert extract.document_type(lines, ["الهويه الوطنيه"], []).first()["doc_type"] == "NATIONAL_ID"
