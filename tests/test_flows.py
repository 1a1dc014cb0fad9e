"""Streaming flows and the smaller operators, each run on a few invented rows."""

import datetime

from pyspark.sql import functions as F

from docscreen.operators import audit, extract, history, lookups, report
from docscreen.sources import ingest
from docscreen.streaming import flows

BOX = "doc_id long, line int, text string, x int, y int, w int, h int, conf double"


def test_files_are_screened_once(spark, tmp_path):
    folder, sink = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (folder / "b.txt").write_bytes(b"no")
    run = lambda: flows.process(spark, folder.as_uri(), sink.as_uri(), (tmp_path / "check").as_uri(), lambda d: d.select("path", "sha256")).awaitTermination()
    run()
    run()
    assert sorted(r.error is None for r in spark.read.option("mergeSchema", True).parquet(sink.as_uri()).collect()) == [False, True]


def test_action_counts_and_bounded_duplicates(spark, tmp_path):
    rows = [(datetime.datetime(2026, 1, 1, h), "A", "x") for h in (0, 0, 1)]
    spark.createDataFrame(rows, "ts timestamp_ntz, action string, sha256 string").write.parquet((tmp_path / "e").as_uri())
    events = spark.readStream.schema("ts timestamp_ntz, action string, sha256 string").parquet((tmp_path / "e").as_uri())
    for name, df, mode in (("counts", flows.action_counts(events), "complete"), ("fresh", flows.fresh(events), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", (tmp_path / name).as_uri()).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["count"] for r in spark.table("counts").collect()) == [1, 2] and spark.table("fresh").count() == 1


def test_lookups_by_name_code_and_reference(spark):
    entries = spark.createDataFrame([("AA", "Aland", "ا", "aal|al", True, 0), ("BB", "Beland", "ب", "", False, 1)], "code string, name_en string, name_ar string, aliases string, approved boolean, file_pos int")
    asked = spark.createDataFrame([("ALAND",), ("aal",), ("belandd",), ("zz",)], "n string")
    assert {r.n: r.code for r in lookups.code_of(asked, entries, "n").collect()} == {"ALAND": "AA", "aal": "AA", "belandd": "BB", "zz": None}
    ref = spark.createDataFrame([("7", "North Co", "COMPANY", 0), ("7", "Other", "GOVERNMENT", 1)], "employer_id string, employer_name string, employer_type string, file_pos int")
    rows = spark.createDataFrame([("7", None), (None, "north  co"), ("8", "x")], "employer_id string, employer_name string")
    assert [r.ref_type for r in lookups.employer_reference(rows, ref).orderBy("employer_id").collect()] == ["COMPANY", "GOVERNMENT", None]
    cards = spark.createDataFrame([(1, "IQAMA", "north co", ["South", "North Co"]), (2, "IQAMA", "zzz", ["South"]), (3, "NATIONAL_ID", "x", ["South"]), (4, "IQAMA", None, [" "])], "doc_id long, doc_type string, employer_name string, companies array<string>")
    got = {r.doc_id: (r.company, r.company_source, r.needs_choice) for r in lookups.company(cards, 0.85, ("Default",)).collect()}
    assert got == {1: ("North Co", "AUTO", False), 2: ("zzz", "CARD", True), 3: ("South", "NATIONAL_ID", False), 4: ("Default", "CARD", True)}


def test_manual_values(spark):
    rows = [("expiry_date", "2026-01-02", datetime.date(2026, 1, 2), None), ("expiry_date", "x", None, None), ("iqama_no", "٢٠٠٠٠٠٠٠١٧", None, None), ("iqama_no", "12", None, None), ("nationality", "q", None, None), ("occupation", " ", None, None)]
    df = spark.createDataFrame(rows, "f string, v string, d date, c string").select(history.manual_value(F.col("f"), F.col("v"), F.col("d"), F.col("c")).alias("x"))
    got = [tuple(r["x"]) for r in df.collect()]
    assert [g[0] for g in got] == ["2026-01-02", None, "2000000017", None, None, None] and [g[1] is None for g in got] == [True, False, True, False, False, True]


def test_names_types_and_missing_rows(spark):
    lines = spark.createDataFrame([(1, 0, "BIG NAME", 10, 0, 50, 30, 0.8), (1, 1, "small", 10, 100, 50, 10, 0.9), (1, 2, "اسم", 80, 0, 20, 20, 0.7)], BOX)
    assert {r.field: r.value for r in extract.names(lines).collect()} == {"name_en": "BIG NAME", "name_ar": "اسم"}
    assert extract.document_type(lines, ["big", "name"], ["permit"]).first().doc_type == "NATIONAL_ID"
    found = spark.createDataFrame([(1, "a", 10), (1, "c", 30)], "doc_id long, field string, y int")
    assert [tuple(r) for r in extract.inferred_rows(found, ["a", "b", "c"]).collect()] == [(1, "b", 10, 30)]
    # a gap of 20 is within 1.2 times the smaller height, 20: the window form agrees with the exact one
    assert {r.text for r in extract.merged_rows_by_gaps(lines.withColumn("r", F.col("y")), "r").collect()} == {r.text for r in extract.merged_rows(lines).collect()} == {"اسم BIG NAME", "small"}
    assert extract.kept(lines.withColumn("conf", F.lit(0.1)).withColumn("text", F.lit(" x "))).count() == 0


def test_retention_and_requeue(spark):
    docs = spark.createDataFrame([(1, 5, "PROCESSING", b"i", None), (2, 6, "DONE", b"i", None)], "doc_id long, batch_id long, status string, image binary, image_deleted_at timestamp")
    assert [r.status for r in audit.requeued(docs).orderBy("doc_id").collect()] == ["QUEUED", "DONE"] and [r.batch_id for r in audit.stale_batches(docs).collect()] == [5]
    gone = audit.tombstoned(docs, docs.where("doc_id = 2"), F.lit("2026-01-01").cast("timestamp")).orderBy("doc_id").collect()
    assert [r.image is None for r in gone] == [False, True] and gone[1].image_deleted_at is not None
    assert [r.doc_id for r in audit.without(docs, docs.where("doc_id = 2"), "doc_id").collect()] == [1]


def test_report_filters(spark):
    rows = spark.createDataFrame([(1, "APPROVED", "DONE", "scan.png"), (2, None, "ERROR", "b")], "doc_id long, status string, document_status string, f string")
    assert report.by_decision(rows, "ERROR").first().doc_id == 2 and report.by_decision(rows, "APPROVED").first().doc_id == 1
    assert report.by_text(rows, F.struct("status"), F.col("f"), "SCAN").count() == 1 and report.by_text(rows, F.struct("status"), F.col("f"), "status").count() == 1
    assert report.progress(rows.select(F.lit(1).alias("batch_id"), F.col("document_status").alias("status"))).first().processed == 2
    assert report.column_widths(rows).first().doc_id == 10
    box = spark.createDataFrame([([(1, 2), (5, 9)],)], "points array<struct<x: int, y: int>>")
    assert tuple(ingest.polygons(box).first())[1:] == (1, 2, 4, 7)
