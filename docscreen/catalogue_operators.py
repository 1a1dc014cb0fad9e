"""One query for each smaller operator over the test tables, with its SQL: files, batches, boxes, fields, versions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from docscreen import catalogue as C
from docscreen.functions import dates, fuzzy, numbers, text
from docscreen.operators import audit, checks, extract, fields, history, labels, lookups, report, rules
from docscreen.plans import similarity as M
from docscreen.plans import subjects as S
from docscreen.registry import query
from docscreen.registry import table as _table
from docscreen.sources import ingest
from docscreen.streaming import flows

_S = C._SUBJECTS
_KIND = "CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END"
_ERROR = f"CASE WHEN page_id % 5 = 0 THEN 'file too large (> 25 MB)' WHEN page_id % 4 = 3 THEN concat('unsupported or corrupt file (detected ', {_KIND}, ')') END"


def _files(spark, d):
    """Pages as files: their first bytes by page, a fifth of them said to be too long."""
    k = F.col("page_id") % 4
    head = F.when(k == 0, F.lit(b"%PDF-")).when(k == 1, F.lit(b"\x89PNG\r\n\x1a\n")).when(k == 2, F.lit(b"\xff\xd8\xff")).otherwise(F.lit(b"??"))
    raw = _table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 5 == 0, 26 << 20).otherwise(100).cast("long").alias("length"), head.alias("content"))
    return ingest.identified(raw)


# ---- files and batches


@query(f"SELECT page_id, {_ERROR} AS error FROM pages")
def file_acceptance(spark, d):
    return ingest.accepted(_files(spark, d)).select("page_id", "error")


@query(f"SELECT url AS path, page_id % 5 <> 0 AND page_id % 4 <> 3 AS taken, {_ERROR} AS error FROM pages")
def upload_split(spark, d):
    """All pages as one upload: what is taken and what is refused, with the reason."""
    taken, refused = ingest.upload(_files(spark, d), most=1 << 30)
    return taken.select("path", F.lit(True).alias("taken"), F.lit(None).cast("string").alias("error")).unionByName(refused.select("path", F.lit(False).alias("taken"), "error"))


@query("SELECT page_id, n, sha256(concat(sha256(coalesce(url, '')), cast(n AS varchar))) AS id FROM pages, (SELECT unnest([1, 2]) AS n) x")
def page_ids(spark, d):
    sha = F.sha2(F.coalesce("url", F.lit("")), 256)
    rows = _table(spark, d, "pages").select("page_id", sha.alias("sha"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return rows.select("page_id", "n", ingest.page_id(F.col("sha"), F.col("n")).alias("id"))


@query("SELECT c.c_custkey AS batch_id, c_name AS name, 'QUEUED' AS status, CASE WHEN c.c_custkey % 3 = 0 THEN '[\"Default\"]' ELSE concat('[\"', c_mktsegment, '\"]') END AS companies_json, concat('{\"site\":\"', c_nationkey, '\"}') AS project_json, 'v1' AS rules_version, coalesce(n, 0) AS total, 0 AS processed FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def batch_creation(spark, d):
    """Customers as new batches, orders as their documents; a third of them name no company."""
    c = _table(spark, d, "customer")
    asked = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("  "))).otherwise(F.array(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")), F.lit("")))
    new = ingest.batch_table(spark, c.select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("name"), asked.alias("companies"), F.create_map(F.lit("site"), F.col("c_nationkey").cast("string")).alias("project")), ["Default"], "v1")
    return ingest.totals(new, _table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id")))


@query("SELECT c_custkey AS id, c_name AS name, 'DONE' AS status, c_nationkey AS total, c_nationkey AS processed, '2026-01-02T03:04:05' AS created_at, 'v1' AS rules_version, c_mktsegment AS companies, concat('s', c_nationkey) AS site FROM customer")
def batch_projection(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("name"), F.lit("DONE").alias("status"), F.col("c_nationkey").alias("total"), F.col("c_nationkey").alias("processed"), F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5)).cast("timestamp_ntz").alias("created_at"), F.lit("v1").alias("rules_version"), F.to_json(F.array("c_mktsegment")).alias("companies_json"), F.to_json(F.struct(F.concat(F.lit("s"), "c_nationkey").alias("site"))).alias("project_json"))
    out = report.batch_rows(c)
    return out.select(*(x for x in out.columns if x not in ("companies", "project")), F.array_join("companies", ";").alias("companies"), F.col("project")["site"].alias("site"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'QUEUED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PROCESSING' ELSE 'ERROR' END END"


def _documents(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "DONE").when(s == "O", "QUEUED").when(F.col("o_orderkey") % 2 == 0, "PROCESSING").otherwise("ERROR")
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 20).alias("batch_id"), status.alias("status"))


@query(f"SELECT o_custkey % 20 AS batch_id, count(*) AS total, count_if({_STATUS} IN ('DONE', 'ERROR')) AS processed FROM orders GROUP BY 1")
def batch_progress(spark, d):
    return report.progress(_documents(spark, d))


@query(f"SELECT o_orderkey AS doc_id FROM orders WHERE {_STATUS} IN ('QUEUED', 'ERROR')")
def process_candidates(spark, d):
    return ingest.to_process(_documents(spark, d)).select("doc_id")


@query(f"SELECT o_orderkey AS doc_id, CASE {_STATUS} WHEN 'PROCESSING' THEN 'QUEUED' ELSE {_STATUS} END AS status, o_custkey % 20 IN (SELECT o_custkey % 20 FROM orders WHERE {_STATUS} = 'PROCESSING') AS stale FROM orders")
def stale_rows(spark, d):
    docs = _documents(spark, d)
    stale = audit.stale_batches(docs).withColumn("stale", F.lit(True))
    return audit.requeued(docs).join(stale, "batch_id", "left").select("doc_id", "status", F.coalesce("stale", F.lit(False)).alias("stale"))


@query(f"SELECT o_orderkey AS doc_id, {_STATUS} = 'ERROR' AS error FROM orders WHERE {_STATUS} = 'ERROR' OR o_orderpriority = '5-LOW'")
def decision_filter(spark, d):
    """ERROR is a document's status, everything else a decision's."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("status"))
    rows = _documents(spark, d).withColumnRenamed("status", "document_status").join(o, "doc_id")
    return report.by_decision(rows, "ERROR").unionByName(report.by_decision(rows, "5-LOW")).distinct().select("doc_id", (F.col("document_status") == "ERROR").alias("error"))


@query(f"{_S} SELECT doc_id FROM subjects WHERE contains(lower(concat('name_en:', name_en, ' occupation:', coalesce(occupation, ''))), 'red') OR contains(lower(concat('scan-', doc_id % 1000, '.png')), 'red')")
def text_search(spark, d):
    rows = S.subjects(spark, d).withColumn("file_name", F.concat(F.lit("scan-"), F.col("doc_id") % 1000, F.lit(".png")))
    return report.by_text(rows, F.struct("name_en", "occupation"), F.col("file_name"), "RED").select("doc_id")


# ---- boxes


def _boxes(spark, d):
    """Lines of an order as boxes on one row, three heights apart where a line's number is missing."""
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("w"), F.col("l_linenumber")).alias("text"), (F.col("l_linenumber") * 60).alias("x"), F.lit(100).alias("y"), F.lit(50).alias("w"), F.lit(20).alias("h"), (F.col("l_linenumber") / 10).cast("double").alias("conf")).dropDuplicates(["doc_id", "line"])


_LINES = "lines AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line FROM lineitem)"
_ISLANDS = f"WITH {_LINES}, cut AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line DESC) - line > 1, false) AS new FROM lines), isle AS (SELECT *, sum(cast(new AS int)) OVER (PARTITION BY doc_id ORDER BY line DESC) AS g FROM cut)"


@query(f"{_ISLANDS} SELECT doc_id, cast(g AS int) AS line, string_agg(concat('w', line), ' ' ORDER BY line DESC) AS text, min(line) * 60 AS x, (max(line) - min(line)) * 60 + 50 AS w, round(avg(line / 10), 6) AS conf, count(*) AS parts FROM isle GROUP BY doc_id, g")
def merged_boxes(spark, d):
    """Neighbouring lines merge from the right; a missing number begins a new row."""
    out = extract.merged_rows(_boxes(spark, d))
    return out.select("doc_id", "line", "text", "x", "w", F.round("conf", 6).alias("conf"), F.size("parts").cast("long").alias("parts"))


@query(f"{_ISLANDS} SELECT doc_id, min(line) * 60 AS x, max(line) * 60 + 50 - min(line) * 60 AS w, count(*) AS n FROM isle GROUP BY doc_id, g")
def merged_by_gaps(spark, d):
    out = extract.merged_rows_by_gaps(_boxes(spark, d).withColumn("row", F.lit(0)), "row")
    return out.select("doc_id", "x", "w", F.size(F.split("text", " ")).cast("long").alias("n"))


_LABELS = f"WITH {_LINES}, far AS (SELECT doc_id, max(line) AS hi, min(line) AS lo FROM lines GROUP BY doc_id HAVING max(line) > min(line))"


@query(f"{_LABELS}, free AS (SELECT l.*, hi, lo FROM lines l JOIN far USING (doc_id) WHERE line < hi AND line > lo), gap AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line DESC), hi) - line >= 3 AS cut FROM free), kept AS (SELECT *, bool_or(cut) OVER (PARTITION BY doc_id ORDER BY line DESC) AS gone FROM gap), first AS (SELECT doc_id, 'right' AS field, count(*) AS n, min(line) * 60 AS x1, max(line) * 60 + 50 AS x2 FROM kept WHERE NOT gone GROUP BY doc_id), left_ AS (SELECT k.*, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line), lo) AS before FROM kept k WHERE gone), ltr AS (SELECT *, bool_or(line - before >= 3) OVER (PARTITION BY doc_id ORDER BY line) AS cut2 FROM left_) SELECT * FROM first UNION ALL SELECT doc_id, 'left', count(*), min(line) * 60, max(line) * 60 + 50 FROM ltr WHERE NOT cut2 GROUP BY doc_id")
def exclusive_values(spark, d):
    """The rightmost box of an order is a label that reads from the right, the leftmost one that reads from the left; the
    first takes its chain, and the second what is left."""
    b = _boxes(spark, d)
    ends = b.groupBy("doc_id").agg(F.max("line").alias("hi"), F.min("line").alias("lo")).where("hi > lo")
    own = b.join(ends, "doc_id")
    rank = F.when(F.col("line") == F.col("hi"), 0).when(F.col("line") == F.col("lo"), 1)
    field = F.when(rank == 0, "right").when(rank == 1, "left")
    rows = own.select("doc_id", F.coalesce(rank, F.col("line") + 10).alias("line"), field.alias("field"), F.lit(None).cast("string").alias("inline"), F.coalesce(rank == 1, F.lit(False)).alias("ltr"), F.concat(F.lit("1"), F.col("text")).alias("text"), "x", "y", "w", "h", "conf")
    return extract.values(rows).select("doc_id", "field", F.size(F.split("text", " ")).cast("long").alias("n"), "x1", "x2")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part FROM lineitem WHERE NOT (l_discount < 0.15 AND l_linenumber % 3 = 0)")
def faint_boxes(spark, d):
    """A third of the boxes hold a short text; with little confidence they go."""
    b = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 3 == 0, " ab ").otherwise("abc").alias("text"), F.col("l_discount").alias("conf"))
    return extract.kept(b).select("doc_id", "line", "part")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey % 1000 AS x, l_suppkey % 600 AS y, 100 AS w, 20 AS h FROM lineitem")
def polygon_boxes(spark, d):
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") % 600
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.array(p(x + 100, y), p(x, y + 3), p(x + 2, y + 20), p(x + 99, y + 19)).alias("points"))
    return ingest.polygons(rows).drop("points")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, concat('t', l_linenumber) AS text, l_linenumber * 60 AS x, 100 AS y, 50 AS w, 20 AS h, l_discount AS conf FROM lineitem")
def provider_lines(spark, d):
    """A source of boxes by its name, in the form that all sources have."""
    p = ingest.Providers()
    p.register("lines", lambda s: _table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("line"), F.concat(F.lit("t"), "l_linenumber").alias("text"), (F.col("l_linenumber") * 60).cast("double").alias("x"), F.lit(100).alias("y"), F.lit(50).alias("w"), F.lit(20).alias("h"), F.col("l_discount").alias("conf")))
    return p.lines(spark, "lines")


@query("SELECT doc_id, CASE n WHEN 0 THEN 'name_ar' ELSE 'name_en' END AS field, CASE n WHEN 0 THEN 'علي حسن' ELSE concat('ANN ', 'LEE', doc_id) END AS value FROM (SELECT o_orderkey AS doc_id, unnest([0, 1]) AS n FROM orders) x")
def tallest_names(spark, d):
    """Of each script the row of the tallest box, in its reading order."""
    one = lambda n, t, x, y, h: F.struct(F.lit(n).alias("line"), (t if isinstance(t, Column) else F.lit(t)).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(50).alias("w"), F.lit(h).alias("h"), F.lit(0.9).alias("conf"))
    boxes = F.array(one(0, "صغير", 10, 300, 10), one(1, "حسن", 100, 50, 28), one(2, "علي", 200, 50, 30), one(3, "small", 10, 350, 10), one(4, F.concat(F.lit("Lee"), F.col("o_orderkey")), 200, 120, 24), one(5, "Ann", 100, 121, 26), one(6, "Ann علي", 100, 120, 90))
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(boxes).alias("b")).select("doc_id", "b.*")
    return extract.names(rows).select("doc_id", "field", "value")


@query("SELECT l_orderkey AS doc_id, l_partkey AS part, l_linenumber AS line, CASE WHEN u <= 6 THEN 60 WHEN u = 7 THEN 30 ELSE 50 END AS first_w, CASE WHEN u <= 7 THEN 2 ELSE 1 END AS n FROM (SELECT *, 3 + l_partkey % 9 AS u FROM lineitem) x")
def value_shares(spark, d):
    """A row of three boxes of four letters; the label ends in the second and leaves it a share."""
    box = lambda t, x, w: F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(w).alias("w"), F.lit(9).alias("h"), F.lit(0.9).alias("conf"))
    rows = _table(spark, d, "lineitem").withColumn("v", labels.value_boxes(F.array(box("abcd", 200, 40), box("efgh", 100, 60), box("ijkl", 0, 50)), (3 + F.col("l_partkey") % 9).cast("int")))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.get(F.col("v"), F.lit(0))["w"].alias("first_w"), F.size("v").alias("n"))


_ORDER = ("nationality", "occupation", "employer_id", "issue_place", "work_place", "employer_name")


@query("WITH f AS (SELECT o_orderkey AS doc_id, n, (o_orderkey >> n) % 2 = 1 AS there FROM orders, (SELECT unnest(range(6)) AS n) x), g AS (SELECT doc_id, n, there, max(CASE WHEN there THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, min(CASE WHEN there THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM f) SELECT doc_id, n AS place, up * 30 AS after, down * 30 AS before FROM g WHERE NOT there AND n <> 4 AND up IS NOT NULL AND down IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f f2 WHERE f2.doc_id = g.doc_id AND f2.n > up AND f2.n < down AND f2.n <> g.n AND f2.n <> 4 AND NOT f2.there)")
def row_order_gaps(spark, d):
    """Fields of a fixed order, present by the bits of an order's key; the one between two found ones, work_place aside."""
    places = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda n: F.call_function("shiftright", F.col("o_orderkey"), n) % 2 == 1)
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(places).alias("n"))
    found = rows.select("doc_id", F.get(F.lit(list(_ORDER)), F.col("n")).alias("field"), (F.col("n") * 30).alias("y"))
    out = extract.inferred_rows(found, list(_ORDER), ("work_place",))
    return out.select("doc_id", (F.array_position(F.lit(list(_ORDER)), F.col("field")) - 1).alias("place"), "after", "before")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '12345678' ELSE '1234567' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 0.2 ELSE 0.9 END::double AS conf FROM orders")
def best_readings(spark, d):
    """Of several readings of a number the one of the right length, then the surest."""
    r = lambda t, c: F.struct(F.lit(t).alias("text"), F.lit(c).alias("conf"))
    some = F.when(F.col("o_orderkey") % 3 == 0, F.array(r("12345678", 0.2), r("1234567", 0.9))).otherwise(F.array(r("1234567", 0.9), r("123456789", 0.5), r("12", 0.99)))
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(some).alias("r")).select("doc_id", "r.*")
    return extract.best_reading(rows, 8, "doc_id")


# ---- labels


_CARD = {"iqama_no": ["رقم الهوية", "ID Number"], "occupation": ["المهنة"], "expiry_date": ["تاريخ الانتهاء", "Expiry Date"]}


def _label_lines(spark, d):
    k = F.col("l_linenumber") % 5
    t = F.when(k == 0, F.concat(F.lit("رقم الهوية: "), F.col("l_linenumber"))).when(k == 1, "المهنة").when(k == 2, "Expiry Date: 26/02/2033").when(k == 3, "هوية مقيم").otherwise(F.concat(F.lit("text "), F.col("l_linenumber")))
    rows = _table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), t.alias("text"), F.lit(700).alias("x"), (F.col("l_linenumber") * 70 + 80).alias("y"), F.lit(290).alias("w"), F.lit(20).alias("h"), F.lit(0.9).alias("conf"), F.lit(1000).alias("card_w"), F.lit(600).alias("card_h"))


@query("SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line, CASE l_linenumber % 5 WHEN 0 THEN 'iqama_no' WHEN 1 THEN 'occupation' ELSE 'expiry_date' END AS field, l_linenumber % 5 <> 1 AS inline, l_linenumber % 5 = 2 AS ltr, CASE l_linenumber % 5 WHEN 0 THEN 100.1 WHEN 1 THEN 100.06 ELSE 100.11 END::double AS score FROM lineitem WHERE l_linenumber % 5 < 3")
def label_anchors(spark, d):
    """Labels with a value behind a colon, alone, and in Latin script; a header is no label."""
    found = labels.anchors(_label_lines(spark, d), _CARD, ["هويه مقيم"])
    return found.select("doc_id", "line", "field", F.col("inline").isNotNull().alias("inline"), "ltr", F.round("score", 4).alias("score"))


@query("WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line FROM lineitem), a AS (SELECT doc_id, line, 70 + line * 7 % 5 AS score FROM l) SELECT doc_id, arg_max(line, score * 100 - line) AS best, max(score) AS score FROM a GROUP BY doc_id")
def label_choice(spark, d):
    """A field's anchors of an order: the highest score, the first of equals."""
    n = F.col("l_linenumber")
    found = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("line"), F.lit(0).alias("part"), F.lit("occupation").alias("field"), (70 + n * 7 % 5).cast("double").alias("score"), F.lit(None).cast("string").alias("inline"), F.lit(0).alias("until"), F.lit(False).alias("ltr")).dropDuplicates(["doc_id", "line"])
    return labels.chosen(found).select("doc_id", F.col("best.line").alias("best"), F.col("best.score").cast("long").alias("score"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_suppkey % 4 = 0 THEN 0.8 WHEN l_suppkey % 4 < 3 THEN 0.95 ELSE 0.5 END::double AS confidence, CASE l_suppkey % 4 WHEN 0 THEN 'gregorian_line' WHEN 3 THEN concat('gregorian_line xcheck_mismatch(', strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m-%d'), ')') ELSE 'gregorian_line xcheck_ok' END AS note FROM lineitem")
def stray_date_check(spark, d):
    """Printed dates beside what was read: nothing, one and two days off, three."""
    day, k = F.to_date("l_shipdate"), (F.col("l_suppkey") % 4).cast("int")
    c = labels.crosschecked(F.when(k > 0, F.date_add(day, k)), day, F.lit(0.7))
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), c["confidence"].alias("confidence"), c["note"].alias("note"))


_PLACES = " + ".join(f"cast(substr(iqama_no, {i}, 1) <> substr(employer_id, {i}, 1) AS int)" for i in range(1, 11))


@query(f"{_S} SELECT doc_id, {_PLACES} AS places FROM subjects")
def differing_identifiers(spark, d):
    return S.subjects(spark, d).select("doc_id", numbers.differing_places(F.col("iqama_no"), F.col("employer_id")).alias("places"))


_OK = C._luhn_sql("iqama_no")


# the employer's number passes for the holder's where it begins alike and the holder's fails its check
_SWAP = f"(NOT {_OK} AND starts_with(employer_id, '2'))"
_THEIRS = f"NOT {_SWAP} AND substr(employer_id, 1, 1) IN ('1', '2', '7') AND ({_PLACES}) > 2"


@query(f"{_S} SELECT doc_id, CASE WHEN {_SWAP} THEN employer_id ELSE iqama_no END AS number, CASE WHEN {_OK} OR {_SWAP} THEN 0.855 ELSE round(0.9::double * 0.7::double * 0.95::double, 3) END::double AS confidence, CASE WHEN {_THEIRS} THEN employer_id END AS employer, CASE WHEN {_THEIRS} THEN 0.855::double END AS employer_confidence FROM subjects")
def identifiers_by_pattern(spark, d):
    """Both numbers printed without labels; the employer's must pass its check digit and differ from the holder's."""
    s = S.subjects(spark, d)
    box = lambda n, c: F.struct(F.lit(n).alias("line"), F.lit(0).alias("part"), F.col(c).alias("text"), F.lit(0.9).alias("conf"), F.col(c).alias("line_text"))
    boxes = s.select("doc_id", F.explode(F.array(box(0, "iqama_no"), box(1, "employer_id"))).alias("b")).select("doc_id", "b.*")
    none = F.lit(None).cast("string")
    out = labels.pattern_identifiers(boxes, s.select("doc_id", none.alias("iqama_no"), none.alias("employer_id"), F.lit(False).alias("is_national"), F.lit(False).alias("old_layout")))
    return out.select("doc_id", "iqama_no.number", "iqama_no.confidence", F.col("employer_id.number").alias("employer"), F.col("employer_id.confidence").alias("employer_confidence"))


@query("SELECT o_orderkey AS doc_id, cast(o_orderkey % 3 = 0 AS int) AS cues, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) THEN 'NATIONAL_ID' ELSE 'IQAMA' END AS kind, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) THEN 'SA' ELSE 'XX' END AS nationality FROM orders")
def document_kinds(spark, d):
    """Cues in a document's text, a number that begins with 1, and the nationality that follows."""
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, "الهوية الوطنية").when(k % 3 == 2, "هوية مقيم").otherwise("نص")
    lines = _table(spark, d, "orders").select(k.alias("doc_id"), F.lit(0).alias("line"), t.alias("text"), F.lit(300).alias("y"), F.lit(600).alias("card_h"))
    none = spark.createDataFrame([], "doc_id long, field string, best struct<line: int>")
    e = labels.evidence(lines, none)
    number = F.when(F.col("doc_id") % 2 == 0, "1000000000").otherwise("2000000000")
    kinds = e.select("doc_id", F.col("identity_cues").cast("int").alias("cues"), labels.document_kind(F.col("identity_cues"), number, F.col("permit")).alias("doc_type"))
    read = kinds.select("doc_id", F.lit("nationality").alias("field"), F.lit("xx").alias("raw"), F.lit("XX").alias("normalized"), F.lit(0.5).alias("confidence"), F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("note"))
    forced = fields.forced_nationality(read, kinds, "SA").select("doc_id", F.col("normalized").alias("nationality"))
    return kinds.join(forced, "doc_id").select("doc_id", "cues", F.col("doc_type").alias("kind"), "nationality")





@query("SELECT o_orderkey AS doc_id, 1 AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'AA' ELSE 'BB' END AS code, 0.8::double AS confidence FROM orders WHERE o_orderkey % 5 <> 0")
def nationality_in_boxes(spark, d):
    """A country's name on a free box of the value column; elsewhere it doesn't count."""
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, "الهند").otherwise("مصر")
    box = lambda n, t, x: F.struct(F.lit(n).alias("line"), t.alias("text"), x.alias("x"), F.lit(0.5).alias("conf"), F.lit(1000).alias("card_w"))
    free = _table(spark, d, "orders").select(k.alias("doc_id"), F.explode(F.array(box(0, F.lit("كلمة"), F.lit(800)), box(1, name, F.when(k % 5 == 0, 100).otherwise(800)))).alias("b")).select("doc_id", "b.*")
    entries = spark.createDataFrame([("AA", "India", "الهند", "", 0), ("BB", "Egypt", "مصر", "", 1)], "code string, name_en string, name_ar string, aliases string, file_pos int")
    return labels.nationality_by_vocabulary(free, entries).select("doc_id", "line", "code", "confidence")


# ---- fields and names


@query(f"""{_S}, rows AS (SELECT *, o_date FROM subjects JOIN (SELECT o_orderkey, cast(o_orderdate AS date) AS o_date FROM orders) o ON o_orderkey = doc_id)
SELECT doc_id, 'iqama_no' AS field, iqama_no AS normalized, CASE WHEN {_OK} THEN 0.86 ELSE round(0.8 * 0.96 * 1.0, 3) END::double AS confidence, CASE WHEN {_OK} THEN 'exact_chunk(luhn=True)' ELSE 'single_chunk(prefix_ok=True,luhn=False)' END AS note, CAST(NULL AS varchar) AS warning FROM rows
UNION ALL SELECT doc_id, 'expiry_date', strftime(o_date, '%Y-%m-%d'), CASE WHEN doc_id % 3 = 0 THEN 0.9 WHEN doc_id % 3 = 1 THEN round(0.768 * 0.6, 3) ELSE 0.768 END::double, CASE WHEN doc_id % 3 = 0 THEN 'direct xcheck_ok' WHEN doc_id % 3 = 1 THEN concat('direct xcheck_mismatch(', strftime(o_date + INTERVAL 9 DAY, '%Y-%m-%d'), ')') ELSE 'direct' END, CASE WHEN doc_id % 3 = 1 THEN concat('expiry_date: the two printed dates differ (', strftime(o_date, '%Y-%m-%d'), ' and ', strftime(o_date + INTERVAL 9 DAY, '%Y-%m-%d'), ')') END FROM rows
UNION ALL SELECT doc_id, 'nationality', CASE WHEN e.code IS NOT NULL THEN e.code WHEN length(r.nationality) = 8 THEN 'NATION_0' ELSE substr(r.nationality, 1, 8) END, CASE WHEN e.code IS NOT NULL THEN 0.8 WHEN r.nationality IS NULL THEN 0.0 WHEN length(r.nationality) = 8 THEN 0.676 ELSE 0.722 END::double, CASE WHEN r.nationality IS NULL THEN 'empty' WHEN e.code IS NOT NULL THEN 'exact' ELSE 'fuzzy' END, NULL FROM rows r LEFT JOIN entries e ON e.code = r.nationality
UNION ALL SELECT doc_id, 'version_no', cast(doc_id AS varchar), 0.768::double, NULL, NULL FROM rows
UNION ALL SELECT doc_id, 'occupation', occupation, 0.768::double, NULL, NULL FROM rows""")
def extract_fields(spark, d):
    """Every kind of field by its own rule, with a second copy of the date that agrees, differs or is absent."""
    s = S.subjects(spark, d).join(_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day")), "doc_id")
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    one = lambda f, raw, second=none: F.struct(F.lit(f).alias("field"), raw.alias("raw"), second.alias("second"))
    second = F.when(k == 0, F.date_format(F.date_add("day", 2), "dd/MM/yyyy")).when(k == 1, F.date_format(F.date_add("day", 9), "dd/MM/yyyy"))
    each = F.array(one("iqama_no", F.col("iqama_no")), one("expiry_date", F.date_format("day", "yyyy/MM/dd"), second), one("nationality", F.col("nationality")), one("version_no", F.concat(F.lit("v "), F.translate(F.col("doc_id").cast("string"), "0123456789", text.ARABIC_DIGITS))), one("occupation", F.concat(F.lit(" :"), F.col("occupation"), F.lit(". "))))
    rows = s.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*", F.lit(0.8).alias("value_conf"), F.lit(80.0).alias("score"), F.lit(False).alias("is_national"))
    return fields.normalised(rows, S.entries(spark, d)).select("doc_id", "field", "normalized", "confidence", "note", "warning")


@query("SELECT o_orderkey, cast(o_orderkey % 97 AS varchar) AS digits, concat('10', o_orderkey % 97, '5') AS repaired FROM orders")
def numeric_repair(spark, d):
    n = (F.col("o_orderkey") % 97).cast("string")
    rows = _table(spark, d, "orders")
    return rows.select("o_orderkey", text.numeric_only(F.concat(F.lit("x-"), F.translate(n, "0123456789", text.EXTENDED_DIGITS))).alias("digits"), text.numeric_only(F.concat(F.lit("lO "), n, F.lit("/S"))).alias("repaired"))


@query("SELECT p_partkey, p_name AS clean, CAST(NULL AS varchar) AS nothing FROM part")
def clean_names(spark, d):
    c = F.concat(F.lit(" :ا ب "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" ج -._"))
    return _table(spark, d, "part").select("p_partkey", text.clean(c).alias("clean"), text.clean(F.lit(" .:- ")).alias("nothing"))


@query("SELECT p_partkey, p_name AS canonical, 'االاهيوي,' AS letters FROM part")
def canonical_forms(spark, d):
    """Full-width letters, presentation forms, no-break spaces, diacritics and letter variants come to one form."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "".join(chr(0xFEE0 + ord(c)) for c in "abcdefghijklmnopqrstuvwxyz") + " ")
    return _table(spark, d, "part").select("p_partkey", text.canonical(F.concat(F.lit("  "), wide, F.lit("　"))).alias("canonical"), text.canonical(F.lit("ﺍَآﻟـأﺓىؤئ،")).alias("letters"))


@query("SELECT o_orderkey, concat_ws(',', concat('1', lpad(cast(o_orderkey AS varchar), 9, '0')), concat('2', lpad(cast(o_custkey AS varchar), 9, '0'))) AS found FROM orders")
def ten_digit_numbers(spark, d):
    pad = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 9, "0"))
    t = F.concat(F.lit("a "), pad("1", "o_orderkey"), F.lit(" 12345678901 "), F.translate(pad("2", "o_custkey"), "0123456789", text.ARABIC_DIGITS), F.lit(" 123"))
    return _table(spark, d, "orders").select("o_orderkey", F.array_join(text.find_ten_digit_numbers(t), ",").alias("found"))


@query("SELECT p_partkey, p_name AS first, 2 AS n, p_partkey % 4 < 2 AS yes, p_partkey % 4 <> 2 AS yes_or_empty FROM part")
def alias_and_truth(spark, d):
    a = text.aliases(F.concat(F.lit(" "), F.col("p_name"), F.lit(" | |x|")))
    k = F.col("p_partkey") % 4
    word = F.when(k == 0, " YES ").when(k == 1, "نعم").when(k == 2, "no").otherwise(" ")
    return _table(spark, d, "part").select("p_partkey", F.get(a, F.lit(0)).alias("first"), F.size(a).alias("n"), text.truthy(word).alias("yes"), text.truthy(word, True).alias("yes_or_empty"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[؀-ۿ]') AS arabic, regexp_matches(coalesce(text, ''), '[A-Za-z]') AS latin FROM documents")
def script_predicates(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.has_arabic(F.col("text")).alias("arabic"), text.has_latin(F.col("text")).alias("latin"))


@query("SELECT event_id, concat('u 1234****** ', user_id) AS inner_text, concat(event_type, ' 2000******') AS item, 'x 12345678901' AS kept, user_id FROM events")
def nested_masking(spark, d):
    """Identifiers in structs, arrays and maps are masked; longer numbers and other types stay."""
    e = _table(spark, d, "events")
    rows = e.select("event_id", F.struct(F.concat(F.lit("u 1234567890 "), F.col("user_id")).alias("t"), F.col("user_id").alias("n")).alias("s"), F.array(F.concat(F.col("event_type"), F.lit(" 2000000014"))).alias("a"), F.create_map(F.lit("k"), F.lit("x 12345678901")).alias("m"))
    return audit.masked_rows(rows).select("event_id", F.col("s.t").alias("inner_text"), F.get("a", F.lit(0)).alias("item"), F.col("m")["k"].alias("kept"), F.col("s.n").alias("user_id"))


@query(f"{_S} SELECT doc_id, concat(substr(iqama_no, 1, 4), '******') AS value, CASE WHEN doc_id % 2 = 0 THEN concat(substr(iqama_no, 1, 4), '******') ELSE concat('no ', iqama_no) END AS raw, name_en AS name FROM subjects")
def masked_fields(spark, d):
    """A sensitive value is masked, its raw text only where it is nothing but digits; other fields stay."""
    s = S.subjects(spark, d)
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("iqama_no")).otherwise(F.concat(F.lit("no "), F.col("iqama_no")))
    one = lambda f, r, n: F.struct(F.lit(f).alias("field"), r.alias("raw"), n.alias("normalized"))
    rows = s.select("doc_id", F.explode(F.array(one("iqama_no", raw, F.col("iqama_no")), one("name_en", F.col("name_en"), F.col("name_en")))).alias("x")).select("doc_id", "x.*")
    out = report.shown_fields(rows)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return out.groupBy("doc_id").agg(pick("iqama_no", "normalized").alias("value"), pick("iqama_no", "raw").alias("raw"), pick("name_en", "normalized").alias("name"))


_TYPED = "WITH asked AS (SELECT DISTINCT substr(n_name, 1, length(n_name) - 1) AS a FROM nation), keys AS (SELECT lower(n_name) AS b, n_name AS code, n_nationkey AS pos FROM nation WHERE n_nationkey % 5 <> 4), met AS (SELECT lower(a) AS a, b FROM asked, keys)"


@query(M.ratio_sql(_TYPED, "met", "best AS (SELECT r.a, k.code, round(r.s / 100, 2) AS m, row_number() OVER (PARTITION BY r.a ORDER BY r.s DESC, k.pos) AS n FROM ratios r JOIN keys k USING (b) WHERE r.s >= 80) SELECT n_nationkey, code, m AS multiplier FROM nation LEFT JOIN best ON best.a = lower(substr(n_name, 1, length(n_name) - 1)) AND best.n = 1"))
def name_codes(spark, d):
    """Country names without their last letter, by the list's closest name; the first of equals."""
    asked = _table(spark, d, "nation").select("n_nationkey", F.expr("substr(n_name, 1, length(n_name) - 1)").alias("asked"))
    return lookups.code_of(asked, S.entries(spark, d), "asked").select("n_nationkey", "code", F.col("code_multiplier").alias("multiplier"))


@query("WITH ref AS (SELECT s_suppkey, s_name FROM supplier) SELECT o_orderkey AS doc_id, CASE WHEN s.s_suppkey % 3 = 0 THEN 'COMPANY' WHEN s.s_suppkey % 3 = 1 THEN 'GOVERNMENT' END AS ref_type FROM orders JOIN supplier s ON s.s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)")
def employer_reference_join(spark, d):
    """Employers in a reference file by number, else by name; a third of them in neither."""
    s = _table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    ref = s.where(k < 2).select(F.when(k == 0, F.col("s_suppkey").cast("string")).otherwise("").alias("employer_id"), F.when(k == 1, F.upper("s_name")).otherwise("").alias("employer_name"), F.when(k == 0, "COMPANY").otherwise("GOVERNMENT").alias("employer_type"), F.col("s_suppkey").alias("file_pos"))
    ref = ref.unionByName(ref.withColumns({"employer_type": F.lit("OLD"), "file_pos": F.lit(-1).cast("long")}))
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % s.count()).alias("s_suppkey")).join(s, "s_suppkey")
    rows = o.select("doc_id", F.col("s_suppkey").cast("string").alias("employer_id"), F.concat(F.lit(" "), F.col("s_name"), F.lit("  ")).alias("employer_name"))
    return lookups.employer_reference(rows, ref).select("doc_id", "ref_type")


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), ',', strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')) AS found FROM orders")
def dates_found(spark, d):
    day = F.to_date("o_orderdate")
    t = F.concat(F.lit("a "), F.date_format(day, "yyyy/MM/dd"), F.lit(" 2020-02-31 "), F.translate(F.date_format(F.date_add(day, 1), "yyyy.M.d"), "0123456789", text.ARABIC_DIGITS))
    return _table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(dates.find_dates(t), lambda x: x.cast("string")), ",").alias("found"))


@query(f"WITH {C._MONTHS}, h AS (SELECT o_orderkey, cast(o_orderdate AS date) AS day, {C._LUNAR} AS h FROM orders JOIN months ON cast(o_orderdate AS date) >= first AND cast(o_orderdate AS date) < first + cast(days AS int)) SELECT o_orderkey, day AS found, CASE WHEN o_orderkey % 3 < 2 THEN 0.7 ELSE 0.7 END::double AS multiplier, CASE o_orderkey % 3 WHEN 0 THEN 'sep_repair_natural' WHEN 1 THEN '8digits_hijri_natural' ELSE 'direct_hijri' END AS note FROM h")
def hijri_dates_resolved(spark, d):
    """Hijri dates with a misread separator, without any, and as printed."""
    rows = dates.gregorian_to_hijri(_table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", "h")
    y, m, dd, k = F.substring("h", 7, 4), F.substring("h", 4, 2), F.substring("h", 1, 2), F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat(y, m, F.lit("8"), dd)).when(k == 1, F.concat(y, m, dd)).otherwise(F.concat(y, F.lit("/"), m, F.lit("/"), dd))
    out = dates.resolve_date(rows.withColumn("t", t), "t", "r")
    return out.select("o_orderkey", F.col("r.date").alias("found"), F.col("r.multiplier").alias("multiplier"), F.col("r.note").alias("note"))


# ---- decisions and versions


@query("SELECT o_orderkey AS doc_id, '1. late; 2. old' AS numbered, CASE WHEN o_orderkey % 2 = 0 THEN 'check by hand' END AS note, 2 AS n, 'late' AS first FROM orders")
def stored_lists(spark, d):
    """Lists kept as JSON and read again, numbered for people; malformed text is an empty list."""
    k = F.col("o_orderkey")
    t = F.when(k % 2 == 0, F.array(F.lit("LOW: x"), F.lit("OLD_LAYOUT: check by hand"))).otherwise(F.array(F.lit("LOW: x")))
    rows = _table(spark, d, "orders").select(k.alias("doc_id"), F.array(F.lit("late"), F.lit("old")).alias("reasons"), t.alias("triggers"))
    back = report.restored(report.stored(rows))
    return back.select("doc_id", report.numbered(F.col("reasons")).alias("numbered"), report.note_of(F.col("triggers"), "OLD_LAYOUT").alias("note"), F.size("reasons").alias("n"), F.get("reasons", F.lit(0)).alias("first"))


@query("SELECT c_custkey AS batch_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS documents, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS fields FROM customer")
def collected_batches(spark, d):
    """Customers with their orders, and those with their lines; none lacks for having none."""
    o = _table(spark, d, "orders")
    fs = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("field"), F.lit("x").alias("normalized"), F.col("l_discount").alias("confidence"))
    out = report.collected(_table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id")), o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("doc_id")), fs, o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("status")))
    per = F.aggregate("documents", F.lit(0), lambda s, x: s + F.coalesce(F.size(x["fields"]), F.lit(0)))
    return out.select("batch_id", F.coalesce(F.size("documents"), F.lit(0)).cast("long").alias("documents"), F.coalesce(per, F.lit(0)).cast("long").alias("fields"))


@query("SELECT user_id AS doc_id, max(event_id) AS review_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def latest_reviews(spark, d):
    return history.latest_review(_table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("review_id"), F.col("event_type").alias("status")))


@query(f"{_S} SELECT doc_id, field, CASE field WHEN 'expiry_date' THEN CASE WHEN doc_id % 2 = 0 THEN '2026-01-02' END WHEN 'iqama_no' THEN iqama_no ELSE NULL END AS value, CASE WHEN field = 'expiry_date' AND doc_id % 2 = 1 THEN 'expiry_date: cannot parse date ''soon'' (use YYYY-MM-DD)' WHEN field = 'employer_id' THEN 'employer_id: must be 10 digits' WHEN field = 'nationality' THEN 'nationality: ''nowhere'' not in the list' END AS error FROM subjects, (SELECT unnest(['expiry_date', 'iqama_no', 'employer_id', 'nationality', 'occupation']) AS field) f")
def manual_values(spark, d):
    """Typed-in values: dates, numbers in either script, codes, and what is refused."""
    even = F.col("doc_id") % 2 == 0
    one = lambda f, v, day=None: F.struct(F.lit(f).alias("field"), v.alias("v"), (day if day is not None else F.lit(None).cast("date")).alias("day"))
    each = F.array(one("expiry_date", F.when(even, " 2026-01-02 ").otherwise("soon"), F.when(even, F.lit(datetime.date(2026, 1, 2)))), one("iqama_no", F.translate("iqama_no", "0123456789", text.ARABIC_DIGITS)), one("employer_id", F.lit("12")), one("nationality", F.lit("nowhere")), one("occupation", F.lit("  ")))
    rows = S.subjects(spark, d).select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")
    r = history.manual_value(F.col("field"), F.col("v"), F.col("day"), F.lit(None).cast("string"))
    return rows.select("doc_id", "field", r["value"].alias("value"), r["error"].alias("error"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.6 END::double AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'ocr' END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders")
def corrections(spark, d):
    """Every fifth document's field is corrected; the current version of each."""
    o = _table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("occupation").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(0.6).alias("confidence"), F.lit("ocr").alias("source"), F.lit(1).alias("version"))
    edits = old.where("doc_id % 5 = 0").select("doc_id", "field", F.lit("new").alias("value"), F.lit("ann").alias("by"))
    return history.corrected(old, edits).where("is_current").select("doc_id", "value", "confidence", "source", "version")


_EDITED = _S.replace("subjects AS (", "original AS (", 1) + ", subjects AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN DATE '2001-01-01' ELSE expiry_date END AS expiry_date, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE expiry_date_conf END AS expiry_date_conf) FROM original)"


@query(f"{_EDITED} SELECT doc_id, status, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 5 = 0 THEN 'ann' ELSE 'engine' END AS decided_by FROM ({C._DECISION}) z")
def redecisions(spark, d):
    """Every fifth document's expiry is corrected; it is validated and decided again, one version later."""
    names = ("expiry_date",)
    s = S.subjects(spark, d)
    first = C._decided(spark, d).select("doc_id", F.col("decision.status").alias("status"), F.lit(1).alias("version"), F.lit(False).alias("is_final"), F.lit("engine").alias("decided_by"))
    fs = s.select("doc_id", F.lit("expiry_date").alias("field"), F.col("expiry_date").cast("string").alias("value"), F.col("expiry_date_conf").alias("confidence"), F.lit("ocr").alias("source"), F.lit(1).alias("version"))
    edits = fs.where("doc_id % 5 = 0").select("doc_id", "field", F.lit("2001-01-01").alias("value"), F.lit("ann").alias("by"))

    def decide(now):
        wide = fields.wide(now.select("doc_id", "field", F.col("value").alias("normalized"), "confidence"), names)
        rest = s.drop("expiry_date", "expiry_date_conf").join(wide.withColumn("expiry_date", F.to_date("expiry_date")), "doc_id")
        rows = lookups.by_code(checks.validated(rest, C.RULES, C._as_of()).drop("warnings"), S.entries(spark, d), "nationality").withColumn("ref_type", F.lit(None).cast("string"))
        rows = lookups.occupation_match(rows, S.occupations(spark, d), C.RULES.fuzzy_threshold)
        return checks.decided(checks.checked(rows, C.RULES, C._as_of()), C.RULES)

    _, decisions = history.redecided(fs, edits, first, decide)
    return decisions.where("is_current").select("doc_id", "status", "version", "decided_by")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'By Hand' ELSE o_orderpriority END AS company, CASE WHEN o_orderkey % 4 = 0 THEN 'MANUAL' ELSE 'AUTO' END AS company_source FROM orders")
def manual_companies(spark, d):
    """A company that a person set stays when documents are processed again."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("company"), F.lit("AUTO").alias("company_source"))
    by_hand = o.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("Older").alias("company"), F.lit(1).alias("set_at")), F.struct(F.lit(" By Hand ").alias("company"), F.lit(2).alias("set_at")))).alias("x")).select("doc_id", "x.*")
    return history.with_company(o.select("doc_id"), o, by_hand)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_orderkey % 5 = 0 THEN 'Rejected by reviewer' ELSE 'engine' END AS reasons, 4 AS version, true AS is_final FROM orders")
def sign_off(spark, d):
    """A person's word is final: approval clears reasons, rejection has the reviewer's, the engine's or a default one."""
    k, some = F.col("doc_id"), lambda t: F.array(F.lit(t))
    no = F.array().cast("array<string>")
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    old = o.select("doc_id", F.lit("MANUAL_REVIEW").alias("status"), F.when(k % 5 == 0, no).otherwise(some("engine")).alias("reasons"), F.explode(F.array(F.lit(1), F.lit(3))).alias("version"))
    reviews = o.select("doc_id", F.when(k % 2 == 0, "APPROVED").otherwise("REJECTED").alias("status"), F.when(k % 3 == 0, F.array(F.lit("own"), F.lit(" "))).otherwise(no).alias("reasons"), F.lit("ann").alias("reviewer"))
    return history.signed_off(old, reviews).select("doc_id", "status", F.array_join("reasons", ";").alias("reasons"), "version", "is_final")


@query(f"{_S} SELECT doc_id, {C._EXPIRY} AS expiry, CASE WHEN quality < 0.5 THEN 'FAIL' ELSE 'PASS' END AS sharp, 'PASS' AS nationality FROM subjects WHERE nationality IS NOT NULL")
def further_checks(spark, d):
    """A check of one's own beside the others, and all of them by name."""
    own = rules.Rules(order=("NATIONALITY", "EXPIRY", "SHARP"), further_checks=("SHARP",)).validate()
    sharp = checks._result(F.when(F.col("quality") < 0.5, "FAIL").otherwise("PASS"), F.lit("SHARP"), F.lit(1.0), F.lit(None))
    rows = lookups.by_code(S.subjects(spark, d).where("nationality is not null"), S.entries(spark, d), "nationality").withColumn("ref_type", F.lit(None).cast("string"))
    rows = checks.checked(rows.withColumn("match", F.lit(None).cast("struct<name_ar: string, name_en: string, eligible: boolean, method: string, score: double>")), own, C._as_of(), {"SHARP": sharp})
    m = checks.by_name(own)
    return rows.withColumn("m", m).select("doc_id", F.col("m")["EXPIRY"]["label"].alias("expiry"), F.col("m")["SHARP"]["outcome"].alias("sharp"), F.col("m")["NATIONALITY"]["outcome"].alias("nationality"))


@query("SELECT substr(sha256(concat('a.yaml', 'x: 1', 'b.csv', 'code')), 1, 12) AS version, count(*) AS n FROM nation")
def config_fingerprint(spark, d):
    return _table(spark, d, "nation").groupBy(F.lit(rules.fingerprint({"a.yaml": "x: 1", "b.csv": "code"})).alias("version")).agg(F.count("*").alias("n"))


@query("SELECT least(greatest(max(length(p_name)) + 2, 10), 60) AS p_name, least(greatest(max(length(p_type)) + 2, 10), 60) AS p_type FROM part")
def sheet_widths(spark, d):
    return report.column_widths(_table(spark, d, "part").select("p_name", "p_type"))


# ---- retention, history, streams


_OLD = "o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 365 DAY"


@query(f"SELECT 'batch' AS kind, count(*) AS n FROM orders WHERE NOT {_OLD} UNION ALL SELECT 'line', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT {_OLD} UNION ALL SELECT 'log', count(*) FROM orders WHERE {_OLD}")
def retention_run(spark, d):
    """Old orders go with their lines, and each leaves a line in the log."""
    b = _table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("created_at"))
    left, children, log = audit.purged(b, {"line": _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"))}, F.lit("2000-01-01").cast("timestamp_ntz"), 365)
    n = lambda df, k: df.groupBy(F.lit(k).alias("kind")).agg(F.count("*").alias("n"))
    return n(left, "batch").unionByName(n(children["line"], "line")).unionByName(n(log, "log"))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS has_image, o_orderkey % 3 = 0 AS gone FROM orders")
def tombstones(spark, d):
    """Images of decided documents go; the time stays."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    docs = o.withColumns({"image": F.lit(b"x"), "image_deleted_at": F.lit(None).cast("timestamp_ntz")})
    out = audit.tombstoned(docs, o.where("doc_id % 3 = 0"), F.lit("2026-01-01").cast("timestamp_ntz"))
    return out.select("doc_id", F.col("image").isNotNull().alias("has_image"), F.col("image_deleted_at").isNotNull().alias("gone"))


@query("SELECT doc_id, doc_id % 2 = 0 AS known FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def unseen_documents(spark, d):
    """Odd documents as new ones against the even ones as history: those whose content never came."""
    docs = _table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.unseen(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id", (F.col("doc_id") % 2 == 0).alias("known"))


@query("SELECT event_type AS action, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_actions(spark, d):
    """The flow's counts by hour, over the table at rest."""
    out = flows.action_counts(_table(spark, d, "events").withColumnRenamed("event_type", "action"))
    return out.select("action", F.col("window.start").cast("timestamp_ntz").alias("hour"), F.col("count").alias("n"))


@query("SELECT DISTINCT p_name AS a, 100.0::double AS alike, 0.96::double AS factor FROM part")
def label_factors(spark, d):
    c = F.col("p_name")
    rows = _table(spark, d, "part").select("p_name").distinct()
    return rows.select(c.alias("a"), fuzzy.alignment(c, F.concat(F.lit("xx "), c, F.lit(" yy")))["score"].alias("alike"), F.round(fuzzy.label_factor(F.lit(80.0)), 6).alias("factor"))
