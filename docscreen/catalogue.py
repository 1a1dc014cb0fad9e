"""The driver's queries over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.functions import crypto, dates, fuzzy, numbers, text
from docscreen.operators import audit, checks, extract, history, labels, lookups, report
from docscreen.operators.rules import Rules
from docscreen.plans import similarity as M
from docscreen.plans import subjects as S
from docscreen.registry import ORACLE_SQL, QUERIES, query
from docscreen.registry import table as _table
from docscreen.sources import ingest

__all__ = ["ORACLE_SQL", "QUERIES"]

_SUBJECTS = f"WITH subjects AS ({S.subjects_sql()}), entries AS ({S.ENTRIES.replace('{nation}', 'nation')}), occupations AS ({S.OCCUPATIONS.replace('{text}', 'varchar').replace('{part}', 'part')})"
RULES = Rules().validate()


def _as_of():
    return F.lit(datetime.date.fromisoformat(S.AS_OF))


_EXPIRY = f"CASE WHEN expiry_date IS NULL THEN 'DATE_NOT_READABLE' WHEN expiry_date < DATE '{S.AS_OF}' THEN 'EXPIRED' WHEN expiry_date - DATE '{S.AS_OF}' <= 30 THEN 'EXPIRING_SOON' ELSE 'VALID' END"


@query(f"{_SUBJECTS} SELECT doc_id, {_EXPIRY} AS label, CASE {_EXPIRY} WHEN 'VALID' THEN 'PASS' WHEN 'EXPIRED' THEN 'FAIL' ELSE 'REVIEW' END AS outcome, expiry_date - DATE '{S.AS_OF}' AS days_remaining FROM subjects")
def subject_expiry_status(spark, d):
    c = checks.expiry_check(RULES, _as_of())
    return S.subjects(spark, d).select("doc_id", c["label"].alias("label"), c["outcome"].alias("outcome"), F.datediff("expiry_date", _as_of()).alias("days_remaining"))


def _list_sql(mode: str) -> str:
    bad = {"ALL_APPROVED": "false", "BLOCKLIST": "(e.code IS NOT NULL AND NOT e.approved)", "ALLOWLIST": "NOT (e.code IS NOT NULL AND e.approved)"}[mode]
    return f"SELECT doc_id, '{mode}' AS list_mode, CASE WHEN nationality IS NULL THEN 'REVIEW' WHEN {bad} THEN 'FAIL' ELSE 'PASS' END AS outcome, CASE WHEN nationality IS NULL THEN 'UNREADABLE' WHEN {bad} THEN 'NOT_APPROVED' ELSE 'APPROVED' END AS label FROM subjects LEFT JOIN entries e ON e.code = nationality"


@query(_SUBJECTS + " UNION ALL ".join(_list_sql(m) for m in ("ALL_APPROVED", "BLOCKLIST", "ALLOWLIST")))
def subject_list_check(spark, d):
    rows = lookups.by_code(S.subjects(spark, d), S.entries(spark, d), "nationality")
    modes = {m: checks.list_check(Rules(list_mode=m)) for m in ("ALL_APPROVED", "BLOCKLIST", "ALLOWLIST")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("list_mode"), c["outcome"].alias("outcome"), c["label"].alias("label")) for m, c in modes.items())))
    return rows.select("doc_id", each.alias("x")).select("doc_id", "x.*")


_NAME = "lower(employer_name)"
_TYPE = f"(CASE WHEN {_NAME} LIKE '%ministry%' THEN 'GOVERNMENT' WHEN regexp_matches({_NAME}, '(^|\\s)(company|ltd|llc|group)(\\s|$|\\.)') THEN 'COMPANY' WHEN {_NAME} LIKE '%contracting%' THEN 'COMPANY' WHEN regexp_matches({_NAME}, '^\\S+ \\S+ \\S+( \\S+)?$') THEN 'INDIVIDUAL' END)"
_BYNAME = f"(CASE WHEN {_NAME} LIKE '%ministry%' THEN 0.95 WHEN regexp_matches({_NAME}, '(^|\\s)(company|ltd|llc|group)(\\s|$|\\.)') THEN 0.9 WHEN {_NAME} LIKE '%contracting%' THEN 0.75 WHEN regexp_matches({_NAME}, '^\\S+ \\S+ \\S+( \\S+)?$') THEN 0.6 END)"
_PREFIX = "(CASE substr(employer_id, 1, 1) WHEN '1' THEN 'INDIVIDUAL' WHEN '2' THEN 'INDIVIDUAL' WHEN '7' THEN 'COMPANY' END)"
_CLASS = f"SELECT *, coalesce({_PREFIX}, {_TYPE}, 'UNKNOWN') AS etype, cast(CASE WHEN {_PREFIX} IS NOT NULL THEN CASE WHEN {_TYPE} IS NOT NULL AND {_TYPE} <> {_PREFIX} AND NOT ({_PREFIX} = 'COMPANY' AND {_TYPE} = 'GOVERNMENT') THEN 0.69 ELSE 0.99 END ELSE coalesce({_BYNAME}, 0) END AS double) AS econf FROM subjects"
_EMPLOYER = f"SELECT *, CASE WHEN etype = 'INDIVIDUAL' AND round(least(econf, employer_id_conf), 2) >= 0.85 THEN 'FAIL' WHEN etype IN ('COMPANY', 'GOVERNMENT') THEN 'PASS' ELSE 'REVIEW' END AS e_outcome, round(least(econf, employer_id_conf), 2) AS e_conf FROM ({_CLASS}) k"


@query(f"{_SUBJECTS} SELECT doc_id, etype AS label, e_outcome AS outcome, e_conf AS confidence FROM ({_EMPLOYER}) e")
def subject_employer_class(spark, d):
    rows = checks.with_employer_class(S.subjects(spark, d).withColumn("ref_type", F.lit(None).cast("string")), RULES)
    c = checks.employer_check(RULES)
    return rows.select("doc_id", c["label"].alias("label"), c["outcome"].alias("outcome"), c["confidence"].alias("confidence"))


@query(f"{_SUBJECTS}, named AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN replace(occupation, ' ', '-') ELSE occupation END AS asked FROM subjects) SELECT doc_id, coalesce(x.name_en, a.name_en) AS matched, CASE WHEN x.name_en IS NOT NULL THEN 'exact' WHEN a.name_en IS NOT NULL THEN 'alias' END AS method FROM named LEFT JOIN occupations x ON x.name_en = asked LEFT JOIN occupations a ON a.aliases = asked")
def subject_occupation_exact_alias(spark, d):
    rows = S.subjects(spark, d).withColumn("asked", F.when(F.col("doc_id") % 3 == 0, F.replace("occupation", F.lit(" "), F.lit("-"))).otherwise(F.col("occupation")))
    out = lookups.occupation_match(rows, S.occupations(spark, d), 2.0, "asked")
    return out.select("doc_id", F.col("match.name_en").alias("matched"), F.col("match.method").alias("method"))


_ASKED = f"{_SUBJECTS}, named AS (SELECT doc_id, substr(occupation, 1, length(occupation) - 1) AS asked FROM subjects), keys AS (SELECT name_en AS k, 0 AS rank, * FROM occupations UNION ALL SELECT aliases, 1, * FROM occupations UNION ALL SELECT name_ar, 0, * FROM occupations), asked AS (SELECT DISTINCT asked AS a FROM named WHERE asked IS NOT NULL), met AS (SELECT a, k AS b FROM asked, (SELECT DISTINCT k FROM keys) x)"
_FUZZY = "best AS (SELECT a, name_en, round(s / 100, 3) AS score FROM (SELECT t.a, t.s, y.name_en, row_number() OVER (PARTITION BY t.a ORDER BY t.s DESC, y.rank, y.file_pos) AS n FROM token_set t JOIN keys y ON y.k = t.b WHERE t.s >= 88) z WHERE n = 1)"


@query(M.token_set_sql(_ASKED, "met", f"{_FUZZY} SELECT doc_id, asked, name_en AS matched, CASE WHEN name_en IS NOT NULL THEN 'fuzzy' END AS method, score FROM named LEFT JOIN best ON best.a = asked"))
def subject_occupation_fuzzy(spark, d):
    """Shortened names against the list."""
    rows = S.subjects(spark, d).withColumn("asked", F.expr("substr(occupation, 1, length(occupation) - 1)"))
    out = lookups.occupation_match(rows, S.occupations(spark, d), RULES.fuzzy_threshold, "asked")
    return out.select("doc_id", "asked", F.col("match.name_en").alias("matched"), F.col("match.method").alias("method"), F.col("match.score").alias("score"))


def _decided(spark, d, rules: Rules = RULES) -> DataFrame:
    rows = lookups.by_code(S.subjects(spark, d), S.entries(spark, d), "nationality").withColumn("ref_type", F.lit(None).cast("string"))
    rows = lookups.occupation_match(rows, S.occupations(spark, d), rules.fuzzy_threshold)
    return checks.decided(checks.checked(rows, rules, _as_of()), rules)


_OCC = "CASE WHEN occupation IS NULL THEN 'UNREADABLE' WHEN o.name_en IS NULL THEN 'UNKNOWN' WHEN NOT o.eligible THEN 'EXCLUDED' ELSE 'ELIGIBLE' END"
_JOINED = f"""SELECT s.*, {_EXPIRY} AS x_label, CASE WHEN doc_type = 'NATIONAL_ID' THEN 'NOT_APPLICABLE' ELSE etype END AS e_label, CASE WHEN doc_type = 'NATIONAL_ID' THEN 'NOT_APPLICABLE' ELSE {_OCC} END AS o_label, o.name_ar AS o_name, o.name_en AS o_en,
  CASE WHEN o.name_en IS NULL THEN 0 ELSE greatest(least(1, occupation_conf), 0.8) END AS o_conf
 FROM ({_EMPLOYER}) s LEFT JOIN occupations o ON o.name_en = s.occupation"""
_FINAL = f"""SELECT *,
  CASE WHEN doc_type = 'NATIONAL_ID' THEN 'PASS' WHEN e_outcome = 'FAIL' AND o_label = 'ELIGIBLE' THEN 'REVIEW' ELSE e_outcome END AS e_out,
  CASE WHEN x_label = 'EXPIRED' THEN concat('Expired (', strftime(expiry_date, '%Y-%m-%d'), ', ', expiry_date - DATE '{S.AS_OF}', ' days)') END AS x_fail,
  CASE WHEN x_label = 'DATE_NOT_READABLE' THEN 'EXPIRY: Expiry date unreadable' WHEN x_label = 'EXPIRING_SOON' THEN concat('EXPIRY: Expiring soon: ', expiry_date - DATE '{S.AS_OF}', ' days remaining (', strftime(expiry_date, '%Y-%m-%d'), ')') END AS x_rev,
  CASE WHEN nationality IS NULL THEN 'NATIONALITY: Nationality unreadable or not recognised' END AS n_rev,
  CASE WHEN o_label = 'UNREADABLE' THEN 'OCCUPATION: Occupation unreadable' WHEN o_label = 'UNKNOWN' THEN concat('OCCUPATION: Occupation not in reference list: ', occupation) END AS o_rev,
  CASE WHEN o_label = 'EXCLUDED' THEN concat('Excluded occupation: ', o_en, ' (', o_name, ')') END AS o_fail
 FROM ({_JOINED}) j"""
_LOW = "CASE WHEN {c} AND iqama_no_conf < 0.75 THEN concat('LOW_CONFIDENCE:{f} (', printf('%.2f', iqama_no_conf), ')') END"
_FIELD = lambda f, full: f"CASE WHEN {'doc_type <> ' + chr(39) + 'NATIONAL_ID' + chr(39) if full else 'true'} AND {f} IS NULL THEN 'MISSING_FIELD:{f}' ELSE {_LOW.format(c=('doc_type <> ' + chr(39) + 'NATIONAL_ID' + chr(39)) if full else 'true', f=f)} END"
_G0 = ", ".join([_FIELD("iqama_no", False), _FIELD("expiry_date", False), _FIELD("nationality", True), _FIELD("occupation", True), _FIELD("employer_id", True), f"CASE WHEN layout = 'old' THEN 'OLD_LAYOUT: {RULES.old_layout_note}' END"])
_E_REV = "CASE WHEN e_out = 'REVIEW' AND e_outcome = 'FAIL' THEN concat('EMPLOYER: Individual employer with eligible occupation (', o_name, ') - human decision') WHEN e_out = 'REVIEW' AND etype = 'INDIVIDUAL' THEN concat('EMPLOYER: Possible individual employer (confidence ', printf('%.2f', e_conf), ')') WHEN e_out = 'REVIEW' THEN 'EMPLOYER: Employer classification unknown' END"
_HARD = "(CASE WHEN x_fail IS NOT NULL AND expiry_date_conf >= 0.75 THEN x_fail END), (CASE WHEN e_out = 'FAIL' THEN 'Individual employer' END), (CASE WHEN o_fail IS NOT NULL AND o_conf >= 0.85 THEN o_fail END)"
_SOFT = lambda w: f"(CASE WHEN x_fail IS NOT NULL AND expiry_date_conf < 0.75 THEN concat('EXPIRY: ', x_fail, ' ({w} ', printf('%.2f', expiry_date_conf), ')') END), (CASE WHEN o_fail IS NOT NULL AND o_conf < 0.85 THEN concat('OCCUPATION: ', o_fail, ' ({w} ', printf('%.2f', o_conf), ')') END)"
_DECISION = f"""SELECT *, CASE WHEN quality < 0.45 THEN 'MANUAL_REVIEW' WHEN hard <> '' THEN 'REJECTED' ELSE 'MANUAL_REVIEW' END AS status,
  CASE WHEN quality < 0.45 THEN 'NEEDS_ATTENTION' WHEN hard <> '' THEN NULL WHEN open <> '' THEN 'NEEDS_ATTENTION' ELSE 'RECOMMEND_APPROVE' END AS recommendation,
  CASE WHEN quality < 0.45 THEN '' ELSE hard END AS reasons,
  CASE WHEN quality < 0.45 THEN concat('POOR_IMAGE (quality ', printf('%.2f', quality), ' < 0.45)') WHEN hard <> '' THEN unsure WHEN open <> '' THEN open ELSE 'ALL_CHECKS_PASSED_AWAITING_HUMAN_APPROVAL' END AS triggers
 FROM (SELECT *, concat_ws('; ', {_HARD}) AS hard, concat_ws('; ', {_G0}, {_SOFT('unconfirmed, confidence')}) AS unsure, concat_ws('; ', {_G0}, n_rev, x_rev, {_E_REV}, o_rev, {_SOFT('low confidence')}) AS open FROM ({_FINAL}) f) g"""


@query(f"{_SUBJECTS} SELECT doc_id, status, recommendation, reasons, triggers FROM ({_DECISION}) d")
def subject_decision(spark, d):
    return _decided(spark, d).select("doc_id", "decision.status", "decision.recommendation", F.array_join("decision.reasons", "; ").alias("reasons"), F.array_join("decision.triggers", "; ").alias("triggers"))


def _report_rows(spark, d) -> DataFrame:
    label = lambda k: F.col(f"check_{k}.label")
    return _decided(spark, d).select("doc_id", "batch_id", F.col("decision.status").alias("status"), label("EXPIRY").alias("expiry_label"), label("EMPLOYER").alias("employer_label"), label("OCCUPATION").alias("occupation_label"), label("NATIONALITY").alias("nationality_label"), F.lit(None).cast("string").alias("error"))


@query(f"{_SUBJECTS} SELECT batch_id, count(*) AS total, count_if(status = 'APPROVED') AS approved, count_if(status = 'REJECTED') AS rejected, count_if(status = 'MANUAL_REVIEW') AS manual_review, count_if(x_label = 'EXPIRED') AS expired, count_if(e_label = 'INDIVIDUAL') AS individual_employer, count_if(o_label = 'EXCLUDED') AS excluded_occupation, 0 AS nationality_not_approved, 0 AS errors FROM ({_DECISION}) d GROUP BY batch_id")
def batch_summary(spark, d):
    return report.batch_summary(_report_rows(spark, d))


@query(f"{_SUBJECTS} SELECT doc_id, round(min(c), 2) AS conf_min, round(avg(c), 2) AS conf_avg FROM (SELECT doc_id, unnest([iqama_no_conf, expiry_date_conf / 3]) AS c FROM subjects) x GROUP BY doc_id")
def batch_conf_stats(spark, d):
    pairs = F.array(F.struct(F.lit("iqama_no").alias("field"), F.col("iqama_no_conf").alias("confidence")), F.struct(F.lit("expiry_date").alias("field"), (F.col("expiry_date_conf") / 3).alias("confidence")), F.struct(F.lit("name_en").alias("field"), F.lit(0.01).alias("confidence")))
    rows = S.subjects(spark, d).select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*")
    return report.confidence_stats(rows, RULES.critical_fields)


@query(f"{_SUBJECTS} SELECT doc_id, batch_id FROM ({_DECISION}) d WHERE status = 'MANUAL_REVIEW' AND doc_id % 3 <> 0")
def review_queue(spark, d):
    rows = _decided(spark, d).select("doc_id", "batch_id", F.col("decision.status").alias("status"))
    first = rows.select("doc_id", "status", F.lit(1).alias("version"), F.lit(False).alias("is_final"))
    second = first.where("doc_id % 3 = 0").select("doc_id", F.lit("APPROVED").alias("status"), F.lit(2).alias("version"), F.lit(True).alias("is_final"))
    return history.queue(rows.select("doc_id", "batch_id"), first.unionByName(second))


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) x WHERE k = 1")
def decision_history_current(spark, d):
    rows = _table(spark, d, "conversations").withColumn("v", F.struct("turn", "role", "text"))
    return history.current(rows, "conv_id", version="v").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents")
def duplicate_documents(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return ingest.duplicates(docs).select("doc_id", "sha256", "duplicate_of")


# RE2 has no look-around: a match takes the character behind it, so the second pass masks identifiers one character apart
_MASK = "regexp_replace({t}, '(^|[^0-9٠-٩])([0-9٠-٩]{{4}})[0-9٠-٩]{{6}}([^0-9٠-٩]|$)', '\\1\\2******\\3', 'g')"


@query(f"SELECT doc_id, {_MASK.format(t=_MASK.format(t='t'))} AS masked, concat(substr(cast(1000000 + doc_id AS varchar), 1, 4), repeat('*', length(cast(1000000 + doc_id AS varchar)) - 4)) AS id FROM (SELECT doc_id, concat('id ', cast(2000000000 + doc_id AS varchar), ' and ', cast(20000000000 + doc_id AS varchar), ': ', coalesce(text, '')) AS t FROM documents) x")
def pii_mask_documents(spark, d):
    key = F.col("doc_id")
    t = F.concat(F.lit("id "), (key + 2000000000).cast("string"), F.lit(" and "), (key + 20000000000).cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    return _table(spark, d, "documents").select("doc_id", text.mask_identifiers(t).alias("masked"), text.mask_id((key + 1000000).cast("string")).alias("id"))


@query("SELECT doc_id, translate(translate(cast(n_chars AS varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩'), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS digits, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = lower(trim(coalesce(text, ''))) AS already FROM documents")
def digit_normalize(spark, d):
    arabic = F.translate(F.col("n_chars").cast("string"), "0123456789", text.ARABIC_DIGITS)
    c = F.coalesce("text", F.lit(""))
    return _table(spark, d, "documents").select("doc_id", text.normalize_digits(arabic).alias("digits"), (F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) == F.lower(F.trim(c))).alias("already"))


@query(f"{_SUBJECTS} SELECT doc_id, doc_id % 7 <> 0 AS ok FROM subjects")
def luhn_check_ids(spark, d):
    return S.subjects(spark, d).select("doc_id", numbers.luhn_ok(F.col("iqama_no")).alias("ok"))


@query("SELECT o_orderkey, cast(o_orderdate AS date) AS found FROM orders")
def date_parse_variants(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format(day, "yyyy/MM/dd")).when(k == 1, F.date_format(day, "d-M-yyyy")).when(k == 2, F.concat(F.lit("valid to "), F.date_format(day, "yyyy.M.d"))).otherwise(F.translate(F.date_format(day, "yyyy/MM/dd"), "0123456789", text.ARABIC_DIGITS))
    return dates.parse_date(_table(spark, d, "orders").select("o_orderkey", t.alias("t")), "t", "found").select("o_orderkey", "found")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m8%d') ELSE strftime(o_orderdate, '%d %m %Y') END AS t, cast(o_orderdate AS date) AS found, CASE o_orderkey % 3 WHEN 2 THEN 0.6 ELSE 0.7 END::double AS multiplier, CASE o_orderkey % 3 WHEN 0 THEN '8digits_natural' WHEN 1 THEN 'sep_repair_natural' ELSE 'rejoined_natural' END AS note FROM orders")
def date_resolve(spark, d):
    """Dates without separators or with misread ones."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "yyyyMM'8'dd")).otherwise(F.date_format(day, "dd MM yyyy"))
    out = dates.resolve_date(_table(spark, d, "orders").select("o_orderkey", t.alias("t")), "t", "r")
    return out.select("o_orderkey", "t", F.col("r.date").alias("found"), F.col("r.multiplier").alias("multiplier"), F.col("r.note").alias("note"))


# The first days of the years 1412 to 1422 and, of each year's months in order, which have 30 days (1).
_YEARS = [(1412, "1991-07-13", "101010111001"), (1413, "1992-07-02", "010010111010"), (1414, "1993-06-21", "101001011011"), (1415, "1994-06-11", "010100101011"), (1416, "1995-05-31", "101010010101"), (1417, "1996-05-19", "101100101010"), (1418, "1997-05-08", "101101010101"), (1419, "1998-04-28", "010101011100"), (1420, "1999-04-17", "010010111101"), (1421, "2000-04-06", "001000111101"), (1422, "2001-03-26", "100100011101")]
_MONTHS = f"months AS (SELECT y, m, cast(day AS date) + cast((m - 1) * 29 + length(replace(substr(bits, 1, m - 1), '0', '')) AS int) AS first, 29 + cast(substr(bits, m, 1) AS int) AS days FROM (VALUES {', '.join(f'({y}, {day!r}, {bits!r})' for y, day, bits in _YEARS)}) v(y, day, bits), (SELECT unnest(range(1, 13)) AS m) u)"
_LUNAR = "concat(lpad(cast(cast(o_orderdate AS date) - first + 1 AS varchar), 2, '0'), '/', lpad(cast(m AS varchar), 2, '0'), '/', cast(y AS varchar))"


@query(f"WITH {_MONTHS} SELECT o_orderkey, cast(o_orderdate AS date) AS day, {_LUNAR} AS hijri, cast(o_orderdate AS date) AS back FROM orders JOIN months ON cast(o_orderdate AS date) >= first AND cast(o_orderdate AS date) < first + cast(days AS int)")
def hijri_round_trip(spark, d):
    """Order dates to the Hijri calendar and back."""
    rows = dates.gregorian_to_hijri(_table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", "hijri")
    return dates.parse_date(rows, "hijri", "back").select("o_orderkey", "day", "hijri", "back")


def _luhn_sql(s: str) -> str:
    """Whether a text of ten digits passes: places 0, 2, ... doubled."""
    one = [f"cast(substr({s}, {i + 1}, 1) AS int)" for i in range(10)]
    return "((" + " + ".join(f"(CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)" if i % 2 == 0 else x for i, x in enumerate(one)) + ") % 10 = 0)"


# Printed behind "no", whose o is read as a zero, or in two chunks of five.
_TURNED = "concat(substr(iqama_no, 6, 5), substr(iqama_no, 1, 5))"
_SCORES = f"SELECT doc_id, iqama_no AS c, {_TURNED} AS r, {_luhn_sql('iqama_no')} AS ok, {_luhn_sql(_TURNED)} AS r_ok, 2 + CASE WHEN {_luhn_sql('iqama_no')} THEN 1 ELSE 0 END AS s, CASE WHEN starts_with({_TURNED}, '2') THEN 2 ELSE 0 END + CASE WHEN {_luhn_sql(_TURNED)} THEN 1 ELSE 0 END AS rs FROM subjects"
_BEHIND = "doc_id % 2 = 0"


@query(f"""{_SUBJECTS}, scored AS ({_SCORES}) SELECT doc_id,
  CASE WHEN {_BEHIND} THEN CASE WHEN ok THEN c ELSE concat('0', c) END WHEN rs >= s THEN r ELSE c END AS number,
  CASE WHEN {_BEHIND} THEN CASE WHEN ok THEN 1.0 ELSE 0.5 END WHEN least(s, rs) >= 2 THEN 0.75 WHEN greatest(s, rs) >= 3 THEN 1.0 ELSE 0.9 END::double AS multiplier,
  CASE WHEN {_BEHIND} THEN CASE WHEN ok THEN 'exact_chunk(luhn=True)' ELSE 'length_11' END WHEN least(s, rs) >= 2 THEN concat('ambiguous_order(', CASE WHEN rs >= s THEN 'reversed' ELSE 'natural' END, ')')
    WHEN rs >= s THEN concat('reversed(luhn=', CASE WHEN r_ok THEN 'True' ELSE 'False' END, ')') ELSE concat('natural(luhn=', CASE WHEN ok THEN 'True' ELSE 'False' END, ')') END AS note
FROM scored""")
def ten_digit_resolve(spark, d):
    """Every subject's number, wrong check digits included, printed behind a word or in two chunks."""
    c = F.col("iqama_no")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("no "), c)).otherwise(F.concat(F.substring(c, 1, 5), F.lit(" "), F.substring(c, 6, 5)))
    return S.subjects(spark, d).select("doc_id", numbers.resolve_ten_digits(t, "2").alias("r")).select("doc_id", "r.number", "r.multiplier", "r.note")


@query(f"{_SUBJECTS} SELECT doc_id, status FROM ({_DECISION}) d WHERE contains(lower(concat(triggers, ' ', reasons)), 'unreadable')")
def doc_filter_search(spark, d):
    rows = _decided(spark, d).select("doc_id", "decision.version", "decision.status", "decision.triggers", "decision.reasons")
    rows = history.current(rows, "doc_id")  # filters stay above the aggregate, and the gates are evaluated once
    return report.by_trigger(rows, "UNREADABLE").select("doc_id", "status")


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def top_batches(spark, d):
    return report.newest(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), 50, 500, "o_orderkey")


@query("SELECT event_id AS id, event_type AS action, cast(user_id AS varchar) AS actor FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_recent(spark, d):
    log = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), "ts")
    return audit.filtered(log, action="error", since=datetime.datetime(2024, 1, 3)).select("id", "action", "actor")


@query("SELECT event_type AS action, user_id % 10 AS actor, count(*) AS n, sum(value) > 0 AS some FROM events GROUP BY 1, 2")
def audit_actor_action_counts(spark, d):
    return _table(spark, d, "events").groupBy(F.col("event_type").alias("action"), (F.col("user_id") % 10).alias("actor")).agg(F.count("*").alias("n"), (F.sum("value") > 0).alias("some"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def retention_expired(spark, d):
    rows = _table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    return audit.expired(rows, F.lit("2024-01-20").cast("timestamp_ntz"), 7).select("event_id")


@query("SELECT lower(p_name) AS k, count(*) AS n, sum(p_size) AS size FROM (SELECT p_name, p_size FROM part WHERE p_name <> 'red widget' UNION ALL SELECT 'Red  Widget', 1) x GROUP BY 1")
def key_upsert(spark, d):
    new = spark.createDataFrame([("Red  Widget", 1)], "p_name string, p_size int")
    out = lookups.upsert(_table(spark, d, "part").select("p_name", "p_size"), new, "p_name")
    return out.groupBy(F.lower("p_name").alias("k")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT p_partkey, concat_ws('|', p_name, CASE WHEN p_name <> 'red widget' THEN 'red widget' END, CASE WHEN p_name <> 'blue bolt' THEN 'blue bolt' END) AS choices FROM part")
def option_union(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.array_join(lookups.options(F.col("p_name"), F.array(F.lit("red widget"), F.lit("blue bolt"))), "|").alias("choices"))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line FROM lineitem), c AS (SELECT *, line = max(line) OVER (PARTITION BY doc_id) AS label, lead(line) OVER (PARTITION BY doc_id ORDER BY line) - line >= 3 AS cut FROM b), e AS (SELECT *, bool_or(coalesce(cut, false)) OVER (PARTITION BY doc_id ORDER BY line DESC) AS gone FROM c) SELECT doc_id, count(*) AS n FROM e WHERE NOT label AND NOT gone GROUP BY doc_id")
def box_value_join(spark, d):
    """Lines of an order as boxes of a row; the rightmost is the label."""
    b = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 60).alias("x"), ((F.col("l_linenumber") % 2) * 4).alias("y"), F.lit(50).alias("w"), F.lit(20).alias("h"), F.lit("v").alias("text"), F.lit(0.9).alias("conf")).dropDuplicates(["doc_id", "line"])
    last = b.groupBy("doc_id").agg(F.max("line").alias("last"))
    own = b.join(last, "doc_id")
    out = extract.values_by_range(own.where("line = last").withColumn("field", F.lit("a")), own.where("line < last").drop("last"))
    return out.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))


@query("WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line, strftime(l_shipdate, '%d/%m/%Y') AS raw, l_linenumber * 10 AS y FROM lineitem), a AS (SELECT o_orderkey AS doc_id, 'birth_date' AS field, 0 AS pos, o_custkey % 50 AS ay FROM orders UNION ALL SELECT o_orderkey, 'expiry_date', 1, o_custkey % 50 + 25 FROM orders), p AS (SELECT f.doc_id, line, raw, field, pos, greatest(0, least(y, ay) + 20 - greatest(y, ay)) / cast(20 AS double) AS o FROM f JOIN a ON f.doc_id = a.doc_id) SELECT doc_id, line, raw, field FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line, raw ORDER BY o DESC, pos) AS n FROM p WHERE o >= 0.4) q WHERE n = 1")
def stray_date_join(spark, d):
    """Shipping dates as boxes of an order beside two date labels."""
    free = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 10).alias("y"), F.lit(20).alias("h"), F.lit(0.9).alias("conf"), F.concat(F.lit("x "), F.date_format("l_shipdate", "dd/MM/yyyy")).alias("text"))
    o, y = _table(spark, d, "orders"), (F.col("o_custkey") % 50).cast("int")
    both = [o.select(F.col("o_orderkey").alias("doc_id"), F.lit(f).alias("field"), F.lit(i).alias("pos"), (y + 25 * i).alias("y"), F.lit(20).alias("h")) for i, f in enumerate(("birth_date", "expiry_date"))]
    return labels.stray_dates(free, both[0].unionByName(both[1])).select("doc_id", "line", "raw", "field")


@query("WITH e AS (SELECT least(l_linenumber % 5, 3) + CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 0 END + l_partkey % 4 AS o, CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS n FROM lineitem) SELECT CASE WHEN o >= 3 AND o > n THEN 'old' WHEN n >= 2 AND n >= o THEN 'new' ELSE 'unknown' END AS layout, count(*) AS n FROM e GROUP BY 1")
def layout_evidence(spark, d):
    kind = labels.layout(F.col("l_linenumber") % 5, F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 4, F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 3 == 0, F.col("l_linenumber") % 2 == 0)
    return _table(spark, d, "lineitem").groupBy(kind.alias("layout")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN w < 600 THEN least(s, 0.4) ELSE s END, 3) AS score FROM (SELECT *, 0.55 * CASE WHEN w < 400 THEN 0 ELSE least(1, cast(w - 400 AS double) / 800) END + 0.25 * least(1, cast(sh AS double) / 150) + 0.1 * (1 - least(1, abs(br - 170) / cast(170 AS double))) + 0.1 * (1 - least(1, gl / 0.3)) AS s FROM (SELECT l_orderkey, l_linenumber, cast(300 + l_partkey % 1000 AS int) AS w, l_quantity * 3 AS sh, l_suppkey % 256 AS br, l_discount AS gl FROM lineitem) m) n")
def quality_score(spark, d):
    s = numbers.quality_score(F.col("w"), F.col("l_quantity") * 3, F.col("l_suppkey") % 256, F.col("l_discount"))
    return _table(spark, d, "lineitem").withColumn("w", (300 + F.col("l_partkey") % 1000).cast("int")).select("l_orderkey", "l_linenumber", s.alias("score"))


@query(f"{_SUBJECTS} SELECT doc_id, concat(substr(iqama_no, 1, 4), '******') AS iqama_no, x_label AS expiry_status, e_label AS employer_type, o_label AS occupation_status, status AS final_decision, triggers AS review_triggers, expiry_date - DATE '{S.AS_OF}' AS days_remaining FROM ({_DECISION}) d")
def export_rows(spark, d):
    out = report.export_rows(_decided(spark, d).withColumn("as_of", _as_of()))
    return out.select("doc_id", "iqama_no", "expiry_status", "employer_type", "occupation_status", "final_decision", "review_triggers", "days_remaining")


@query(f"{_SUBJECTS} SELECT doc_id, name_en AS name, nationality AS nationality_name, status FROM ({_DECISION}) d WHERE status IN ('REJECTED')")
def export_feed(spark, d):
    rows = _decided(spark, d).select("doc_id", "decision.version", "decision.status", "name_en", "name_ar", "nationality", "iqama_no", "occupation", F.lit("c").alias("company"))
    rows = history.current(rows, "doc_id")
    return report.export_feed(rows, S.entries(spark, d), ("REJECTED",)).select("doc_id", "name", "nationality_name", F.lit("REJECTED").alias("status"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, strlen(coalesce(html, '')) + CASE page_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 3 ELSE 0 END AS length FROM pages")
def mime_sniff(spark, d):
    k = F.col("page_id") % 4
    head = F.when(k == 0, F.lit(b"%PDF-")).when(k == 1, F.lit(b"\x89PNG\r\n\x1a\n")).when(k == 2, F.lit(b"\xff\xd8\xff")).otherwise(F.lit(b""))
    rows = _table(spark, d, "pages").select("page_id", F.concat(head, F.coalesce("html", F.lit("")).cast("binary")).alias("content"))
    return rows.select("page_id", ingest.mime(F.col("content")).alias("mime"), F.length("content").cast("long").alias("length"))


@query(f"{_SUBJECTS} SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN 'iqama_no: checksum failed (advisory)' END, CASE WHEN doc_type = 'NATIONAL_ID' THEN 'iqama_no: does not start with 1 for NATIONAL_ID' END, CASE WHEN year(expiry_date) NOT BETWEEN 2000 AND 2100 THEN 'expiry_date out of plausible range' END, CASE WHEN expiry_date IS NULL THEN 'missing critical field: expiry_date' END, CASE WHEN nationality IS NULL AND doc_type <> 'NATIONAL_ID' THEN 'missing critical field: nationality' END, CASE WHEN occupation IS NULL AND doc_type <> 'NATIONAL_ID' THEN 'missing critical field: occupation' END) AS warnings FROM subjects")
def subject_validation(spark, d):
    return checks.validated(S.subjects(spark, d), RULES, _as_of()).select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


_PAD = lambda x: "'" + "".join(f"\\x{(k if k < 32 else 0) ^ x:02X}" for k in range(32)) + f"\\x{x:02X}" * 32 + "'::blob"


@query(f"{_SUBJECTS} SELECT doc_id, sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(iqama_no)))) AS hash, true AS round_trip FROM subjects")
def keyed_hashes(spark, d):
    """Identifiers as keyed hashes, and encrypted and decrypted again."""
    key = bytes(range(32))
    c = F.col("iqama_no")
    return S.subjects(spark, d).select("doc_id", crypto.keyed_hash(c, key).alias("hash"), (crypto.decrypt(crypto.encrypt(c, key), key) == c).alias("round_trip"))


_TWO = "(VALUES ('Supplier 1 Company', 0), ('Supplier#000000007 Contracting', 1)) w(name, p)"
_COMPANY = "rated AS (SELECT e.a AS emp, w.name, row_number() OVER (PARTITION BY e.a ORDER BY greatest(t.s, p.s) DESC, w.p) AS n FROM emps e JOIN " + _TWO + " ON true JOIN token_set t ON t.a = e.a AND t.b = lower(w.name) JOIN partial p ON p.a = e.a AND p.b = lower(w.name) WHERE greatest(t.s, p.s) / 100 >= 0.85)"


@query(M.measures_sql(f"{_SUBJECTS}, emps AS (SELECT DISTINCT lower(employer_name) AS a FROM subjects), met AS (SELECT a, lower(name) AS b FROM emps, {_TWO})", "met", f"{_COMPANY} SELECT doc_id, CASE WHEN doc_type = 'NATIONAL_ID' THEN 'Supplier 1 Company' ELSE coalesce(r.name, employer_name) END AS company, CASE WHEN doc_type = 'NATIONAL_ID' THEN 'NATIONAL_ID' WHEN r.name IS NOT NULL THEN 'AUTO' ELSE 'CARD' END AS company_source, doc_type <> 'NATIONAL_ID' AND r.name IS NULL AS needs_choice FROM subjects LEFT JOIN rated r ON r.emp = lower(employer_name) AND r.n = 1"))
def company_resolution(spark, d):
    """The card's employer against two requesting companies of each batch."""
    rows = S.subjects(spark, d).select("doc_id", "doc_type", "batch_id", "employer_name")
    few = rows.select("doc_type", "employer_name").distinct().withColumn("companies", F.array(F.lit("Supplier 1 Company"), F.lit("Supplier#000000007 Contracting")))
    return rows.join(lookups.company(few, RULES.company_threshold), ["doc_type", "employer_name"]).select("doc_id", "company", "company_source", "needs_choice")


@query(M.measures_sql("WITH names AS (SELECT DISTINCT p_name AS a FROM part), met AS (SELECT a, 'widget small blue' AS b FROM names)", "met", "last AS (SELECT 1) SELECT r.a AS p_name, round(r.s, 6) AS ratio, round(t.s, 6) AS token_set, round(p.s, 6) AS partial FROM ratios r JOIN met USING (a, b) JOIN token_set t USING (a, b) JOIN partial p USING (a, b)"))
def similarity_measures(spark, d):
    """The three measures between distinct part names and one word list."""
    names = _table(spark, d, "part").select("p_name").distinct()
    other = F.lit("widget small blue")
    c = F.col("p_name")
    return names.select("p_name", F.round(fuzzy.ratio(c, other), 6).alias("ratio"), F.round(fuzzy.token_set_ratio(c, other), 6).alias("token_set"), F.round(fuzzy.partial_ratio(c, other), 6).alias("partial"))


from docscreen import catalogue_operators  # noqa: E402, F401  (registers the operators' own queries)
