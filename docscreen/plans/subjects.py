"""Synthetic subjects over the fixed test tables, by one text for Spark and for the oracle.

The tables hold no cards; a subject is an order, and every field is derived from keys by whole-number arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-01"


def _check(s: str) -> str:
    """The check digit of nine digits: places 0, 2, ... doubled."""
    one = [f"cast(substr({s}, {i + 1}, 1) AS int)" for i in range(9)]
    twice = [f"(CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)" if i % 2 == 0 else x for i, x in enumerate(one)]
    return f"((10 - ({' + '.join(twice)}) % 10) % 10)"


def subjects_sql(text: str = "varchar", **tables: str) -> str:
    t = {k: k for k in ("orders", "customer", "nation", "supplier", "part")} | tables
    return f"""
SELECT doc_id, batch_id, concat(id9, cast((id_check + wrong) % 10 AS {text})) AS iqama_no, expiry_date, birth_date,
  nationality, occupation, occupation AS occupation_raw, concat(emp9, cast(emp_check AS {text})) AS employer_id, employer_name,
  quality, layout, doc_type, conf AS iqama_no_conf, conf AS expiry_date_conf, conf AS nationality_conf, conf AS occupation_conf,
  conf AS employer_id_conf, conf AS employer_name_conf, conf AS birth_date_conf, name_en, name_en AS name_ar, n_chars_key, created
FROM (SELECT *, {_check('id9')} AS id_check, {_check('emp9')} AS emp_check FROM (
  SELECT o.o_orderkey AS doc_id, o.o_custkey % 20 AS batch_id,
    concat('2', lpad(cast(o.o_custkey AS {text}), 8, '0')) AS id9, CASE WHEN o.o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS wrong,
    CASE WHEN o.o_orderkey % 17 <> 0 THEN cast(o.o_orderdate AS date) END AS expiry_date,
    cast('1960-01-01' AS date) AS birth_date,
    CASE WHEN o.o_orderkey % 23 <> 0 THEN n.n_name END AS nationality,
    CASE WHEN o.o_orderkey % 19 = 0 THEN NULL WHEN o.o_orderkey % 13 = 0 THEN 'qqq xx' ELSE p.p_name END AS occupation,
    concat(CASE s.s_suppkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '7' ELSE '9' END, lpad(cast(s.s_suppkey AS {text}), 8, '0')) AS emp9,
    concat(s.s_name, CASE s.s_suppkey % 5 WHEN 0 THEN ' Ministry' WHEN 1 THEN ' Company' WHEN 2 THEN ' Contracting' WHEN 3 THEN '' ELSE ' al one two' END) AS employer_name,
    cast((o.o_orderkey * 53) % 101 AS double) / 100 AS quality, cast(60 + (o.o_orderkey * 37) % 40 AS double) / 100 AS conf,
    CASE WHEN o.o_orderkey % 29 = 0 THEN 'old' ELSE 'new' END AS layout,
    CASE WHEN o.o_orderkey % 31 = 0 THEN 'NATIONAL_ID' ELSE 'IQAMA' END AS doc_type,
    c.c_name AS name_en, o.o_orderkey % 1000 AS n_chars_key, o.o_orderdate AS created
  FROM {t['orders']} o JOIN {t['customer']} c ON c.c_custkey = o.o_custkey JOIN {t['nation']} n ON n.n_nationkey = c.c_nationkey
    JOIN {t['supplier']} s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM {t['supplier']})
    JOIN {t['part']} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {t['part']})) z) y"""


#: The list that codes are checked against: 20 of 25 names, a third of them not approved.
ENTRIES = "SELECT n_name AS code, n_name AS name_en, n_name AS name_ar, '' AS aliases, n_nationkey % 3 <> 0 AS approved, n_nationkey AS file_pos FROM {nation} WHERE n_nationkey % 5 <> 4"
#: Occupations: three of four distinct part names, each with an alias; a fourth of them not eligible.
OCCUPATIONS = "SELECT concat('ar ', p_name) AS name_ar, p_name AS name_en, replace(p_name, ' ', '-') AS aliases, CAST('c' AS {text}) AS category, k % 4 <> 1 AS eligible, k AS file_pos FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) AS k FROM (SELECT DISTINCT p_name FROM {part}) a) b WHERE k % 4 <> 0"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in ("orders", "customer", "nation", "supplier", "part")}


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "customer", "nation", "supplier", "part")
    return spark.sql(subjects_sql("string", **{k: "{" + k + "}" for k in names}), **tables(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRIES, nation=tables(spark, sf_dir)["nation"])


def occupations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OCCUPATIONS.replace("{text}", "string"), part=tables(spark, sf_dir)["part"])
