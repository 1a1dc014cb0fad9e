"""Operator 9, URL filters: rules judge urls, and redirect equivalence carries block decisions to aliases.

Native: DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins
(of equal length: allow). Some rules are unrolled into one expression; where they are more than UNROLLED, each url's host
and its parents are joined to the rules' hosts, which carry their paths. Pages that a
``<link rel=canonical>`` or a ``<meta http-equiv=refresh>`` of theirs joins to another url are its aliases; connected
components over these edges are classes of equal content. A url without a rule is blocked if some member of its class is
blocked by a rule and none is allowed by one: explicit allows take precedence, on the url itself and in its class.

All tags of a page count, those without a target aside. A url's node is the url without its fragment. Relative targets are resolved against scheme and host; those relative to
a folder against the url's folder.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule and no class, and are allowed; null
html has no links; repeated rows are judged alike; a page that names itself has no edge; scheme and host of a node are
compared in lower case; an empty table gives an empty table; pages of any length are read whole; further columns are left
out, whatever their names.
"""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import common

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UNROLLED = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<link\b[^>]*\brel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b)[^>]*>"
_META = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_URL = r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_PARTS = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*(?:;|(?![=;a-zA-Z0-9]))|&|[^&]+"
#: HTML's names, and its numbers that stand for windows-1252.
_NAMES = json.dumps(html5 | {f"#{n}": html.unescape(f"&#{n};") for n in range(0x80, 0xA0)})


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (key, host, path) with rule, that which wins, and own, its verdict, or nulls; key tells rows apart."""
    if len(rules) <= UNROLLED:
        rule = verdict = F.lit(None).cast("string")
        for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
            fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
            rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
        return rows.withColumns({"rule": rule, "own": verdict})
    table = rows.sparkSession.createDataFrame(rules, "kind string, of string, p string")
    table = table.groupBy("of").agg(F.collect_set(F.struct("kind", "p")).alias("paths"))
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().withColumn("of", F.explode(parents)).join(table, "of").groupBy("host").agg(F.collect_list(F.struct("of", "paths")).alias("found"))
    # of a host all rules of it and its parents; the longest whose path fits, an allow before a block
    each = F.flatten(F.transform("found", lambda x: F.transform(x["paths"], lambda y: F.struct(F.length(F.concat(x["of"], y["p"])).alias("n"), (y["kind"] == "allow").alias("allow"), F.concat(x["of"], y["p"]).alias("rule"), y["kind"].alias("kind"), y["p"].alias("p")))))
    best = F.array_max(F.filter(F.col("each"), lambda x: F.startswith(F.col("path"), x["p"])))
    both = rows.join(hosts.select(F.col("host").alias("__host"), each.alias("each")), F.col("host") == F.col("__host"), "left").withColumn("best", best)
    return both.withColumns({"rule": F.col("best.rule"), "own": F.col("best.kind")}).drop("__host", "each", "best")


def node(url: Column) -> Column:
    """A url's node: without its fragment, scheme and host in lower case, dot segments of its path resolved."""
    at = F.locate("://", url)
    whole = F.substring_index(url, "#", 1)
    head = F.translate(F.regexp_extract(whole, r"^([^:]*://[^/?]*)", 1), _UPPER, _LOWER)
    rest = F.substr(whole, F.length(head) + 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(.*)$", 1)
    parts = F.split(path, "/")
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", up(out)).when(x == ".", out).otherwise(F.array_append(out, x)))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
    dots = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(walked, "/"), tail)).otherwise(path)
    return F.when(at > 0, F.concat(head, dots, query))


def unescaped(c: Column) -> Column:
    """An attribute's value with its character references resolved as HTML does: a name without a semicolon stays as it
    is before a letter, a digit or an equals sign."""
    return _resolved(c, F.from_json(F.lit(_NAMES), "map<string, string>"))


def _resolved(c: Column, names: Column) -> Column:
    """The same, with the names as a column."""
    code = lambda x: F.coalesce(F.when(x.rlike("^&#[0-9]"), F.regexp_extract(x, "([0-9]+)", 1).try_cast("long")).otherwise(F.conv(F.regexp_extract(x, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1), 16, 10).try_cast("long")), F.lit(-1))
    valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
    numbered = lambda x: F.coalesce(F.element_at(names, F.concat(F.lit("#"), code(x).cast("string"))), char(code(x)))
    one = lambda x: F.when(x.rlike("^&#."), numbered(x)).when(x.rlike("^&."), F.coalesce(F.element_at(names, F.substring(x, 2, 40)), x)).otherwise(x)
    return F.when(F.locate("&", c) > 0, F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PARTS), F.lit(0)), one), "")).otherwise(c)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and each node that a canonical link or redirect of it names."""
    every = lambda tag, value: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))
    tags = pages.select("url", F.explode(F.concat(every(_LINK, _HREF), every(_META, _URL))).alias("raw")).where("raw <> ''")
    # names come as a row of a small table: in expressions each use of them would repeat all 2,000 in every plan that the
    # driver keeps; explode keeps one expression from being put into the next as often as that names it
    names = pages.sparkSession.createDataFrame([(json.loads(_NAMES),)], "names map<string, string>")
    tags = tags.join(F.broadcast(names), F.locate("&", "raw") > 0, "left")
    # a url in escaped quotes ends with them
    plain = F.trim(F.regexp_replace(_resolved(F.col("raw"), F.col("names")), r"""^(["'])(.*?)(?:\1.*)?$""", "$2"))
    tags = tags.select("url", F.explode(F.array(plain)).alias("to")).where("to <> ''")
    to = F.col("to")
    scheme, site = F.regexp_extract("url", r"^([^:]*:)//", 1), F.regexp_extract("url", r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/")), r"^([^:]*://[^/]*(?:/.*(?=/[^/]*/$))?)", 1)
    full = F.when(F.locate("://", to) > 0, to).when(to.startswith("//"), F.concat(scheme, to)).when(to.startswith("/"), F.concat(site, to)).otherwise(F.concat(folder, F.lit("/"), to))
    return tags.select("url", F.explode(F.array(full)).alias("full")).select(node(F.col("url")).alias("a"), node(F.col("full")).alias("b")).where("a <> b")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    classes = common.components(alias_edges(pages))
    h, p = host_and_path(F.col("node"))
    marks = ruled(classes.select("node", "component", h.alias("host"), p.alias("path")), rules)
    marks = marks.groupBy("component").agg(F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("blocked"), F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allowed"))
    bad = classes.join(marks.where("blocked = 1 and allowed = 0"), "component").select("node", F.lit("block").alias("by_class"))
    host, path = host_and_path(F.col("url"))
    rows = ruled(pages.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("__node")), rules)
    out = rows.join(bad, F.col("__node") == bad["node"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "by_class", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql_rules(host: str, path: str, value: int) -> str:
    out = "null"
    for r in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        what = r[0] if value else r[1] + r[2]
        out = f"CASE WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') THEN '{what}' ELSE {out} END"
    return out


_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"

#: Absolute and unescaped targets of a page's first tags alone; the test tables have no links at all.
ORACLE_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS t FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM pages),
one AS (SELECT split_part(url, '#', 1) AS a, split_part(t, '#', 1) AS b FROM tags WHERE strpos(t, '://') > 0 AND strpos(url, '://') > 0),
edges AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
marked AS (SELECT a, {_sql_rules(_HOST.format(u='b'), _PATH.format(u='b'), 1)} AS v FROM reach),
bad AS (SELECT a FROM marked GROUP BY a HAVING bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false))),
p AS (SELECT page_id, split_part(url, '#', 1) AS n, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path FROM pages)
SELECT page_id, host, path, {_sql_rules('host', 'path', 0)} AS rule,
  coalesce({_sql_rules('host', 'path', 1)}, CASE WHEN n IN (SELECT a FROM bad) THEN 'block' END, 'allow') AS verdict
FROM p
"""
