"""The similarity measures in DuckDB's SQL, for the oracle alone: longest common subsequences by recursion.

A query gives WITH clauses that end in a table of pairs (a, b); the texts here add lcs, ratios, token_set and partial,
each with (a, b, s), and then the query's own end.
"""

from __future__ import annotations


def _grid(pairs: str) -> str:
    return f"""pairs_ AS (SELECT DISTINCT a, b FROM ({pairs}) p_ WHERE a IS NOT NULL AND b IS NOT NULL),
grid_(a, b, i, r) AS (
  SELECT a, b, 0::bigint, list_transform(range(length(b) + 1), lambda x: 0::bigint) FROM pairs_
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: greatest(r[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: substr(b, k, 1) = substr(a, i + 1, 1)), lambda k: r[k] + 1)), 0))) FROM grid_ WHERE i < length(a)),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100 ELSE 200.0 * r[length(b) + 1] / (length(a) + length(b)) END::double AS s FROM grid_ WHERE i = length(a))"""


_SETS = """sets_ AS (SELECT a, b, trim(array_to_string(x, ' ')) AS s0, trim(concat_ws(' ', array_to_string(x, ' '), array_to_string(oa, ' '))) AS sa, trim(concat_ws(' ', array_to_string(x, ' '), array_to_string(ob, ' '))) AS sb, len(x) AS nx, len(oa) AS na, len(ob) AS nb, len(ta) AS ca, len(tb) AS cb
  FROM (SELECT *, list_sort(list_filter(ta, lambda t: list_contains(tb, t))) AS x, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS oa, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS ob
    FROM (SELECT a, b, list_distinct(list_filter(string_split_regex(a, '\\s+'), lambda t: t <> '')) AS ta, list_distinct(list_filter(string_split_regex(b, '\\s+'), lambda t: t <> '')) AS tb FROM (SELECT DISTINCT a, b FROM {met}) m_) t_) u_)"""
_SET_PAIRS = "SELECT s0 AS a, sa AS b FROM sets_ UNION ALL SELECT s0, sb FROM sets_ UNION ALL SELECT sa, sb FROM sets_"
_TOKEN_SET = """token_set AS (SELECT z.a, z.b, CASE WHEN ca = 0 OR cb = 0 THEN 0 WHEN nx > 0 AND (na = 0 OR nb = 0) THEN 100 ELSE greatest(q.s, CASE WHEN nx > 0 THEN greatest(p1.s, p2.s) ELSE 0 END) END::double AS s
  FROM sets_ z JOIN ratios q ON q.a = z.sa AND q.b = z.sb JOIN ratios p1 ON p1.a = z.s0 AND p1.b = z.sa JOIN ratios p2 ON p2.a = z.s0 AND p2.b = z.sb)"""
_STRETCHES = """stretches_ AS (SELECT a, b, short, substr(long, cast(greatest(i, 0) + 1 AS bigint), cast(least(i + length(short), length(long)) - greatest(i, 0) AS bigint)) AS part
  FROM (SELECT a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS short, CASE WHEN length(a) > length(b) THEN a ELSE b END AS long FROM {met}) m_, unnest(range(1 - length(short), length(long))) r_(i))"""
_PARTIAL = "partial AS (SELECT t.a, t.b, max(q.s) AS s FROM stretches_ t JOIN ratios q ON q.a = t.short AND q.b = t.part GROUP BY t.a, t.b)"


def _recursive(head: str) -> str:
    return head.replace("WITH ", "WITH RECURSIVE ", 1)


def ratio_sql(head: str, met: str, end: str) -> str:
    return f"{_recursive(head)}, {_grid(f'SELECT a, b FROM {met}')}, {end}"


def token_set_sql(head: str, met: str, end: str) -> str:
    return f"{_recursive(head)}, {_SETS.format(met=met)}, {_grid(_SET_PAIRS)}, {_TOKEN_SET}, {end}"


def measures_sql(head: str, met: str, end: str) -> str:
    """All three; a and b are no empty texts."""
    pairs = f"SELECT a, b FROM {met} UNION ALL {_SET_PAIRS} UNION ALL SELECT short, part FROM stretches_"
    return f"{_recursive(head)}, {_SETS.format(met=met)}, {_STRETCHES.format(met=met)}, {_grid(pairs)}, {_TOKEN_SET}, {_PARTIAL}, {end}"
