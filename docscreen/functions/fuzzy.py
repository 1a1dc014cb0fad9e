"""String similarity from 0 to 100 as Column expressions, by the published definitions of the Indel measures.

As expressions they are folds over arrays, outside generated code, and large plans: for lambdas, where nothing else runs.
Where pairs are columns the measures of the same names with _of work on Arrow batches: small plans, and faster. Apply
either to distinct values that exact lookups have missed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.functions.numbers import bound


#: Characters of a text whose places one long holds as bits.
BITS = 62


def common_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence. The places of a are bits of one number that each character of b
    moves on; texts longer than that are folded over a row of lengths."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)

    def folded(e: Column) -> Column:
        places = lambda ch: F.aggregate(e["bits"], F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.when(p["y"] == ch, p["bit"]).otherwise(F.lit(0).cast("long"))))
        step = lambda v, ch: bound(places(ch).bitwiseAND(v), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(e["full"]))
        return F.bit_count(e["full"] - F.aggregate(letters(b), e["full"], step))

    of = lambda ls: F.struct(F.transform(ls, lambda x, j: F.struct(x.alias("y"), bit(j).alias("bit"))).alias("bits"), (bit(F.size(ls)) - 1).alias("full"))
    return F.when(F.length(a) <= BITS, bound(letters(a), lambda ls: bound(of(ls), folded))).otherwise(_by_rows(a, b))


def _by_rows(a: Column, b: Column) -> Column:
    """As common_length, for texts of any length: a row of the table of lengths for each character of a."""
    letters = F.filter(F.split(b, ""), lambda x: x != "")
    start = F.transform(F.sequence(F.lit(0), F.size(letters)), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        step = lambda r, y, j: F.array_append(r, F.when(x == y, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(r, -1))))
        pairs = F.transform(letters, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(pairs, F.array(F.lit(0)), lambda r, p: step(r, p["y"], p["j"]))

    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda x: x != ""), start, row), -1)


def ratio(a: Column, b: Column) -> Column:
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * common_length(a, b) / n)


def _tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of comparing common tokens, and common tokens with either side's others; 0 if a side has none."""
    ta, tb = _tokens(a), _tokens(b)
    both, only_a, only_b = F.array_intersect(ta, tb), F.array_except(ta, tb), F.array_except(tb, ta)
    join = lambda *xs: F.trim(F.concat_ws(" ", *(F.array_join(x, " ") for x in xs)))
    s, sa, sb = join(both), join(both, only_a), join(both, only_b)
    inside = (F.size(both) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    some = F.when(F.size(both) > 0, F.greatest(ratio(s, sa), ratio(s, sb))).otherwise(F.lit(0.0))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).when(inside, 100.0).otherwise(F.greatest(ratio(sa, sb), some))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter string with a stretch of the longer of up to its length."""
    swap = F.length(a) > F.length(b)
    short, long_ = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n, m = F.length(short), F.length(long_)
    starts = F.sequence(F.lit(1) - n, m - 1)
    stretch = lambda i: F.substring(long_, F.greatest(i, F.lit(0)) + 1, F.least(i + n, m) - F.greatest(i, F.lit(0)))
    best = F.array_max(F.transform(starts, lambda i: ratio(short, stretch(i))))
    return F.when(n == 0, F.when(m == 0, 100.0).otherwise(0.0)).otherwise(best)


def alignment(a: Column, b: Column) -> Column:
    """struct(score, start, end): partial_ratio and where in b the best stretch for a lies, the leftmost of equals; all
    of b if a is longer."""
    n, m = F.length(a), F.length(b)
    begin, end = (lambda i: F.greatest(i, F.lit(0))), (lambda i: F.least(i + n, m))
    each = lambda i: F.struct(ratio(a, F.substring(b, begin(i) + 1, end(i) - begin(i))).alias("score"), (-begin(i)).alias("back"), end(i).alias("end"))
    best = F.transform(F.array(F.array_max(F.transform(F.sequence(F.lit(1) - n, m - 1), each))), lambda x: F.struct(x["score"].alias("score"), (-x["back"]).alias("start"), x["end"].alias("end")))
    whole = F.struct(partial_ratio(a, b).alias("score"), F.lit(0).alias("start"), m.alias("end"))
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when((n == 0) | (m == 0), nothing).when(n <= m, F.get(best, F.lit(0))).otherwise(whole)


def label_factor(score: Column) -> Column:
    return 0.8 + 0.2 * F.least(F.lit(1.0), score / 100.0)


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence: places of a as bits that each character of b moves on."""
    places: dict[str, int] = {}
    for j, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return (full ^ v).bit_count()


def like(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def like_sets(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both = sorted(ta & tb)
    if both and (ta <= tb or tb <= ta):
        return 100.0
    s, sa, sb = (" ".join(both + sorted(x)) for x in ((), ta - tb, tb - ta))
    return max(like(sa, sb), *((like(s, sa), like(s, sb)) if both else (0.0,)))


def _over_pairs(f):
    """A measure of two columns, once for each different pair of a batch; null where either is."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = f(x, y)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(each, T.DoubleType())


ratio_of, token_set_ratio_of = _over_pairs(like), _over_pairs(like_sets)
