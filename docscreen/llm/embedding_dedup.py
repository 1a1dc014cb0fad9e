"""Operator 6, embedding near-dedup: collision-counting projections within a label.

Equal vectors of a label are one class with a multiplicity, so copies cost nothing. Unit vectors are projected on random
Gaussian directions. A projection is sorted at its two ends alone, where a share ``q`` of all vectors lies: there a
window around a query holds few others. For two unit vectors of cosine c their values in a direction are normal with
correlation c, so both lie in one end, within the window of each other, with a known probability; over independent
directions the collisions of a pair are binomial. Directions are so many that a pair at the threshold collides SHARE
times on average, and the count that a candidate must reach is the largest that such a pair misses with probability
MISS at most. Colliding vectors meet in one list, where each brings a sketch, the signs of SKETCH further directions; of
a pair at the threshold more signs than are let pass differ with probability MISS at most, of unlike vectors nearly
always. Pairs that pass both are verified by their cosine in double precision.

``q`` follows the largest label: an end should hold ``members`` vectors of it. Where that takes more than DIRECTIONS
directions, a second set parts each end's list: by the signs in ``bits`` other directions, of which a list then holds
CROWD times as many vectors, since sketches are compared fast and rows of lists are not.

Plan. Rows of (list, value, class, sketch) are dealt by list and sorted by value; a list gives the pairs of each query's window
that their sketches let pass; Spark counts a pair over all lists. Directions are taken in rounds, each of which shuffles
no more than the vectors' own bytes and deletes its shuffle. Vectors meet the counted pairs alone; elsewhere two hashes
stand for them. common.components joins the links. A cluster of m different vectors that all link costs its m * m / 2
links: they are counted one by one.

Vectors of different lengths are never compared; each length is run for itself, one after the other.

Defined cases: null, empty and zero vectors, those with null or non-finite components, and rows with a null label link
with nothing: n_links 0, component_id = vec_id, kept. Rows with a null vec_id take no part and have null ids (kept is
false). Rows are judged by their vectors: repeated rows link as other vectors do, and a vec_id with two vectors has a row
for each. Further columns are left out, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import common, vectors

LEAST, SHARE, MISS, WINDOW, SEED = 0.93, 17.0, 1e-7, 1.5, 11
#: Directions of a set at most, vectors of a label that an end should hold, rows that pair with PAIRED others at a time.
DIRECTIONS, MEMBERS, LIMIT, PAIRED = 8192, 16, 2048, 64
#: The largest share of vectors in an end, how many times ``members`` a parted list holds, signs of a sketch.
WIDEST, CROWD, SKETCH = 0.1, 16, 256
#: Bytes of a row of a list in a shuffle, those that a round shuffles in any case, and those of a task.
ROW, ROUND, TASK = 64, 256 << 20, 32 << 20
#: Values of projections that are worked out at a time; a sketch's columns, 64 signs each.
BLOCK, SIGNS = 1 << 20, tuple(f"s{i}" for i in range(SKETCH // 64))


def reach(least: float) -> float:
    """The distance of unit vectors at a cosine."""
    return math.sqrt(2 - 2 * least)


def both_in(bar: float, cosine: float, window: float) -> float:
    """The probability that values of correlation ``cosine`` lie in one of the two ends, a window from each other at most."""
    u = np.linspace(bar, bar + 8, 4001)
    cdf = np.vectorize(NormalDist().cdf)
    s = math.sqrt(1 - cosine * cosine)
    inside = cdf((u + window - cosine * u) / s) - cdf((np.maximum(bar, u - window) - cosine * u) / s)
    return float(2 * np.trapezoid(np.exp(-u * u / 2) / math.sqrt(2 * math.pi) * np.maximum(inside, 0), u))


def needed(n: int, p: float, sets: int, miss: float = MISS) -> int:
    """The largest count that a product of ``sets`` binomials (n, p) misses with probability ``miss`` at most; 1 at least."""
    pmf = np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(min(n, 200) + 1)])
    product = {1: 1.0}
    for _ in range(sets):
        after: dict[int, float] = {}
        for a, x in product.items():
            for k, y in enumerate(pmf):
                if y > 1e-15 and a * k < 64:
                    after[a * k] = after.get(a * k, 0.0) + x * float(y)
        product = after
    count = 1
    while count < 60 and sum(x for c, x in product.items() if c < count + 1) <= miss:
        count += 1
    return count


def differing(least: float, signs: int = SKETCH, miss: float = MISS / 3) -> int:
    """The fewest of some signs that more of differ, of a pair at a cosine, with probability ``miss`` at most."""
    p = min(max(math.acos(min(max(least, -1.0), 1.0)) / math.pi, 1e-9), 1 - 1e-9)
    pmf = [math.comb(signs, k) * p**k * (1 - p) ** (signs - k) for k in range(signs + 1)]
    return next(k for k in range(signs + 1) if sum(pmf[k + 1 :]) <= miss)


class Plan:
    """How many directions, where their ends begin, by how many signs their lists are parted, the count that a pair must
    reach and how many signs may differ, of the first ones of its sketch and of all; from the largest label's size."""

    def __init__(self, largest: int, least: float, members: int = MEMBERS, directions: int = DIRECTIONS):
        self.window, cosine = WINDOW * reach(least), min(max(least, 0.0), 1 - 1e-9)
        for self.bits in range(40):
            held = members * CROWD << self.bits if self.bits else members
            self.share = min(WIDEST, held / max(largest, 1))
            self.bar = NormalDist().inv_cdf(1 - self.share)
            p = both_in(self.bar, cosine, self.window) * (1 - math.acos(cosine) / math.pi) ** self.bits
            self.n = math.ceil(SHARE / p)
            if self.n <= directions or self.share == WIDEST:
                break
        self.sets = 2 if self.bits else 1
        self.count, self.differing = needed(self.n, p, 1), {n: differing(least, 64 * n) for n in (1, 2, SKETCH // 64)}

    def rounds(self, rows: int, most: int) -> int:
        """Rounds whose lists take ``most`` bytes each; a round has more directions than signs that part a list."""
        return max(1, min(math.ceil(2 * self.share * self.n * rows * ROW / most), self.n // (self.bits + 1)))


def _signs(y: np.ndarray) -> np.ndarray:
    """Rows of 64 signs as numbers."""
    return np.packbits(y > 0, axis=1, bitorder="little").view("<i8")


def _ends(width: int, plan: Plan, turn: int = 0, turns: int = 1):
    """A row (label, l, p, cid, s0 to s3) for each list of a round's directions that a vector is in; p is its value, s0
    to s3 are its sketch."""
    first, last = plan.n * turn // turns, plan.n * (turn + 1) // turns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.random.default_rng([SEED, turn]).normal(size=(width, last - first)).astype("f4")
        planes = np.random.default_rng([SEED, turns]).normal(size=(width, SKETCH))
        for batch in batches:
            each = max(64, BLOCK // (last - first))
            for i in range(0, batch.num_rows, each):
                part = batch.slice(i, each)
                x = vectors.matrix(part["v"])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay finite
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sketch = _signs(x @ planes)
                y = x.astype("f4") @ own
                r, k = np.nonzero(np.abs(y) >= plan.bar)
                v = y[r, k]
                lists = 2 * (first + k) + (v > 0)
                for j in range(plan.bits):
                    lists = 2 * lists + (y[r, (k + 1 + j) % (last - first)] > 0)
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([part["label"].take(at), pa.array(lists), pa.array(np.abs(v), pa.float32()), part["cid"].take(at), *(pa.array(z[r]) for z in sketch.T)], names=["label", "l", "p", "cid", *SIGNS])

    return rows


def _windows(plan: Plan, most: int):
    """A task's rows, of whole lists: the pairs of each row and those of its list behind it within the window that their
    sketches let pass, with how often they met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        h, p = table["h"].to_numpy(), table["p"].to_numpy()
        order = np.lexsort((p, h))
        h, p, cid = h[order], p[order], table["cid"].to_numpy()[order]
        signs = [table[c].to_numpy().view("u8")[order] for c in SIGNS]  # numpy counts the bits of a negative number's absolute value
        del table, order
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        # one order for all lists: values are below 64, so a list's are apart from the next one's
        key = group * 64.0 + p
        n = np.searchsorted(key, np.minimum(key + plan.window, group * 64.0 + 63), "right") - np.arange(len(key)) - 1
        ends = np.cumsum(n)
        i, found = 0, []
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            m = n[i:j]
            b = np.arange(m.sum(), dtype="i4") + np.repeat((np.arange(i + 1, j + 1) - (np.cumsum(m) - m)).astype("i4"), m)
            apart = np.bitwise_count(np.repeat(signs[0][i:j], m) ^ signs[0][b])
            at = np.flatnonzero(apart <= plan.differing[1])  # by the first signs first, which most unlike pairs don't pass
            a, b, apart = np.repeat(np.arange(i, j, dtype="i4"), m)[at], b[at], apart[at].astype("i2")
            for k in range(1, len(signs)):
                apart += np.bitwise_count(signs[k][a] ^ signs[k][b])
                if k + 1 in plan.differing:
                    keep = apart <= plan.differing[k + 1]
                    a, b, apart = a[keep], b[keep], apart[keep]
            i = j
            if len(a):
                found.append(np.stack([np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])]))
            if found and (i >= len(n) or sum(x.shape[1] for x in found) >= 1 << 18):
                met, times = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1]), pa.array(times)], names=["a", "b", "n"])

    return rows


def _verified(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = vectors.matrix(batch["va"]), vectors.matrix(batch["vb"])
            x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
            x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
            ok = pa.array(np.einsum("ij,ij->i", x, y) >= least)
            yield pa.RecordBatch.from_arrays([batch[c].filter(ok) for c in ("a", "b", "ma", "mb")], names=["a", "b", "ma", "mb"])

    return rows


def _key(v: str) -> list[Column]:
    """Two hashes that stand for a vector, by its components as doubles."""
    whole = F.col(v).cast("array<double>")
    return [F.xxhash64(whole).alias("__k"), F.xxhash64(F.lit(SEED), whole).alias("__j")]


def linked(rows: DataFrame, least: float = LEAST, members: int = MEMBERS, limit: int = LIMIT, directions: int = DIRECTIONS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label"))
    fit = rows.where(vectors.usable(F.col("v").cast("array<double>")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    told = None
    for width in vectors.widths(fit, "v"):
        own = _classes(fit.where(F.size("v") == width), width, least, members, limit, directions)
        told = own if told is None else told.unionByName(own)
    if told is None:
        return _told(rows.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("c")))
    same = told.withColumnRenamed("label", "__label")
    own = rows.where("vec_id is not null").select("vec_id", "label", *_key("v"))
    own = own.join(same, (F.col("label") == F.col("__label")) & (own["__k"] == same["__k"]) & (own["__j"] == same["__j"]), "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"), "c")
    return _told(own.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("c"))))


def candidates(classes: DataFrame, width: int, plan: Plan, limit: int = LIMIT) -> DataFrame:
    """(a, b, n): the pairs of classes (label, v, cid) that collide in n lists, plan.count at least."""
    rows = classes.count()
    most = max(ROUND, 4 * width * rows)
    turns = plan.rounds(rows, most)
    n = max(common.partitions(classes), math.ceil(2 * plan.share * plan.n * rows * ROW / turns / TASK))
    kind, met = classes.schema["label"].dataType.simpleString(), None
    for turn in range(turns):
        lists = classes.select("label", "v", "cid").mapInArrow(_ends(width, plan, turn, turns), f"label {kind}, l long, p float, cid long, {', '.join(f'{c} long' for c in SIGNS)}")
        dealt = lists.select(F.xxhash64("label", "l").alias("h"), "p", "cid", *SIGNS).repartition(n, "h")
        own = common.written(dealt.mapInArrow(_windows(plan, limit * PAIRED), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "vector-pairs")
        met = own if met is None else met.unionByName(own)
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= plan.count)


def _classes(fit: DataFrame, width: int, least: float, members: int, limit: int, directions: int) -> DataFrame:
    """label, __k, __j, n, c: links and component of each different vector of one length under a label."""
    classes = common.written(fit.groupBy("label", "v").agg(F.min("vec_id").alias("m"), F.count("*").alias("mult")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    plan = Plan(classes.groupBy("label").count().agg(F.max("count")).first()[0], least, members, directions)
    met = candidates(classes, width, plan, limit)
    left = classes.select(F.col("cid").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"), F.col("m").alias("ma"), F.col("mult").alias("na"))
    right = classes.select(F.col("cid").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"), F.col("m").alias("mb"), F.col("mult").alias("nb"))
    pairs = met.join(left, "a").join(right, "b").where("la = lb").select("a", "b", "va", "vb", F.struct(F.col("ma").alias("m"), F.col("na").alias("n")).alias("ma"), F.struct(F.col("mb").alias("m"), F.col("nb").alias("n")).alias("mb"))
    one = "struct<m: long, n: long>"
    links = common.written(pairs.mapInArrow(_verified(least), f"a long, b long, ma {one}, mb {one}"), "vector-links")
    same = common.components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("cid"), F.col("mb.n").alias("n")).unionByName(links.select(F.col("b").alias("cid"), F.col("ma.n").alias("n")))
    links_of = ends.groupBy("cid").agg(F.sum("n").alias("links"))
    own = classes.select("label", *_key("v"), "cid", "m", "mult")
    told = own.join(links_of, "cid", "left").join(same, F.col("cid") == same["node"], "left").withColumn("component", F.coalesce("component", "cid"))
    first = told.groupBy("component").agg(F.min("m").alias("c"))
    return told.join(first, "component").select("label", "__k", "__j", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), "c")


def _told(rows: DataFrame) -> DataFrame:
    component = F.coalesce("c", "vec_id")
    return rows.select("vec_id", F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
