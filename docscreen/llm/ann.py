"""Operator 8, approximate nearest neighbours: learned partitions of a neighbour graph, and a classifier that routes.

Fit, on a bounded sample (``SAMPLE`` vectors in the order of a hash): the sample's neighbour graph is cut into balanced
partitions by recursive bisection (Fiedler order of the normalised adjacency, halves at the median, then swaps that
lower the cut). A small classifier, a linear softmax, learns to tell a vector's partition: it starts at the partitions'
means, and in ``TURNS`` turns the sample's vectors move to the partition that it gives them and it learns these again,
so that partitions become what it can tell of vectors it hasn't seen. There are as many partitions as
give each ``ROWS_EACH`` rows, as far as the sample has ``EACH`` vectors for one. Where that leaves more rows to a
partition, each is fitted once more on a sample of its own, on the executors, and routes on to its leaves: partitions
grow with the rows. A leaf's score is the product of its probability and its partition's.

Index: every usable row goes to its likeliest leaf. A leaf with more than ``BLOCK`` rows is cut into blocks by a hash, so
a vector that a third of all rows share is spread too. How many leaves a query probes is calibrated on the whole index:
``TRIED`` vectors in the order of another hash meet every row in one pass, and the least number of leaves that hold
``RECALL`` of their true neighbours is taken. The recall measured so is returned beside the results. Search: a query goes
to all blocks of the leaves it probes, each block returns its nearest, and a window over the query keeps the best of
these. Queries of which fewer than k are found search every leaf, so small inputs return all candidates there are.

Vectors without structure have no partition that keeps their neighbours together; then nearly half of the leaves are
probed (README).

Distances are Euclidean, in double precision on the original vectors. Defined cases: vectors that are null, zero, empty,
or hold null or non-finite components take no part, nor do null vec_ids; each length has its own index; a vec_id that
repeats is one query (its smallest vector) and as many candidates as rows, but never its own; ties go to smaller ids; an
empty table gives an empty table; columns other than vec_id and embedding are left out, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscreen.llm import common, vectors

K, SAMPLE, DEGREE, BLOCK, RECALL = 10, 10_000, 10, 4096, 0.925
TURNS, SEED = 12, 5
#: Sample vectors that a partition needs, rows it should have, partitions that a router tells at most.
EACH, ROWS_EACH, MOST = 64, 128, 128
#: Vectors that calibrate the probes, and queries that meet a block at a time.
TRIED, QUERIES = 256, 8192
FOUND = "query_id long, rank int, vec_id long, score double, partitions int, probes int, measured_recall double"


@dataclass
class Router:
    weight: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each partition's probability."""
        z = x @ self.weight + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Tree:
    """A router, and one for each of its partitions where those are fitted once more."""

    top: Router
    below: dict[int, Router]

    def __post_init__(self):
        self.sizes = [len(self.below[p].bias) if p in self.below else 1 for p in range(len(self.top.bias))]
        self.first = np.r_[0, np.cumsum(self.sizes)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each leaf's probability."""
        top = self.top.scores(x)
        return np.concatenate([top[:, [p]] + (self.below[p].scores(x) if p in self.below else 0.0) for p in range(top.shape[1])], axis=1)

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        """The leaves of each vector, likeliest first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :most].astype("i4")

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that a row is kept in: the likeliest partition's likeliest."""
        top = self.top.scores(x).argmax(1)
        out = self.first[top]
        for p in np.unique(top):
            if int(p) in self.below:
                own = top == p
                out[own] += self.below[int(p)].scores(x[own]).argmax(1)
        return out.astype("i4")


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    n, out = len(x), []
    sq = (x * x).sum(1)
    for i in range(0, n, 128):
        d = sq[None] - 2 * x[i : i + 128] @ x.T
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)].copy())  # a view would keep all of it
    return np.concatenate(out)


def bisected(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced partition of the symmetric neighbour graph into a power of two of parts."""
    n = len(near)
    label = np.zeros(n, "i4")
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.r_[src, dst], np.r_[dst, src]
    done = 1
    while done < parts:
        after = np.empty(n, "i4")
        for part in range(done):
            own = np.flatnonzero(label == part)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[src] >= 0) & (at[dst] >= 0)
            s, t, m = at[src[inside]], at[dst[inside]], len(own)
            deg = np.bincount(s, minlength=m) + 1.0
            root = np.sqrt(deg)
            v = rng.normal(size=m)
            for _ in range(60):  # power iteration on (I + D^-1/2 A D^-1/2) / 2, without its first eigenvector
                u = v / root
                v = 0.5 * v + 0.5 * (np.bincount(t, u[s], m) + u) / root
                v -= root * (root @ v) / (root @ root)
                v /= max(np.linalg.norm(v), 1e-30)
            side = np.zeros(m, bool)
            side[np.argsort(v / root, kind="stable")[m // 2 :]] = True
            for _ in range(8):  # swap the vertices that gain most by it, equally many of each side
                other = np.bincount(s, side[t] != side[s], m) - np.bincount(s, side[t] == side[s], m)
                a, b = (np.flatnonzero(x & (other > 0)) for x in (side, ~side))
                k = min(len(a), len(b)) // 2
                if not k:
                    break
                a, b = (x[np.argsort(-other[x], kind="stable")[:k]] for x in (a, b))
                side[a], side[b] = False, True
            after[own] = 2 * part + side
        label, done = after, 2 * done
    return label


def parts_for(rows: int, sample: int) -> int:
    """A power of two: partitions of ROWS_EACH rows or more, with EACH sample vectors or more, MOST at most."""
    parts = 1
    while 2 * parts <= MOST and 2 * parts * ROWS_EACH <= rows and 2 * parts * EACH <= sample:
        parts *= 2
    return parts


def fit(x: np.ndarray, parts: int) -> Router:
    """A router to a power of two of partitions, from a sample of different vectors."""
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    y = bisected(neighbours(x, min(DEGREE, len(x) - 1)), parts, np.random.default_rng(SEED))
    mean = np.stack([x[y == p].mean(0) for p in range(parts)])
    for _ in range(TURNS):
        r = _linear(mean, 1.0)
        y = (x @ r.weight + r.bias).argmax(1)
        mean = np.stack([x[y == p].mean(0) if (y == p).any() else mean[p] for p in range(parts)])
    # one variance for all partitions and directions: the softmax of normal densities is linear
    return _linear(mean, float(((x - mean[y]) ** 2).mean()) or 1.0)


def _linear(mean: np.ndarray, variance: float) -> Router:
    return Router(mean.T / variance, -(mean * mean).sum(1) / (2 * variance))


def _routed(tree, width: int):
    """Adds each row's leaf."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch["v"]) if batch.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.home(x), pa.int32())], names=[*batch.schema.names, "part"])

    return rows


def _probing(tree, most: int, width: int):
    """A row for each leaf that a query probes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                order = tree.value.ranked(vectors.matrix(own["v"]), most)
                at = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
                yield pa.RecordBatch.from_arrays([own["vec_id"].take(at), own["v"].take(at), pa.array(order.ravel(), pa.int32())], names=["query_id", "v", "part"])

    return rows


def _tried(queries, k: int):
    """Of a task's rows the k nearest others of each calibration query, with their leaves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        best = [np.full((len(q), k), x) for x in (np.inf, 0, 0)]  # distance, vec_id, leaf
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                own = batch.slice(i, 4096)
                x, vid, part = vectors.matrix(own["v"]), own["vec_id"].to_numpy(), own["part"].to_numpy()
                d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
                d[ids[:, None] == vid[None]] = np.inf
                all_ = [np.concatenate([b, np.broadcast_to(y, d.shape)], axis=1) for b, y in zip(best, (d, vid, part), strict=True)]
                at = np.argpartition(all_[0], k - 1, axis=1)[:, :k]
                best = [np.take_along_axis(y, at, axis=1) for y in all_]
        ok = np.isfinite(best[0])
        who = np.repeat(np.arange(len(q)), ok.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), *(pa.array(b[ok].astype(t)) for b, t in zip(best, ("f8", "i8", "i4"), strict=True))], names=["who", "d", "vec_id", "part"])

    return rows


def calibrated(index: DataFrame, tree: Tree, held, width: int, k: int, recall: float) -> tuple[int, float]:
    """How many leaves a query probes, and the recall that this had for TRIED vectors against every row."""
    leaves = int(tree.first[-1])
    if leaves == 1:
        return 1, 1.0
    rows = index.withColumn("o", F.xxhash64("vec_id", F.lit(7))).orderBy("o", "vec_id").limit(TRIED).select("vec_id", "v").collect()  # bounded by TRIED
    ids, q = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows], "f8").reshape(-1, width)
    near = index.mapInArrow(_tried(index.sparkSession.sparkContext.broadcast((ids, q)), k), "who int, d double, vec_id long, part int")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("who").orderBy("d", "vec_id"))).where(F.col("n") <= k).groupBy("who").agg(F.collect_list("part").alias("parts")).collect()  # TRIED rows
    place = np.argsort(tree.ranked(q, leaves), axis=1)
    found = np.concatenate([place[r["who"], np.array(r["parts"])] for r in best]) if best else np.zeros(1, int)
    shares = np.cumsum(np.bincount(found, minlength=leaves)) / len(found)
    probes = int(np.argmax(shares >= recall)) + 1
    return probes, float(shares[probes - 1])


def _nearest(k: int):
    def block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "vec_id": "i8"})
        a, b = np.stack(q["v"].to_numpy()).astype("f8"), np.stack(c["v"].to_numpy()).astype("f8")
        qid, cid = q["query_id"].to_numpy("i8"), c["vec_id"].to_numpy("i8")
        by_id = np.argsort(cid, kind="stable")
        b, cid = b[by_id], cid[by_id]
        sq, out = (b * b).sum(1), []
        for x, i in zip(a, qid, strict=True):
            near = sq - 2 * (b @ x)
            near[cid == i] = np.inf
            # those within rounding of the k-th are measured exactly; then ties go by id
            bar = np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1]
            at = np.flatnonzero(near <= bar + 1e-6 * (1 + abs(bar) + x @ x)) if np.isfinite(bar) else np.flatnonzero(np.isfinite(near))
            d = np.sqrt(((b[at] - x) ** 2).sum(1))
            best = np.lexsort((cid[at], d))[:k]
            out.append((np.full(len(best), i), cid[at][best], d[best]))
        qs, cs, ds = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": qs, "vec_id": cs, "score": ds})

    return block


def _searched(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k nearest of each (query_id, v, part) in its leaf's blocks."""
    n = common.partitions(index, 4 << 20)
    # one row for each leaf, MOST squared at most
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    plan = F.broadcast(sizes.join(asked, "part"))
    # every block of the leaf for a query, every turn of queries for a row
    q = queries.join(plan, "part").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    c = index.join(plan, "part").withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cuts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    by = ["part", "cut", "turn"]
    q, c = q.select("query_id", "v", *by).repartition(n, *by), c.select("vec_id", "v", *by).repartition(n, *by)
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")


def searched(rows: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that each query (vec_id, embedding) finds in rows of its length,
    and of that length's index the partitions, the probes and the recall measured."""
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & vectors.usable(F.col("v")))
    index, asked = take(rows), take(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = None
    for width in vectors.widths(asked, "v"):
        own = _searched_width(index.where(F.size("v") == width), asked.where(F.size("v") == width), width, k, recall)
        found = own if found is None else found.unionByName(own)
    return rows.sparkSession.createDataFrame([], FOUND) if found is None else found


def _sample(rows: DataFrame, n_rows: int, width: int) -> np.ndarray:
    """The different vectors among the first SAMPLE rows by a hash."""
    share = int(min(1.0, 1.2 * SAMPLE / max(n_rows, 1)) * (1 << 30)) + 1
    hashed = rows.withColumn("o", F.xxhash64("vec_id")).where(F.pmod("o", F.lit(1 << 30)) < share)
    sample = [r["v"] for r in hashed.orderBy("o", "vec_id").limit(SAMPLE).select("v").collect()]  # bounded by SAMPLE
    return np.unique(np.array(sample, "f8").reshape(-1, width), axis=0)


def _refit(rows_each: int):
    """A partition's router from its sample, as a pickle."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.stack(part["v"].to_numpy()).astype("f8"), axis=0)
        return pd.DataFrame({"part": [int(key[0])], "router": [pickle.dumps(fit(x, parts_for(int(part["n"].iloc[0]), len(x))))]})

    return one


def learned(rows: DataFrame, n_rows: int, width: int) -> Tree:
    """The tree of routers for rows (vec_id, v) of one length."""
    x = _sample(rows, n_rows, width)
    tree = Tree(fit(x, parts_for(n_rows, len(x))), {})
    if len(tree.top.bias) < MOST or n_rows < 4 * MOST * ROWS_EACH:
        return tree
    held = rows.sparkSession.sparkContext.broadcast(tree)
    homes = common.written(rows.mapInArrow(_routed(held, width), "vec_id long, v array<double>, part int"), "ann-homes")
    sizes = homes.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * ROWS_EACH)  # MOST rows at most
    # a partition's sample: SAMPLE / 2 rows or some more, chosen by a hash where the rows are
    few = homes.join(F.broadcast(sizes), "part").where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (SAMPLE // 2) / F.col("n"))
    fitted = few.groupBy("part").applyInPandas(_refit(ROWS_EACH), "part int, router binary").collect()  # MOST rows of some 100 KB
    return Tree(tree.top, {r["part"]: pickle.loads(r["router"]) for r in fitted})


def _searched_width(rows: DataFrame, asked: DataFrame, width: int, k: int, recall: float) -> DataFrame:
    """As searched, of usable vectors of one length; asked has each vec_id once."""
    spark = rows.sparkSession
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], FOUND)
    tree = learned(rows, n_rows, width)
    leaves = int(tree.first[-1])
    held = spark.sparkContext.broadcast(tree)  # routers alone, 100 KB each
    index = common.written(rows.mapInArrow(_routed(held, width), "vec_id long, v array<double>, part int"), "ann-index")
    probes, measured = calibrated(index, tree, held, width, k, recall)
    probing = lambda q, m: q.select("vec_id", "v").mapInArrow(_probing(held, m, width), "query_id long, v array<double>, part int")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    told = lambda q: _searched(q, index, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = common.checkpoint(told(common.checkpoint(probing(asked, probes))))
    if probes < leaves:
        few = asked.join(found.groupBy("query_id").count().where(F.col("count") >= min(k, max(n_rows - 1, 0))), F.col("vec_id") == F.col("query_id"), "left_anti")
        few = common.checkpoint(probing(few, leaves))
        if not few.isEmpty():
            again = told(few)
            found = found.join(few.select("query_id").distinct(), "query_id", "left_anti").select(found.columns).unionByName(again)
    return found.select("*", F.lit(leaves).alias("partitions"), F.lit(probes).alias("probes"), F.lit(measured).alias("measured_recall"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return searched(rows, rows.where("vec_id % 100 = 0"))
