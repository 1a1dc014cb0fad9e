"""Operator 5, SimHash near-dedup: fingerprints link at a few differing bits, found by a binary trie self-join.

A-Z are lower-cased; words are runs of bytes other than 20 and 09-0D (hex); shingles are three words joined by a space,
repeats included (fewer words: the whole sequence; none: fingerprint zero). A shingle's hash is its XXH64 with seed 42;
a fingerprint's bit is 1 if it is set in over half the hashes.

Plan. Distinct fingerprints alone take part (grouped with a partial aggregate, so copies cost nothing). Two fingerprints
within 3 bits agree in one of four blocks of 16 bits, so each goes to four groups (block, value). A group larger than
``group_limit`` goes down a level: the bits that its blocks have left are cut into four blocks again, of which two within
3 bits agree in one, so each row goes to four smaller groups; after LEVELS levels what is still too large is split into
salts, and each pair of salts is a group of its own. No link is lost. In a group a binary trie over the sorted
fingerprints is joined with itself: node pairs are traversed together, differing bits add up, and a pair of nodes goes
when the sum exceeds the budget. A node pair whose fingerprints are all connected already is dropped too, so a dense
cluster costs no square. Groups emit a star for each local component; common.components joins the stars.

Defined cases: null and empty texts have fingerprint zero and link like any other; a doc_id with several texts is one
node: what links to one of them is one component; rows with a null doc_id link like others and get the smallest doc_id
that they reach, or null; repeated rows get the same result each; an empty table gives an empty table; texts of any
length are read whole; further columns are kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm import common

BITS, BLOCKS, BUDGET, SHINGLE, SEED = 64, 4, 3, 3, 42
GROUP_LIMIT, LEVELS = 4000, 4
#: Node pairs that the traversal expands at a time, and the product of sizes at which a pair is compared directly.
CHUNK, LEAF = 1 << 18, 32


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k : k + n] for k in range(width)), strict=True)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), "<u8", n)
    ones = np.zeros(BITS, "i8")
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with one more column: the fingerprint's 64 bits as a signed long."""
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(at)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=names)

    return docs.mapInArrow(common.freeing(rows), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; parent[i] is the smallest index of i's class."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _find(parent)
    return parent


def trie_join(fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of the sorted distinct uint64 fingerprints the smallest index in its component."""
    n = len(fp)
    parent = np.arange(n)
    if n < 2:
        return parent
    ones = {}

    def split(lo, hi, bit):
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype="i8")]
        return hi - (ones[bit][hi] - ones[bit][lo])

    stack = [(np.array([0]), np.array([n]), np.array([0]), np.array([n]), np.array([0]), BITS - 1)]
    while stack:
        lo, hi, lo2, hi2, diff, bit = stack.pop()
        if len(lo) > CHUNK:
            for i in range(0, len(lo), CHUNK):
                stack.append(tuple(x[i : i + CHUNK] for x in (lo, hi, lo2, hi2, diff)) + (bit,))
            continue
        turn = np.r_[0, np.cumsum(parent[1:] != parent[:-1])]
        done = (turn[lo] == turn[hi - 1]) & (turn[lo2] == turn[hi2 - 1]) & (parent[lo] == parent[lo2])
        lo, hi, lo2, hi2, diff = (x[~done] for x in (lo, hi, lo2, hi2, diff))
        if not len(lo):
            continue
        small = (hi - lo) * (hi2 - lo2) <= LEAF if bit >= 0 else np.ones(len(lo), bool)
        if small.any():
            a, b = _cells(lo[small], hi[small], lo2[small], hi2[small])
            near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            parent = _union(parent, a[near], b[near])
            lo, hi, lo2, hi2, diff = (x[~small] for x in (lo, hi, lo2, hi2, diff))
            if not len(lo):
                continue
        m, m2 = split(lo, hi, bit), split(lo2, hi2, bit)
        own = (lo == lo2) & (hi == hi2)
        kids = [(lo, m, lo2, m2, diff, None), (m, hi, m2, hi2, diff, None), (lo, m, m2, hi2, diff + 1, None), (m, hi, lo2, m2, diff + 1, ~own)]
        parts = []
        for a, b, c, d, e, only in kids:
            keep = (a < b) & (c < d) & (e <= budget) & ~((a == c) & (b - a == 1) & (d - c == 1))
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (a, b, c, d, e)])
        lo, hi, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(lo):
            stack.append((lo, hi, lo2, hi2, diff, bit - 1))
    return parent


def _cells(lo, hi, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the rectangles [lo, hi) x [lo2, hi2)."""
    w = hi2 - lo2
    size = (hi - lo) * w
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    w = np.repeat(w, size)
    return np.repeat(lo, size) + at // w, np.repeat(lo2, size) + at % w


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted by (g, fp), here one after the other: a star for each local component."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined(parts):
        g, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        edges_a, edges_b = [], []
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(g)])
        for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            f = np.unique(fp[s : s + n])
            r = f.view("i8")
            if len(f) == 2:
                root = np.array([0, 0]) if int(f[0] ^ f[1]).bit_count() <= BUDGET else np.array([0, 1])
            else:
                root = trie_join(f)
            away = np.flatnonzero(root != np.arange(len(f)))
            edges_a.append(r[away])
            edges_b.append(r[root[away]])
        a, b = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (edges_a, edges_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch[k].to_numpy(zero_copy_only=False).astype("i8") for k in ("g1", "g2")], axis=1)
        fp = batch["fp"].to_numpy().view("u8")
        last = np.flatnonzero((g != g[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield joined([*held, (g[:cut], fp[:cut])])
            held = []
        elif held and (held[-1][0][-1] != g[0]).any():
            yield joined(held)
            held = []
        held.append((g[cut:], fp[cut:]))
    if held:
        yield joined(held)


def masks(levels: int = LEVELS) -> list[list[int]]:
    """For each level the bits that its groups agree in, by path: four blocks of the bits that are left, each time."""

    def blocks(used: int) -> list[int]:
        left = [i for i in range(BITS) if not used >> i & 1]
        ends = [len(left) * k // BLOCKS for k in range(BLOCKS + 1)]
        return [used | sum(1 << i for i in left[ends[k] : ends[k + 1]]) for k in range(BLOCKS)]

    out = [blocks(0)]
    while len(out) < levels:
        out.append([x for used in out[-1] for x in blocks(used)])
    return out


def links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp, enough to connect all that link: stars of groups' components."""
    n = common.partitions(fps, 4 << 20)
    signed = lambda xs: F.lit([x - (1 << 64) if x >> 63 else x for x in xs])
    level, groups = fps.select("fp", F.lit(0).alias("path")), None
    for depth, own in enumerate(masks()):
        level = level.withColumn("path", F.explode(F.sequence(F.col("path") * BLOCKS, F.col("path") * BLOCKS + BLOCKS - 1)))
        level = level.withColumn("v", F.col("fp").bitwiseAND(F.get(signed(own), F.col("path"))))
        sizes = level.groupBy("path", "v").agg(F.count("*").alias("count")).where(F.col("count") > group_limit)
        sizes = common.checkpoint(sizes)
        placed = F.lit(depth * BLOCKS**LEVELS) + F.col("path")
        if sizes.isEmpty():
            cells = level.withColumn("g2", F.lit(0).cast("long")).withColumn("path", placed)
            groups = cells if groups is None else groups.unionByName(cells)
            break
        here = level.join(sizes.select("path", "v"), ["path", "v"], "left_anti").withColumn("g2", F.lit(0).cast("long"))
        level = level.join(sizes, ["path", "v"])
        if depth == LEVELS - 1:
            salted = level.withColumn("n", F.ceil(F.col("count") / group_limit)).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("n")))
            pair = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 2, F.lit(0))), lambda t: t + F.when(t >= F.col("s"), 1).otherwise(0))
            spread = salted.withColumn("t", F.explode(pair)).withColumn("g2", F.least("s", "t") * F.col("n") + F.greatest("s", "t"))
            here = here.unionByName(spread.select(here.columns))
        here = here.withColumn("path", placed)
        groups = here if groups is None else groups.unionByName(here)
        level = level.select("fp", "path")
    dealt = groups.select(F.xxhash64("path", "v").alias("g1"), "g2", "fp").repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2", "fp")
    return dealt.mapInArrow(common.freeing(_links), "a long, b long")


def classes(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(fp, component, least) of each distinct fingerprint of rows (doc_id, fp): least is the smallest doc_id reached."""
    own = common.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("m")))
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where(F.col("first") != F.col("last"))
    same = fps.join(several, "doc_id").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    found = common.components(links(own.select("fp"), group_limit).unionByName(same))
    told = own.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), "m")
    least = told.groupBy("component").agg(F.min("m").alias("least"))
    return told.join(least, "component").select("fp", "component", "least")


def near_duplicates(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    fps = common.checkpoint(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"))
    own = fps.join(classes(fps, group_limit), "fp")
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: of the smallest doc_id, one of them; of a component without any doc_id, one row."""
    fp, uid = common.free(docs, "fp", "uid")
    rows = common.written(fingerprints(docs, fp).withColumn(uid, F.monotonically_increasing_id()), "fingerprinted")
    light = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    light = light.join(classes(light.select("doc_id", "fp")), "fp")
    first = Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "fp", "uid")
    kept = light.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("uid").alias(uid))
    return rows.join(kept, uid, "left_semi").select(docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
