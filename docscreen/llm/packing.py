"""Operator 7, best-fit packing: token sequences of a fixed length, certified by lower bounds.

A document's ids end with id 2. Only documents of more than ``size`` tokens are cut: into pieces of ``size`` tokens, of
which the first may be shorter. Every piece lands in one sequence; sequences have ``size`` places.

Plan. Tokens are counted once, and pieces (not ids) are written to the shared folder. A piece that fills a sequence is
one. The others are dealt over partitions, and each packs its own by best-fit decreasing. A dual-feasible function f
maps lengths so that no set of pieces fitting one sequence has f-sum over 1; so ceil(sum f) is a lower bound, and the
best of a family of such functions certifies a partition that meets it. In a partition with a gap, sequences that aren't
full are opened, and their pieces go back: with those of all other such partitions they are dealt anew over fewer
partitions, and packed again, for ``rounds`` rounds or until one partition holds what is left. A certified partition
gives back its emptiest sequence alone. In the last round a partition with a gap repacks such sequences in other orders;
what has a gap even then stays uncertified. Partitions stay of bounded size throughout, so the work spreads.

The results say of each piece whether its sequence's partition was certified: as many sequences as its bound.

Defined cases: a null or empty text is its end token alone; rows with equal or null doc_id are packed each for itself;
an empty table gives an empty table; texts of any length are packed whole; further columns are left out, whatever their
names; ``size`` under 1 is refused.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import common, tokens

SIZE, END = 1024, 2
#: Pieces that a partition packs, and rounds of exchange.
PARTITION_PIECES = 10_000
ROUNDS = 4
#: In the last round, how often a partition with a gap repacks its sequences that aren't full.
TRIES = 50

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids."""
    if size < 1:
        raise ValueError("a sequence has at least one place")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(tokens.ids(text.as_py()), np.uint32(END)).astype("<u4", copy=False)
                raw, at = ids.tobytes(), 0
                for k in range(-(-len(ids) // size)):
                    end = len(ids) - size * (-(-len(ids) // size) - 1 - k)
                    out.append((d.as_py(), k, at, end - at, zlib.crc32(raw[4 * at : 4 * end])))
                    at = end
            cols = zip(*out, strict=True) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.freeing(rows), _PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best bound of two families of dual-feasible functions, both over the histogram of lengths.

    f_k, k up to size / 2: x over size - k counts 1, x under k counts 0, others x / size.
    u_k, k from 1: x / size where x (k + 1) / size is whole, else floor(x (k + 1) / size) / k.
    """
    if not len(lengths):
        return 0
    x, n = np.unique(lengths, return_counts=True)
    best = -(-int((x * n).sum()) // size)
    for k in {*x[2 * x <= size].tolist(), 0}:
        fit = int((x * n * ((x >= k) & (x <= size - k))).sum())
        best = max(best, int(n[x > size - k].sum()) + -(-fit // size))
    for k in range(1, 101):
        scaled = x * (k + 1)
        f = np.where(scaled % size == 0, x * k, scaled // size * size)
        best = max(best, -(-int((f * n).sum()) // (size * k)))  # f is u_k times size * k
    return best


def best_fit(lengths: np.ndarray, size: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, decreasing unless an order is given: the bin and offset of each length, and each bin's free places."""
    order = np.argsort(-lengths, kind="stable") if order is None else order
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    frees: list[int] = []  # the sorted free sizes that some bin has
    free: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect.bisect_left(frees, n)
        if k < len(frees):
            room = frees[k]
            b = by_free[room].pop()
            if not by_free[room]:
                frees.pop(k)
        else:
            room, b = size, len(free)
            free.append(size)
        bins[i], offsets[i] = b, size - room
        free[b] = room - n
        if left := room - n:
            if not by_free[left]:
                bisect.insort(frees, left)
            by_free[left].append(b)
    return bins, offsets, np.array(free, "i8")


def repacked(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """bins and offsets with the sequences that aren't full packed again in other orders, until the bound certifies them
    or TRIES are over. Their number never grows."""
    bins, offsets, free, rng = bins.copy(), offsets.copy(), free.copy(), np.random.default_rng(0)
    bound = lower_bound(lengths, size)
    for _ in range(TRIES):
        at, old = np.flatnonzero(free[bins] > 0), np.flatnonzero(free > 0)
        if (free >= 0).sum() <= bound or not len(old):
            break
        order = np.argsort(-lengths[at] * rng.uniform(rng.uniform(), 1, len(at)), kind="stable")
        b, o, left = best_fit(lengths[at], size, order)
        if len(left) <= len(old):
            bins[at], offsets[at] = old[b], o
            free[old] = np.r_[left, np.full(len(old) - len(left), -1)]  # -1: nothing is left in it
    return bins, offsets


def _packer(size: int, last: bool):
    """A partition's pieces with their places. Unless last, pieces that may fit better elsewhere are left open.

    A certified partition opens its emptiest sequence alone; one with a gap opens all that aren't full. The last round
    repacks those itself.
    """

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid").reset_index(drop=True)
        lengths = part["length"].to_numpy("i8")
        bins, offsets, free = best_fit(lengths, size)
        open_, bound = np.zeros(len(free), bool), lower_bound(lengths, size)
        if not last:
            open_[free.argmax()] = free.max() > 0
            if len(free) > bound:
                open_ = free > 0
        else:
            bins, offsets = repacked(lengths, bins, offsets, free, size)
        # what stays of a partition with a gap are full sequences, and those are certified by themselves
        certified = len(np.unique(bins)) == bound or not last
        return pd.DataFrame({"pid": part["pid"], "length": lengths, "open": open_[bins], "group": int(key[0]), "bin": bins, "offset": offsets, "certified": certified})

    return pack


def packed(docs: DataFrame, size: int = SIZE, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """pieces() with sequence_id, offset and certified."""
    told = common.checkpoint(pieces(docs, size).withColumn("pid", F.monotonically_increasing_id()))
    full = told.where(F.col("length") == size).withColumn("sequence_id", -F.col("pid") - 1).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    rest = told.where(F.col("length") < size).select("pid", "length")
    n = rest.count()
    done = None
    for turn in range(rounds):
        groups = max(1, -(-n // partition_pieces))
        last = turn == rounds - 1 or groups == 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(groups)))
        out = common.checkpoint(dealt.groupBy("g").applyInPandas(_packer(size, last), "pid long, length long, open boolean, group long, bin long, offset long, certified boolean"))
        own = out.where("not open").select("pid", ((F.lit(turn).cast("long") * (1 << 24) + F.col("group")) * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset", "certified")
        done = own if done is None else done.unionByName(own)
        if last:
            break
        rest = out.where("open").select("pid", "length")
        n = rest.count()
        if not n:
            break
    placed = told.where(F.col("length") < size).join(done, "pid")
    return full.select(placed.columns).unionByName(placed).drop("pid")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
