"""Operator 2, token counts: whole texts in the tokenizers library's ids, huge ones by overlap resynchronisation.

Texts of up to ``chunk`` characters are encoded as they are. Longer ones are cut into overlapping chunks, each a row of
its own, and encoded with offsets. A position at which a pre-token starts in both of two neighbouring chunks' encodings
is a common boundary: the pre-tokenizer scans from left to right and its state at such a position is the position, so
from there on both encodings agree until the first chunk's end comes into sight. Only boundaries that lie a special
token's length and one character before that end are used, for nothing behind the end can move those; by induction the
left chunk's boundaries are those of the whole text. Counts are spliced at the first common boundary of each overlap.
Where a pair has none, its text is cut anew with chunks and overlaps ``WIDER`` times as long, until it is one chunk.

Texts are told apart by their MD5: equal chunks of copies are one before they leave a task, and are encoded once. A
text is cut in one walk. Splicing is a window over a text's chunks.

Defined cases: null and empty texts have no tokens; null doc_ids stay as they are; repeated rows are each returned; an
empty table gives an empty table; further columns are left out, whatever their names; no text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscreen.llm import common, tokens

CHUNK, OVERLAP, WIDER = 32_768, 2_048, 8
LIMIT = 1024
#: Characters that one call of the library encodes.
CALL = 1 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out, held, n = batch["text"], [], [], 0
        for x in texts:
            held.append(x.as_py() or "")
            n += len(held[-1])
            if n >= CALL:
                out += map(len, tokens.library().encode_batch_fast(held, add_special_tokens=False))
                held, n = [], 0
        out += map(len, tokens.library().encode_batch_fast(held, add_special_tokens=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Where pre-tokens start, the number of tokens before each, and the number of tokens."""
    e = tokens.library().encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids])
    start = np.array([a for a, _ in e.offsets], "i8")
    new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)][: len(words)])
    return start[new], new, len(words)


def _chunk_rows(overlap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, i, at, text in zip(*(batch[c] for c in ("k", "i", "at", "text")), strict=True):
                t, start = text.as_py(), at.as_py()
                p, n, total = boundaries(t)
                head, tail = p <= overlap, (p >= len(t) - overlap) & (p + 1 + len(tokens.SPECIAL) <= len(t))
                out.append({"k": k.as_py(), "i": i.as_py(), "total": total, "head_p": p[head] + start, "head_n": n[head], "tail_p": p[tail] + start, "tail_n": n[tail]})
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.string()), ("i", pa.int64()), ("total", pa.int64()), ("head_p", many), ("head_n", many), ("tail_p", many), ("tail_n", many)]))

    return rows


def _cutter(chunk: int, overlap: int):
    """A row (k, i, at, text) for each chunk of a text, by characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch["k"], batch["text"], strict=True):
                t = text.as_py()
                at = range(0, max(1, len(t) - overlap), chunk - overlap)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(at)), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.int64()), pa.array([t[x : x + chunk] for x in at], pa.string())], names=["k", "i", "at", "text"])

    return rows


def _spliced(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(k, n_tokens) of long texts (k, text), once each; n_tokens is null where some pair of chunks has no boundary."""
    many = "array<long>"
    chunks = texts.mapInArrow(_cutter(chunk, overlap), "k string, i long, at long, text string").groupBy("k", "i").agg(F.first("at").alias("at"), F.first("text").alias("text"))
    told = chunks.mapInArrow(_chunk_rows(overlap), f"k string, i long, total long, head_p {many}, head_n {many}, tail_p {many}, tail_n {many}")
    after = Window.partitionBy("k").orderBy("i")
    pairs = told.select("k", "i", "total", "tail_p", "tail_n", F.lead("head_p").over(after).alias("p"), F.lead("head_n").over(after).alias("n"))
    meet = F.array_min(F.array_intersect("tail_p", "p"))
    at = lambda ps, ns: F.get(ns, F.array_position(ps, meet).cast("int") - 1)
    # what the pair adds: the left chunk's tokens up to the boundary, less the right chunk's before it
    here = F.when(F.col("p").isNull(), F.col("total")).otherwise(at(F.col("tail_p"), F.col("tail_n")) - at(F.col("p"), F.col("n")))
    found = pairs.select("k", here.alias("n"))
    return found.groupBy("k").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def counted(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_counts, "doc_id long, n_bytes long, n_tokens long")
    texts = rows.where(is_long).select(F.md5("text").alias("k"), "text")
    done, left, size, over = None, texts, chunk, overlap
    while True:
        told = common.checkpoint(_spliced(left, size, over))
        done = told if done is None else done.where("n_tokens is not null").unionByName(told)
        open_ = told.where("n_tokens is null").select("k")
        if open_.isEmpty():
            break
        left, size, over = texts.join(open_, "k", "left_semi"), size * WIDER, over * WIDER
    long_ = rows.where(is_long).select("doc_id", "n_bytes", F.md5("text").alias("k")).join(done, "k").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(common.table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
