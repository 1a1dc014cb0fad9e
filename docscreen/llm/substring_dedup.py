"""Operator 3, substring dedup: hashes of every fixed-length word window are counted; repeated windows merge into
maximal removal intervals.

Words are the runs of bytes other than 20 and 09-0D (hex) of the UTF-8 text. A window is ``width`` consecutive words of
one document. A word goes if a window covers it whose word sequence also starts in a document with a smaller doc_id.

Plan. A mapper gathers slices of documents and hashes their windows with two Rabin-Karp polynomials over 64-bit word
hashes (80 bits are kept: at 10^13 windows fewer than a hundred pairs are expected to collide). What a slice can decide
it decides: of equal windows in it, only those of its smallest doc_id stay open, so a passage that a third of all
documents share leaves a slice once. Open windows go out as packed arrays, one row for each slice and bucket of hashes.
Every bucket, a part of the hash range so small that its windows fit in memory, finds windows whose smallest doc_id is another and
answers the slices with positions. A slice's answers merge into intervals for each of its texts, and a join on document
and text hash brings them to the texts.

Defined cases: null and empty texts have no words; documents of fewer words than a window lose nothing; rows with a null
doc_id are kept whole and remove nothing elsewhere; rows with equal doc_id don't act on each other; repeated rows get the
same result each; an empty table gives an empty table; further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm import common

WIDTH = 13
#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words that a batch of the mapper gathers before it hashes and sends them.
BATCH_WORDS = 1_000_000
#: Input bytes for each task and for each bucket; windows take some three times as many.
TASK_BYTES, BUCKET_BYTES = 8 << 20, 2 << 20

_SENT = "bucket int, slice long, kind int, payload binary"
#: Kinds of rows: open windows, windows that the slice has decided, the slice's table of texts.
OPEN, DECIDED, TEXTS = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() without an argument splits at 20, 09-0D and nothing else."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _hashes(digests: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp over the rows of (n, 2) word hashes: the two polynomials of the window starting at each row."""
    n = len(digests) - width + 1
    out = []
    for lane, base in enumerate(BASES):
        x = np.ascontiguousarray(digests[:, lane])
        h = x[:n].copy()
        for k in range(1, width):
            h *= np.uint64(base)
            h += x[k : k + n]
        out.append(h)
    return out[0], out[1]


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, "i8")


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """[first, end) of the runs of equal values."""
    starts = _runs(x)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(x)] if len(x) else [], strict=True)


def _planes(x: np.ndarray) -> bytes:
    """Steps between the values, byte by byte of significance, for the compressor."""
    return np.diff(x, prepend=0).astype("<i8").view("u1").reshape(-1, 8).T.tobytes()


def _values(raw: bytes, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(raw, "u1", 8 * n, at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel(), dtype="i8")


def _pack_places(row: np.ndarray, pos: np.ndarray) -> bytes:
    """Places (row of the slice, position), in order, as runs of rows and steps of position."""
    starts = _runs(row)
    runs = np.diff(np.r_[starts, len(row)])
    return np.array([len(row), len(starts)], "<u4").tobytes() + zlib.compress(_planes(row[starts]) + _planes(runs) + _planes(pos), 1)


def _unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    raw = zlib.decompress(blob[8:])
    return np.repeat(_values(raw, m, 0), _values(raw, m, 8 * m)), _values(raw, n, 16 * m)


def _pack(h: np.ndarray, low: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> bytes:
    """Hashes as they are (they don't compress), the runs' doc_ids, and the places."""
    ids = zlib.compress(_planes(doc[_runs(row)]), 1)
    head = np.array([len(h), len(ids)], "<u4").tobytes()
    return head + h.astype("<u8").tobytes() + low.astype("<u2").tobytes() + ids + _pack_places(row, pos)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, size = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    h, low = np.frombuffer(blob, "<u8", n, 8), np.frombuffer(blob, "<u2", n, 8 + 8 * n)
    row, pos = _unpack_places(blob[8 + 10 * n + size :])
    starts = _runs(row)
    ids = _values(zlib.decompress(blob[8 + 10 * n : 8 + 10 * n + size]), len(starts), 0)
    return h, low, np.repeat(ids, np.diff(np.r_[starts, len(row)])), row, pos


def _later(h: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that repeat: their indexes, and whether a smaller doc_id has the same window."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    some = order[np.r_[False, same] | np.r_[same, False]]
    if not len(some):
        return some, np.zeros(0, bool)
    some = some[np.lexsort((low[some], h[some]))]
    new = np.r_[True, (h[some][1:] != h[some][:-1]) | (low[some][1:] != low[some][:-1])]
    least = np.minimum.reduceat(doc[some], np.flatnonzero(new))
    return some, doc[some] > least[np.cumsum(new) - 1]


def _sender(width: int, buckets: int):
    def flush(docs: list[tuple[int, int]], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in parts])
        digests, ends = np.concatenate(parts), np.cumsum(sizes)
        row = np.repeat(np.arange(len(parts)), sizes)
        pos = np.arange(len(digests)) - np.repeat(ends - sizes, sizes)
        h, low = _hashes(digests, width)
        whole = np.flatnonzero(row[: len(h)] == row[width - 1 :])
        h, low, row, pos = h[whole], (low[whole] >> np.uint64(48)).astype("u2"), row[whole], pos[whole]
        texts = np.array(docs, "<i8")
        doc = texts[:, 0][row]
        some, later = _later(h, low, doc)
        gone = np.sort(some[later])
        # the same slice twice, in a table that repeats, has the same name and the same answers
        name = xxhash.xxh3_64_intdigest(texts.tobytes()) - (1 << 63)
        out = [(name % buckets, name, TEXTS, texts.tobytes())]
        if len(gone):
            out.append((name % buckets, name, DECIDED, _pack_places(row[gone], pos[gone])))
        keep = np.ones(len(h), bool)
        keep[gone] = False
        at = np.flatnonzero(keep)
        bucket = ((h[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("u4")
        order = np.argsort(bucket.astype("u2") if buckets < 1 << 16 else bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        for i, j in _stretches(bucket):
            x = at[i:j]
            out.append((int(bucket[i]), name, OPEN, _pack(h[x], low[x], doc[x], row[x], pos[x])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "slice", "kind", "payload"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, n = [], [], 0
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for d, k, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                words = words_of(text.as_py())
                if len(words) >= width:
                    docs.append((d.as_py(), k.as_py()))
                    parts.append(np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2))
                    n += len(words)
                if n >= BATCH_WORDS:
                    yield flush(docs, parts)
                    docs, parts, n = [], [], 0
                    common.given_back()
        if docs:
            yield flush(docs, parts)

    return rows


def _receiver(bucket: pd.DataFrame) -> pd.DataFrame:
    """One bucket: for each slice the places of windows that another document with a smaller doc_id has too.

    Rows that are no open windows pass.
    """
    passed = bucket["kind"] != OPEN
    out = list(bucket.loc[passed, ["slice", "kind", "payload"]].itertuples(index=False, name=None))
    names = bucket.loc[~passed, "slice"].to_numpy()
    packed = [_unpack(x) for x in bucket.loc[~passed, "payload"]]
    if packed:
        sizes = [len(x[0]) for x in packed]
        h, low, doc, row, pos = (np.concatenate(x) for x in zip(*packed, strict=True))
        del packed
        some, later = _later(h, low, doc)
        gone = np.sort(some[later])
        del h, low, doc, some, later
        of = np.repeat(np.arange(len(sizes)), sizes)[gone]
        for i, j in _stretches(of):
            out.append((names[of[i]], DECIDED, _pack_places(row[gone[i:j]], pos[gone[i:j]])))
        del row, pos, gone, of
    common.given_back()
    return pd.DataFrame(out, columns=["slice", "kind", "payload"])


def _merger(width: int):
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        """One slice: for each text that loses words, its maximal removal intervals."""
        texts = np.frombuffer(part.loc[part["kind"] == TEXTS, "payload"].iloc[0], "<i8").reshape(-1, 2)
        places = [_unpack_places(x) for x in part.loc[part["kind"] == DECIDED, "payload"]]
        out = []
        if places:
            row, pos = (np.concatenate(x) for x in zip(*places, strict=True))
            order = np.lexsort((pos, row))
            row, pos = row[order], pos[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + width)]
            first = np.flatnonzero(new)
            spans = np.stack([pos[first], pos[np.r_[first[1:], len(pos)] - 1] + width], axis=1)
            row = row[first]
            out = [(int(texts[row[i], 0]), int(texts[row[i], 1]), spans[i:j].astype("<u4").tobytes()) for i, j in _stretches(row)]
        return pd.DataFrame(out, columns=["doc_id", "text_hash", "spans"])

    return merge


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, spans): for each text that loses words, packed [first, end) intervals of words."""
    n = common.partitions(docs, TASK_BYTES)
    buckets = max(n, common.input_bytes(docs) // BUCKET_BYTES)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    sent = texts.mapInArrow(common.freeing(_sender(width, buckets)), _SENT)
    keys = common.even_keys(docs.sparkSession, n)
    sent = sent.withColumn("key", F.get(F.lit(keys), F.col("bucket") % n)).repartition(n, "key")
    told = sent.groupBy("key", "bucket").applyInPandas(_receiver, "slice long, kind int, payload binary")
    found = told.groupBy("slice").applyInPandas(_merger(width), "doc_id long, text_hash long, spans binary")
    return found.dropDuplicates(["doc_id", "text_hash"])


def kept(words: list[bytes], spans: bytes | None) -> list[bytes]:
    """The words outside all intervals."""
    if not spans:
        return words
    out, last = [], 0
    for i, j in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        out += words[last:i]
        last = j
    return out + words[last:]


def _with_removals(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """docs with one more column, their intervals or null, and its name."""
    d, h, spans = common.free(docs, "of_doc_id", "of_text_hash", "spans")
    found = common.written(removals(docs.select("doc_id", "text"), width), "removals").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("spans").alias(spans))
    return docs.join(found, (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(h)), "left").drop(d, h), spans


def removal_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""

    def rows(batches):
        for batch in batches:
            ids, out = [], []
            for d, text, spans in zip(batch["doc_id"], batch["text"], batch[name], strict=True):
                words = words_of(text.as_py())
                left = kept(words, spans.as_py())
                ids.append(d.as_py())
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    both, name = _with_removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return both.mapInArrow(common.freeing(rows), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all columns and rows, with the text of those that lose words rewritten: kept words joined by one space."""
    schema = docs.schema

    def rows(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"], batch[name], strict=True):
                t = text.as_py()
                if spans.as_py():
                    t = b" ".join(kept(words_of(t), spans.as_py())).decode("utf-8", "surrogatepass")
                texts.append(t)
            at = [f.name for f in schema].index("text")
            cols = [batch.column(i) for i in range(len(schema))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    both, name = _with_removals(docs, width)
    return both.mapInArrow(common.freeing(rows), T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(common.table(spark, sf_dir, "documents"))
