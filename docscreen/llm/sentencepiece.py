"""Operator 1, SentencePiece encoding and decoding as a relational lattice.

A text's words are its runs "spaces, then the rest", with spaces written as U+2581 and one in front of the text; no piece
goes over such a border (models with one that does are refused). The bounded substrings of words meet the piece table;
the matches are a lattice's edges, grouped by word and folded.

- Unigram models, ``unigram_words``: Spark explodes the substrings, equi-joins them to the broadcast piece table, groups
  the edges by word, and Viterbi is a higher-order ``aggregate`` from position to position.
- BPE models, ``encoded`` and the query. Sums of scores don't order BPE's results, so Viterbi can't give the library's
  ids; the edges are folded by merges instead: of two neighbouring symbols that an edge spans, always those of the best
  score, from the left. A Spark lattice of the corpus's words, folded by ``aggregate``, costs more than the limits allow
  (README), so here the same joins run on columns of numpy in Arrow batches: a substring goes on to its next character
  only while some piece begins with it (an equi-join of (node, character) with the pieces' trie, with exact keys), and
  all words of a batch merge at once, each in rounds. Borders that no edge spans part a word into segments, which merge
  apart. Segments that don't settle in ROUNDS rounds (very long ones) are folded over a heap. Words are encoded once for
  each BATCH_WORDS different ones. Nothing is shuffled, collected or sampled; no word leaves the lattice.

Characters without a piece become their bytes' pieces. ``decoded`` gives the text of an ids column in Spark expressions.

Defined cases: null and empty texts have no ids and decode to the empty text; a text of any length is encoded whole; rows
are encoded each for itself, so null and repeated doc_ids stay as often as they come; an empty table gives an empty
table; further columns are kept by ``encoded``, but for one named as its results, which is replaced.
"""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm import common

MODEL, SPACE = "piece_bpe_32k.model", "▁"
#: Different words, all words and characters that a batch gathers; words of rows that are returned at a time; characters
#: whose lattice is held at a time.
BATCH_WORDS, BATCH_ALL, BATCH_CHARS, TOLD_WORDS, BLOCK_CHARS = 100_000, 1_000_000, 8 << 20, 100_000, 75_000
ROUNDS = 48
NEVER = np.iinfo("i4").max


@functools.cache
def library(model: str = MODEL):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def piece_rows(model: str = MODEL) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the pieces that text can match, and none for control and byte pieces."""
    sp = library(model)
    rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in rows):
        raise ValueError("a piece goes over the border of a word")
    return rows


def byte_base(model: str = MODEL) -> int:
    """The id of the piece for byte 0; bytes have consecutive ids."""
    return library(model).piece_to_id("<0x00>")


def words_of(text: str | None) -> list[str]:
    """A text's words: spaces as U+2581, one in front; a border before each run of them."""
    if not text:
        return []
    parts = text.replace(" ", SPACE).split(SPACE)
    if all(parts):
        return [SPACE + p for p in parts]
    out, lead = [], 0
    for p in parts:
        lead += 1
        if p:
            out.append(SPACE * lead + p)
            lead = 0
    return [*out, SPACE * lead] if lead else out


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): the pieces (piece, id, score) that match a word's substrings, as sorted structs of score, s, e, id.

    words is distinct in its column word; a word without any edge is returned too.
    """
    n = F.length("word")
    # each word's first span is empty and joins to an empty piece, whose edge is null and not collected: no word is lost
    spans = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).select("word", "s", F.explode(F.sequence(F.when(F.col("s") == 0, 0).otherwise(1), F.least(n - F.col("s"), F.lit(longest)))).alias("l"))
    subs = spans.select("word", "s", (F.col("s") + F.col("l")).alias("e"), F.substring("word", F.col("s") + 1, F.col("l")).alias("piece"))
    table = pieces.unionByName(pieces.sparkSession.createDataFrame([("",)], "piece string"), allowMissingColumns=True)
    edges = subs.join(F.broadcast(table), "piece").select("word", F.when(F.col("id").isNotNull(), F.struct("score", "s", "e", "id")).alias("x"))  # a model's pieces
    return edges.groupBy("word").agg(F.sort_array(F.collect_list("x")).alias("edges"))


def viterbi(lattices: DataFrame, unknown: int, penalty: float = 10.0) -> DataFrame:
    """(word, ids) by the greatest sum of scores; a character that no piece covers costs the worst score and penalty."""
    ready = lattices.withColumn("worst", F.expr(f"aggregate(edges, 0D, (w, x) -> least(w, cast(x.score AS double))) - {penalty}D"))
    edges = f"concat(transform(filter(edges, x -> x.e = i), x -> struct(cast(x.score AS double) AS w, x.s AS s, x.id AS id)), IF(exists(edges, x -> x.s = i - 1 AND x.e = i), array(), array(struct(worst AS w, i - 1 AS s, {unknown} AS id))))"
    step = f"array_append(best, array_max(transform({edges}, t -> struct(best[t.s].w + t.w AS w, concat(best[t.s].ids, array(t.id)) AS ids))))"
    fold = f"aggregate(sequence(1, length(word)), array(struct(0D AS w, cast(array() AS array<int>) AS ids)), (best, i) -> {step})"
    return ready.select("word", F.expr(f"element_at({fold}, -1).ids").alias("ids"))


def unigram_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: int = 0) -> DataFrame:
    """(word, ids) of distinct words by a unigram model's pieces (piece, id, score)."""
    return viterbi(lattice(words, pieces, longest), unknown)


class Pieces:
    """A BPE model's pieces as a trie: child() is the equi-join of (node, character); node 0 is no string at all."""

    BITS, EMPTY = 18, np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, rows: list[tuple[str, int, float]], base: int):
        self.base, self.longest = base, max(len(r[0]) for r in rows)
        order = {x: k for k, x in enumerate(sorted({-r[2] for r in rows}))}
        nodes: dict[str, int] = {"": 0}
        for p, _, _ in rows:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        while len(nodes) * 4 > 1 << self.BITS:
            self.BITS += 1
        self.id, self.rank = np.full(len(nodes), -1, "i4"), np.full(len(nodes), NEVER, "i4")
        for p, i, score in rows:
            self.id[nodes[p]], self.rank[nodes[p]] = i, order[-score]
        of = {p: order[-score] for p, _, score in rows}
        # merges to a piece may be made at once in a segment unless a piece that begins or ends with it merges no later
        self.alone = np.zeros(len(nodes), bool)
        for z, r in of.items():
            for k in range(1, len(z)):
                for y in (z[:k], z[k:]):
                    if of.get(y, -1) >= r:
                        self.alone[nodes[y]] = True
        self.first = np.zeros(0x110000, "i4")
        keys, values = np.full(1 << self.BITS, self.EMPTY, "u8"), np.zeros(1 << self.BITS, "i4")
        for p, node in nodes.items():
            if len(p) == 1:
                self.first[ord(p)] = node
            elif p:
                key = (nodes[p[:-1]] << 21) | ord(p[-1])
                at = self._slot(key)
                while keys[at] != self.EMPTY:
                    at = (at + 1) & (len(keys) - 1)
                keys[at], values[at] = key, node
        self.keys, self.values = keys, values

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node of each node's string and one more character, or 0."""
        key = (node.astype("u8") << np.uint64(21)) | char
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype("i8")
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], 0)
        open_ = np.flatnonzero((seen != key) & (seen != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            out[open_] = np.where(seen == key[open_], self.values[at[open_]], 0)
            open_ = open_[(seen != key[open_]) & (seen != self.EMPTY)]
        return out

    def edges(self, chars: np.ndarray, end: np.ndarray) -> np.ndarray:
        """node[l - 1, s] of the substring of l characters from s, or 0; end is where s's word ends."""
        n = len(chars)
        out = np.zeros((self.longest, n), "i4")
        out[0] = self.first[chars]
        at = np.flatnonzero(out[0])
        node = out[0][at]
        for l in range(2, self.longest + 1):
            inside = at + l <= end[at]
            at, node = at[inside], node[inside]
            node = self.child(node, chars[at + l - 1])
            found = node != 0
            at, node = at[found], node[found]
            if not len(at):
                break
            out[l - 1, at] = node
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin (one more than words)."""
        parts, sizes, i = [], [np.zeros(1, "i8")], 0
        while i < len(words):
            j, n = i, 0
            while j < len(words) and (j == i or n + len(words[j]) <= BLOCK_CHARS):
                n += len(words[j])
                j += 1
            ids, count = self._block(words[i:j])
            parts.append(ids)
            sizes.append(count)
            i = j
        return np.concatenate(parts) if parts else np.zeros(0, "i4"), np.cumsum(np.concatenate(sizes))

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), "i8", len(words))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        lat = self.edges(chars, np.repeat(ends, lengths))
        size = self.merged(lat, begins)
        at = np.flatnonzero(size)
        ids = self.id[lat[size[at] - 1, at]]
        word = np.searchsorted(ends, at, "right")
        lost = np.flatnonzero(ids < 0)
        n = np.ones(len(ids), "i8")
        if len(lost):  # characters without a piece: their bytes
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[at[lost]].tolist()]
            n[lost] = [len(x) for x in raw]
            to = np.cumsum(n) - n
            out = np.empty(n.sum(), "i4")
            out[to] = ids
            inside = np.repeat(to[lost], n[lost]) + np.concatenate([np.arange(len(x)) for x in raw])
            out[inside] = np.frombuffer(b"".join(raw), "u1").astype("i4") + self.base
            ids = out
        return ids, np.bincount(word, n, len(words)).astype("i8")

    def merged(self, lat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The fold: at each symbol's first character its length, elsewhere 0."""
        n = lat.shape[1]
        rank = self.rank
        # borders that some edge goes over; all others part segments
        over = np.zeros(n + 1, "i4")
        for l in range(2, len(lat) + 1):
            s = np.flatnonzero(rank[lat[l - 1]] != NEVER)
            over[s + 1] += 1
            over[s + l] -= 1
        cut = np.cumsum(over[:n]) == 0
        cut[begins] = True
        final = np.ones(n, "i4")
        sym = np.arange(n)
        seg = np.cumsum(cut) - 1
        many = np.bincount(seg)[seg] > 1
        sym, seg = sym[many], seg[many]
        size = np.ones(len(sym), "i4")

        def pair(i: np.ndarray) -> np.ndarray:
            """The node that joins symbol i and the next, or 0."""
            out = np.zeros(len(i), "i4")
            ok = i + 1 < len(sym)
            ok[ok] = seg[i[ok]] == seg[i[ok] + 1]
            j = i[ok]
            both = size[j] + size[j + 1]
            out[ok] = np.where(both <= len(lat), lat[np.minimum(both, len(lat)) - 1, sym[j]], 0)
            return out

        node = pair(np.arange(len(sym)))
        for turn in range(ROUNDS + 1):
            if not len(sym):
                break
            r = rank[node]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            count = np.diff(np.r_[first, len(seg)])
            best = np.minimum.reduceat(r, first)
            live = best != NEVER
            if not live.all():  # settled segments leave
                stay = np.repeat(live, count)
                gone = ~stay
                final[sym[gone]] = size[gone]
                sym, seg, size, node, r = (x[stay] for x in (sym, seg, size, node, r))
                best, count = best[live], count[live]
                if not len(sym):
                    break
                first = np.cumsum(count) - count
            if turn == ROUNDS:
                for i, j in zip(first.tolist(), (first + count).tolist(), strict=True):
                    self._heaped(lat, sym[i:j].tolist(), size[i:j].tolist(), final)
                break
            hit = r == np.repeat(best, count)
            at = np.flatnonzero(hit)
            own = np.repeat(np.arange(len(first)), count)[at]
            lead = np.r_[True, own[1:] != own[:-1]]
            follows = np.r_[False, at[1:] == at[:-1] + 1]
            at = at[lead | ~(self.alone[node[at]] | follows)]
            drop = np.zeros(len(sym), bool)
            drop[at + 1] = True
            size[at] += size[at + 1]
            final[sym[at + 1]] = 0
            place = np.cumsum(~drop) - 1
            keep = ~drop
            sym, seg, size, node = sym[keep], seg[keep], size[keep], node[keep]
            at = place[at]
            node[at] = pair(at)
            before = at[at > 0] - 1
            node[before] = pair(before)
        return final

    def _heaped(self, lat: np.ndarray, sym: list[int], size: list[int], final: np.ndarray) -> None:
        """The same fold of one long segment: the best pair from a heap, stale ones passed over."""
        after = [*range(1, len(sym)), -1]
        before = [-1, *range(len(sym) - 1)]

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (both := size[i] + size[j]) <= len(lat) and (r := int(self.rank[lat[both - 1, sym[i]]])) != NEVER:
                heapq.heappush(heap, (r, sym[i], i, size[i], j, size[j]))

        heap: list[tuple] = []
        for i in range(len(sym)):
            push(i)
        while heap:
            _, _, i, a, j, b = heapq.heappop(heap)
            if size[i] != a or size[j] != b or after[i] != j:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        final[np.array(sym)] = size


@functools.cache
def pieces(model: str = MODEL) -> Pieces:
    return Pieces(piece_rows(model), byte_base(model))


def _encoder(model: str, at: int, names: list[str]):
    """Adds ids to each batch of rows; at is the column of texts."""

    def told(batches: list[pa.RecordBatch], words: dict[str, int], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, begin = pieces(model).encode(list(words))
        k = 0
        for batch in batches:
            own = places[k : k + batch.num_rows]
            k += batch.num_rows
            sizes = np.cumsum([0, *map(len, own)])
            i = 0
            while i < len(own):  # ids take many times the bytes of texts: some rows at a time
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + TOLD_WORDS, "right")) - 1)
                w = np.concatenate(own[i:j])
                n = begin[w + 1] - begin[w]
                flat = ids[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                ends = np.r_[0, np.cumsum(n)][sizes[i : j + 1] - sizes[i]]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[*names, "ids"])
                i = j
        pa.default_memory_pool().release_unused()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            d: defaultdict = defaultdict()
            d.default_factory = d.__len__
            return d

        held, words, places, n, chars, start = [], fresh(), [], 0, 0, 0
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(at)):
                t = text.as_py()
                own = words_of(t)
                places.append(np.fromiter(map(words.__getitem__, own), "i4", len(own)))
                n += len(own)
                chars += len(t or "")
                if len(words) >= BATCH_WORDS or n >= BATCH_ALL or chars >= BATCH_CHARS:
                    held.append(batch.slice(start, i + 1 - start))
                    yield from told(held, words, places)
                    held, words, places, n, chars, start = [], fresh(), [], 0, 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from told(held, words, places)

    return rows


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with ids, an array: every row's whole text in the model's ids."""
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encoder(model, docs.columns.index("text"), docs.columns), schema)


@functools.cache
def _surfaces(model: str) -> str:
    """What each id stands for, as hexadecimal UTF-8, by commas."""
    sp = library(model)

    def surface(i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([i - byte_base(model)])
        return b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).encode()

    return ",".join(surface(i).hex() for i in range(sp.get_piece_size()))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of ids: pieces and bytes joined, U+2581 as a space, the first of them dropped. Bytes that
    are no UTF-8 become U+FFFD; ids that the model hasn't stand for nothing; null for null."""
    table = F.split(F.lit(_surfaces(model)), ",")
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
    return F.replace(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), f"^{SPACE}", ""), F.lit(SPACE), F.lit(" "))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the ids decode to the text; U+2581 in a text is a space) of every row."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    return encoded(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (decoded(F.col("ids")) == text).alias("round_trip"))
