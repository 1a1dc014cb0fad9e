"""Operators on documents against brute force and the libraries, with nulls, empty, long and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docscreen.llm import common, license_scan, packing, sentencepiece, simhash_dedup, substring_dedup, token_counts, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choices(words, k=30))
    out = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.choice([1, 2, 12, 13, 14, 60])))
        if i % 4 == 0:
            t += "  " + passage + "\n"
        out.append((i, t))
    out += [(100, out[5][1]), (101, out[5][1]), (102, None), (103, ""), (104, " \t\n"), (105, passage + " " + passage), (106, "w1 " * 4000), (107, "é\x85 x")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def removed(rows, width=13):
    words = {i: (t or "").encode().split() for i, (_, t) in enumerate(rows)}
    first = {}
    for i, (d, _) in enumerate(rows):
        for k in range(len(words[i]) - width + 1):
            key = tuple(words[i][k : k + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        keep = [True] * len(words[i])
        for k in range(len(words[i]) - width + 1):
            if d is not None and first.get(tuple(words[i][k : k + width]), d) < d:
                keep[k : k + width] = [False] * width
        left = [w for w, x in zip(words[i], keep, strict=True) if x]
        out.append((d, len(words[i]), len(words[i]) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus() + [(None, corpus()[0][1]), (100, "another text under a known id " + corpus()[0][1])]
    got = [tuple(r) for r in substring_dedup.removal_digest(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(removed(rows), key=key)


def test_substring_dedup_rewrites_texts_and_keeps_columns(spark):
    df = frame(spark, corpus()).withColumn("text_hash", F.lit(1)).withColumn("spans", F.lit("x"))
    out = substring_dedup.deduplicated(df)
    assert out.columns == df.columns
    want = {d: h for d, _, _, h in removed(corpus())}
    assert all(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id] for r in out.collect())


def test_small_batches_and_buckets_decide_alike(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 50)
    got = sorted(tuple(r) for r in substring_dedup.removal_digest(frame(spark, corpus(2)).repartition(3)).collect())
    assert got == sorted(removed(corpus(2)))


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def near_corpus():
    rng = random.Random(4)
    base = rng.choices([f"w{i}" for i in range(500)], k=400)
    rows = corpus(3)
    for i in range(30):
        t = list(base)
        t[rng.randrange(400)] = "changed"
        rows.append((200 + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("limit", [4000, 4])
def test_simhash_components_equal_brute_force(spark, limit):
    rows = near_corpus()
    fp = {d: brute_fingerprint(t) for d, t in rows}
    root = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = simhash_dedup.near_duplicates(frame(spark, rows), limit).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def test_simhash_keeps_one_of_each_group_and_null_ids(spark):
    rows = corpus() + [(None, "a"), (None, "a")]
    kept = simhash_dedup.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (100, 101)").count() == 0


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(0)
    f = np.unique(rng.integers(0, 1 << 13, 800).astype("u8") << np.uint64(40))
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    root = np.arange(len(f))
    while not (low := np.where(near, root[None], len(f)).min(1) == root).all():
        root = np.where(near, root[None], len(f)).min(1)
    assert (simhash_dedup.trie_join(f) == root).all() and low.all()


ODD = ["a" * 5000 + " b " + "c" * 9000, " " * 7000 + "x" + " " * 7000, "word <|endoftext|>  " * 900, "é" * 4001 + " text " * 2000, "<|endoftext|>" * 800, "  \n\n  <|endoftext|> a'll b's " * 500]


def test_token_counts_of_chunked_texts_equal_the_library(spark):
    rows = list(enumerate(ODD)) + corpus()[6:] + [(None, "abc"), (3, ODD[3])]
    got = token_counts.counted(frame(spark, rows), chunk=1000, overlap=60).collect()
    want = sorted(((d, len((t or "").encode()), len(tokens.library().encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_the_short_way_agrees_with_the_library():
    contexts = ("{}", "a{}", "{}a", "a {}b", "  {} ", "1{}2", "'{}", "{}{}", "\n{}\n", "!{}!", "x  {}  y")
    for c in map(chr, range(0x250)):
        for k in contexts:
            t = k.replace("{}", c)
            assert not tokens.agrees(t) or tokens.ids(t).tolist() == tokens.library().encode(t, add_special_tokens=False).ids, t
    assert not tokens.agrees("<|endoftext|>") and not tokens.agrees("日") and not tokens.agrees("a" * 1000)


@pytest.mark.parametrize("partition", [10_000, 20])
def test_packing_is_whole_and_valid(spark, partition):
    rows = corpus() + list(enumerate(ODD, 300))
    got = packing.packed(frame(spark, rows), partition_pieces=partition).toPandas()
    for d, t in rows:
        ids = np.append(np.array(tokens.library().encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and (own.piece == range(len(own))).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all() and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 1024) + 2


def test_lower_bounds_hold_and_beat_the_volume():
    assert packing.lower_bound(np.array([600] * 5), 1000) == 5 and packing.lower_bound(np.array([], "i8"), 10) == 0
    assert packing.lower_bound(np.array([334] * 6), 1000) == 3
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.integers(1, 100, 40)
        assert packing.lower_bound(x, 100) <= len(packing.best_fit(x, 100)[2])


def hostile():
    rng = random.Random(1)
    letters = "abcdefghij  \n\t.,'éüß日本👍0123456789=-_"
    pieces = [p for p, _, _ in sentencepiece.piece_rows()]
    own = ["  lead and  trail  ", "a\tb\n\nc", "日本語 テスト €", "x" * 500 + " y", "", None, "    ", "é " * 20, "The quick brown fox, again.", " " * 3000 + "x" + " " * 700, "a" * 3000, "日本語" * 400, "▁▁a▁b", "\x00a\x00", "😀👍🏽 \u200d", "ab" * 999 + "  " + "=-" * 300]
    own += ["".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(200)]
    return own + ["".join(rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(200)]


def test_sentencepiece_equals_the_library_and_decodes(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece, "BLOCK_CHARS", 500)
    sp, texts = sentencepiece.library(), hostile()
    rows = [*enumerate(texts), (1, texts[1]), (None, texts[2])]
    df = spark.createDataFrame([(d, t, "kept", [7]) for d, t in rows], "doc_id long, text string, n_tokens string, ids array<int>")
    out = sentencepiece.encoded(df).withColumn("back", sentencepiece.decoded(F.col("ids"))).collect()
    assert sorted(((r.doc_id, r.text, r.ids) for r in out), key=key) == sorted(((d, t, sp.encode(t or "")) for d, t in rows), key=key)
    assert all(r.back == (r.text or "").replace("▁", " ") == sp.decode(r.ids) and r.n_tokens == "kept" for r in out)


def test_decoding_equals_the_library_on_any_ids(spark):
    sp, rng = sentencepiece.library(), random.Random(3)
    lists = [[rng.randrange(259, sp.get_piece_size()) for _ in range(n)] for n in (0, 1, 2, 5, 40)] + [[0], [1, 2], [29871, 29871], [3 + 0xE6, 3 + 0x97, 3 + 0xA5], [3 + 0xFF]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", sentencepiece.decoded(F.col("ids")).alias("t")).collect()}
    assert got == {i: sp.decode(x) for i, x in enumerate(lists)}


def test_long_segments_fold_over_a_heap_alike(monkeypatch):
    words = [w for t in hostile() for w in sentencepiece.words_of(t)]
    want = [x.tolist() for x in sentencepiece.pieces().encode(words)]
    monkeypatch.setattr(sentencepiece, "ROUNDS", 1)
    assert [x.tolist() for x in sentencepiece.pieces().encode(words)] == want


def test_viterbi_takes_the_best_sum(spark):
    pieces = [("▁", 1, -2.0), ("a", 2, -1.0), ("b", 3, -1.0), ("ab", 4, -1.5), ("▁a", 5, -0.1), ("bc", 6, -9.0)]
    table = spark.createDataFrame(pieces, "piece string, id int, score double")
    words = spark.createDataFrame([("▁ab",), ("▁abc",), ("▁b",)], "word string")
    got = {r.word: r.ids for r in sentencepiece.unigram_words(words, table, 4).collect()}
    assert got == {"▁ab": [5, 3], "▁abc": [5, 6], "▁b": [1, 3]}


def test_licenses_are_found_by_containment(spark):
    mit = dict(license_scan.TEMPLATES)["mit-notice"]
    rows = [(1, "x " * 300 + mit + " y" * 50), (2, "Released under the MIT License. some text here"), (3, "released under something else entirely"), (4, None), (5, ""), (6, mit[: len(mit) // 2]), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-notice"): 1.0, (2, "mit-line"): 1.0, (None, "cc-by-nc-4.0-line"): 1.0}


def test_toxicity_learns_and_is_held_out(spark):
    d = "/root/testdata/sf0.1"  # 825 held-out labels, 97 of them toxic; sf0.01 has 6
    out = toxicity.op10_toxicity(spark, d).collect()
    toxic = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in out if r.held_out and r.doc_id in toxic]
    hits = sum(p and t for p, t in held)
    assert hits / sum(p for p, _ in held) > 0.8 and hits / sum(t for _, t in held) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_toxicity_without_labels_scores_zero(spark):
    docs = frame(spark, [(1, None), (2, "")])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0, 0.0]


EMPTY = [
    lambda d: substring_dedup.removal_digest(d),
    lambda d: simhash_dedup.near_duplicates(d),
    lambda d: token_counts.counted(d),
    lambda d: packing.packed(d),
    lambda d: sentencepiece.encoded(d),
    lambda d: license_scan.scanned(d),
]


@pytest.mark.parametrize("f", EMPTY)
def test_an_empty_table_gives_an_empty_table(spark, f):
    assert f(frame(spark, [(1, "x")]).where("doc_id = 2")).count() == 0


def test_the_last_round_closes_gaps_of_best_fit():
    lengths = np.array([4, 4, 3, 3, 3, 3])
    assert len(packing.best_fit(lengths, 10)[2]) == 3 and packing.lower_bound(lengths, 10) == 2
    got = packing._packer(10, True)((0,), pd.DataFrame({"pid": range(6), "length": lengths}))
    assert got["bin"].nunique() == 2 and not got["open"].any()
    for _, one in got.sort_values("offset").groupby("bin"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum()[:-1]] and one["length"].sum() <= 10


def test_ids_are_returned_in_small_batches(monkeypatch):
    """A batch of many words comes back in parts, in its order and whole."""
    monkeypatch.setattr(sentencepiece, "TOLD_WORDS", 50, raising=False)
    texts = ["a b c " * 30, None, "", "x", "word " * 200, *["some words"] * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = list(sentencepiece._encoder(sentencepiece.MODEL, 0, ["text"])(iter([batch])))
    assert max(sum(len(sentencepiece.words_of(t)) for t in x["text"].to_pylist()) for x in out if x.num_rows > 1) <= 50 and len(out) > 3
    assert [t for x in out for t in x["text"].to_pylist()] == texts
    library = sentencepiece.library()
    assert [i for x in out for i in x["ids"].to_pylist()] == [library.encode(t or "") for t in texts]
