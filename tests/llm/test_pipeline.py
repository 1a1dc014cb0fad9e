"""corpus_pipeline.run against brute force, stage by stage."""

import random
import zlib

import numpy as np

import corpus_pipeline
from docscreen.llm import packing, tokens, toxicity
from tests.llm.test_text_operators import brute_fingerprint


def table(n=90):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    bad = ["vile", "awful", "rotten"]
    passage = " ".join(rng.choices(words, k=40))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        t = rng.choices(words, k=rng.choice([20, 60, 200]))
        if toxic:
            t[3:3] = bad
        rows.append((i, " ".join(t) + ("\t" + passage if i % 5 == 1 else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1]), (201, rows[1][1] + " w1"), (202, rows[4][1]), (202, rows[4][1]), (203, None), (204, ""), (205, "w " * 5000), (206, passage + " " + passage)]
    return rows, labels


def without_copies(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if root[a] != root[b] and ((fp[a] ^ fp[b]).bit_count() <= 3 or rows[a][0] == rows[b][0]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for r, (d, t) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, (d, t)), (d, t), key=lambda x: x[0])
    return sorted(least.values(), key=lambda x: x[0])


def without_repeats(rows, width=13):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), d), d)
    out = []
    for (d, t), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < d:
                keep[k : k + width] = [False] * width
        out.append((d, t if all(keep) else b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels = table()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    model = toxicity.fit(docs, marks)
    left = [r for r in rows if model.score(r[1]) < 0.5]
    assert 0 < len(rows) - len(left) < len(rows) / 2
    want = without_repeats(without_copies(left))
    assert {d for d, _ in want} == set(got.doc_id)
    pieces = set()
    for d, t in want:
        ids = np.append(np.array(tokens.library().encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")
        n = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - 1024 * k for k in range(n - 1, -1, -1))]
        pieces |= {(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == pieces and len(got) == len(pieces)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() == packing.lower_bound(got.length.to_numpy(), 1024)


def test_stages_are_named_in_order_and_empty_tables_pass(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "substring_dedup", "best_fit_packing"]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_gives_its_memory_back(monkeypatch):
    """After its last batch, and only then; the batches are those of the function."""
    from docscreen.llm import common

    told = []
    monkeypatch.setattr(common, "given_back", lambda: told.append(True))
    for i, x in enumerate(common.freeing(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))):
        assert x == 2 * (i + 1) and not told
    assert told == [True]
