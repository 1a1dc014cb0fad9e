"""Every operator and stage on empty tables, clashing columns, null and repeated ids, and very long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docscreen.llm import ann, common, embedding_dedup, license_scan, packing, sentencepiece, simhash_dedup, substring_dedup, token_counts, tokens, toxicity, url_filter

#: Names that operators use for columns of their own, with values that no operator may read.
CLASHES = ("fp", "uid", "node", "component", "kept", "of_doc_id", "of_text_hash", "spans", "__spans", "__doc_id", "text_hash", "k", "i", "at", "n_tokens", "score", "predicted", "flagged", "ids", "pid", "length", "h", "t", "c", "w", "license", "toxic", "part", "rule", "own", "__node", "host", "label_", "m", "n", "v", "cid")
LONG = "word " * 60_000
TEXTS = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (None, "alpha beta gamma delta"), (None, "another text without an id"), (3, ""), (4, LONG), (5, LONG), (6, " \t\n"), (6, "a second text of a known id")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.001]), (5, [0.0, 1.0])]
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")


def pages(spark):
    rows = [(1, "http://x.com/de/1", None), (1, "http://x.com/de/1", None), (None, "http://y.net/", "<link rel=canonical href=http://x.com/de/1>"), (2, None, "<link rel=canonical href=/a>"), (3, "", ""), (4, "http://z.net/", "<p>" * 100_000 + "<meta http-equiv=refresh content='0;url=http://x.com/de/1'>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


MODEL = toxicity.train(["bad vile words", "good kind words"] * 4, [1, 0] * 4, ["en"] * 8)
OPERATORS = {
    "op1": (docs, lambda d: sentencepiece.encoded(d).select("doc_id", "text", F.size("ids"))),
    "op2": (docs, token_counts.counted),
    "op3": (docs, substring_dedup.removal_digest),
    "op4": (docs, license_scan.scanned),
    "op5": (docs, simhash_dedup.near_duplicates),
    "op6": (vectors, embedding_dedup.linked),
    "op7": (docs, lambda d: packing.packed(d).select("doc_id", "piece", "start", "length", "ids_crc32")),
    "op8": (vectors, lambda d: ann.searched(d, d)),
    "op9": (pages, url_filter.judged),
    "op10": (docs, lambda d: toxicity.scored(d, MODEL).select("doc_id", "text", "score", "predicted")),
    "stage toxicity": (docs, lambda d: toxicity.clean(d, MODEL).select("doc_id", "text")),
    "stage simhash": (docs, lambda d: simhash_dedup.deduplicated(d).select("doc_id", "text")),
    "stage substring": (docs, lambda d: substring_dedup.deduplicated(d).select("doc_id", "text")),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


def clashing(df):
    return df.withColumns({x: F.lit("theirs") for x in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    make, f = OPERATORS[name]
    assert rows_of(f(clashing(make(spark)))) == rows_of(f(make(spark)))


@pytest.mark.parametrize("name", ["op6", "op8", "op9", "op10", "stage toxicity", "stage simhash", "stage substring"])
def test_an_empty_table_gives_an_empty_table(spark, name):
    make, f = OPERATORS[name]
    assert f(make(spark).where("false")).count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    d = clashing(docs(spark))
    for out in (toxicity.clean(d, MODEL), simhash_dedup.deduplicated(d), substring_dedup.deduplicated(d)):
        assert out.columns == d.columns and out.select([F.max(c) for c in CLASHES]).first() == tuple("theirs" for _ in CLASHES)


def test_a_doc_id_with_two_texts_is_one_node(spark):
    d = spark.createDataFrame([(1, "a b c"), (5, "q r s t u"), (5, "a b c"), (7, "q r s t u"), (None, "a b c"), (None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.near_duplicates(d).collect()}
    assert {c for (i, _), c in got.items() if i in (1, 5, 7)} == {1} and got[(None, next(f for i, f in got if i == 1))] == 1
    assert sorted(map(str, (r.doc_id for r in simhash_dedup.deduplicated(d).collect()))) == ["1", "None"]


@pytest.mark.parametrize("limit", [3, 20])
def test_large_groups_go_down_levels_and_lose_no_link(spark, monkeypatch, limit):
    rng = np.random.default_rng(3)
    # one block alike for all, others close: groups stay large for several levels
    f = np.unique(np.r_[rng.integers(0, 1 << 12, 150).astype("u8") << np.uint64(30), rng.integers(0, 1 << 20, 100).astype("u8")])
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    root = np.arange(len(f))
    while not (low := np.where(near, root[None], len(f)).min(1) == root).all():
        root = np.where(near, root[None], len(f)).min(1)
    fps = spark.createDataFrame([(int(x),) for x in f.view("i8")], "fp long")
    found = {r.node: r.component for r in common.components(simhash_dedup.links(fps, limit)).collect()}
    least = {}
    for x, r in zip(f.tolist(), root.tolist(), strict=True):
        least.setdefault(found.get(x, x), set()).add(r)
    assert low.all() and all(len(v) == 1 for v in least.values()) and len(least) == len(set(root.tolist()))


def test_masks_split_what_is_left():
    for level in simhash_dedup.masks():
        assert len(level) == 4 ** (simhash_dedup.masks().index(level) + 1) and all(0 < x < 1 << 64 for x in level)


def test_rules_of_any_number_judge_alike(spark, monkeypatch):
    rules = [*url_filter.RULES, ("block", "a.org", "/x/"), ("allow", "a.org", "/x/"), ("block", "net", "/")]
    urls = ["http://www.example.org/es/1", "http://a.org/x/y", "http://b.a.org/x/", "http://com/de/", "http://q.net/z", "http://net", "nohost", None, "http://x.com/fr/"]
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    want = rows_of(url_filter.judged(d, rules))
    monkeypatch.setattr(url_filter, "UNROLLED", 2)
    assert rows_of(url_filter.judged(d, rules)) == want and any("a.org/x/" in x and "allow" in x for x in want)


def test_nodes_and_tags_in_other_forms(spark):
    link = lambda rel, to: f'<link rel="{rel}" href="{to}">'
    rows = [
        (1, "http://a.net/1", link("alternate canonical", "http://x.com/de/1")),
        (2, "HTTP://B.net/p/q/../r/./s", ""), (3, "http://x.com/de/2", link("canonical", "http://b.NET/p/r/s")),
        (4, "http://c.net/a/..", ""), (5, "http://x.com/de/3", link("canonical", "http://c.net/")),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(1, 6)}


def brute_containment(text, template):
    import re

    def shingles(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    have, want = shingles(text), set(shingles(template))
    n = 1 << (len(want).bit_length())
    return max((len(want & set(have[i : i + 2 * n])) / len(want) for i in range(max(1, len(have)))), default=0.0)


def test_licenses_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(50)]
    for i, (_, t) in enumerate(license_scan.TEMPLATES * 6):
        w = t.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        at = rng.randrange(len(w))
        w[at:at] = rng.choices(words, k=rng.choice([0, 0, 5]))
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(0, 300)) + w + rng.choices(words, k=rng.randrange(0, 90)))))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = {(d, name): c for d, text in rows for name, t in license_scan.TEMPLATES if (c := brute_containment(text, t)) >= 0.8}
    # a window is somewhat longer than the stretch that the brute force looks at, so it may hold more of a template
    assert set(sure) <= set(got) and all(got[k] >= c - 1e-9 for k, c in sure.items()) and all(c >= 0.8 for c in got.values())
    assert len(sure) > 30


def test_templates_are_a_table_too_and_short_ones_are_refused(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    table = spark.createDataFrame([("x", "One two, three four five!")], "license string, text string")
    assert [(r.doc_id, r.license) for r in license_scan.scanned(d, table).collect()] == [(1, "x")]
    with pytest.raises(Exception, match="under five words"):
        license_scan.scanned(d, [("y", "only four words here")]).collect()


def test_packing_says_what_is_certified(spark):
    got = packing.packed(docs(spark)).toPandas()
    lengths = got.length.to_numpy()
    assert got.certified.all() and got.sequence_id.nunique() == packing.lower_bound(lengths, 1024)


def test_copies_of_a_long_text_are_chunked_once(spark):
    rows = [(i, LONG + " end") for i in range(8)]
    want = len(tokens.library().encode(LONG + " end", add_special_tokens=False).ids)
    assert [r.n_tokens for r in token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [want] * 8


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d: d)})

    class Scala:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return type("O", (), {"isDefined": staticmethod(lambda: False)})

    Context._jsc = Scala()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_samples_are_bounded_and_pass_over_what_does_not_fit(spark):
    d = spark.createDataFrame([(i, "x" * (10 * i + 10)) for i in range(40)] + [(3, "another")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.sample(d, marks, sample_docs=30, sample_bytes=2000, text_bytes=300)
    assert got and len(got) <= 30 and all(len(t) <= 300 for t, _, _ in got)
    assert all(sum(len(t) for t, y, _ in got if y == k) <= 1000 for k in (0, 1)) and {y for _, y, _ in got} == {0, 1}


