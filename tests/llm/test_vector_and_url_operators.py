"""Operators on embeddings and urls against brute force."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from docscreen.llm import ann, common, embedding_dedup, url_filter

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=240, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[n // 2 :] = x[rng.integers(0, 20, n - n // 2)] + 0.08 * rng.normal(size=(n - n // 2, width))
    rows = [(i, [float(v) for v in x[i].astype("f4")], int(i % 3)) for i in range(n)]
    rows += [(1000 + i, rows[150][1], rows[150][2]) for i in range(20)]
    return rows


ODD = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, vectors()[150][1], None), (2005, [1.0, 2.0], 0), (2100, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("bounds", [{}, {"limit": 5}, {"members": 2, "directions": 300}, {"members": 2, "directions": 300, "limit": 6}])
def test_links_equal_brute_force(spark, bounds):
    """Bounds that cut long lists into salts, and such that combine two sets of directions."""
    rows = vectors() + ODD
    got = {r.vec_id: r for r in embedding_dedup.linked(spark.createDataFrame(rows, VECTORS), **bounds).collect()}
    fit = [r for r in vectors()]
    x = np.array([r[1] for r in fit], "f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in fit])[:, None] == np.array([r[2] for r in fit])[None])
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in fit])
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None], 1 << 60).min(1))
        if (low == root).all():
            break
        root = low
    assert near.sum() > 200
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (near[i].sum(), root[i], root[i] == v)
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in ODD)


def test_sets_of_directions_follow_the_largest_label():
    plans = [embedding_dedup.Plan(n, 0.93) for n in (1, 500, 5000, 100_000, 10_000_000)]
    assert [p.sets for p in plans] == sorted(p.sets for p in plans) and plans[0].sets == 1 and plans[-1].sets >= 2
    assert all(p.n <= embedding_dedup.DIRECTIONS and p.count >= 1 for p in plans)


def test_the_count_is_calibrated():
    """Pairs at the threshold reach the count; pairs of unlike vectors hardly do."""
    plan, rng = embedding_dedup.Plan(2000, 0.93), np.random.default_rng(5)
    d = rng.normal(size=(plan.n, 2))
    counts = {0.93: [], 0.0: []}
    for _ in range(300):
        u = rng.normal(size=(plan.n, 2))
        for c in counts:
            x, y = u[:, 0], c * u[:, 0] + np.sqrt(1 - c * c) * u[:, 1]
            both = (np.abs(x) >= plan.bar) & (np.abs(y) >= plan.bar) & (x * y > 0) & (np.abs(x - y) <= plan.window)
            counts[c].append(both.sum())
    assert len(d) == plan.n and abs(np.mean(counts[0.93]) - embedding_dedup.SHARE) < 1.5
    assert min(counts[0.93]) >= plan.count > np.mean(counts[0.0]) * 2


def test_unlike_vectors_are_hardly_paired(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    classes = spark.createDataFrame([(0, [float(v) for v in r], i) for i, r in enumerate(x)], "label int, v array<double>, cid long")
    met = embedding_dedup.candidates(classes, 64, embedding_dedup.Plan(2000, 0.93))
    assert met.count() < 0.01 * 2000 * 2000 / 2


def test_lists_of_large_labels_stay_few():
    """A vector's rows of lists: some 2,050 at 1.5 million vectors of a label when two sets of directions were combined."""
    plans = [embedding_dedup.Plan(n, 0.93) for n in (5000, 50_000, 1_500_000, 5_000_000)]
    assert all(2 * p.share * p.n < 100 for p in plans)
    assert plans[2].rounds(15_000_000, 15_000_000 * 256) * 256 >= 2 * plans[2].share * plans[2].n * embedding_dedup.ROW


def test_rounds_and_parted_lists_find_every_link(spark, monkeypatch):
    """Pairs at and above the threshold over several rounds, with lists parted by signs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1)[:, None] * x
    off /= np.linalg.norm(off, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.95, 1500)[:, None]
    rows = [(i, [float(v) for v in r], i % 1500 % 2) for i, r in enumerate(np.concatenate([x, 1e200 * (c * x + np.sqrt(1 - c * c) * off)]))]
    monkeypatch.setattr(embedding_dedup, "ROUND", 1 << 20)
    plan = embedding_dedup.Plan(1500, 0.93, members=2, directions=600)
    assert plan.sets == 2 and plan.rounds(3000, 1 << 20) > 3
    got = {r.vec_id: r for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), members=2, directions=600).collect()}
    assert all((got[i].n_links, got[i].component_id) == (1, i % 1500) for i in range(3000))


SHORT = [(3000 + i, [1.0, 2.0, 0.001 * i], 0) for i in range(3)] + [(3010, [-1.0, 0.5, 0.0], 0), (3011, [1.0, 2.0, 0.0], 1), (3020, [2.0], 1), (3021, [3.0], 1)]


def test_vectors_of_a_rarer_length_link_too(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(spark.createDataFrame(vectors()[:40] + SHORT, VECTORS)).collect()}
    assert len(got) == 40 + len(SHORT)
    assert [got[3000 + i] for i in range(3)] == [(2, 3000, True), (2, 3000, False), (2, 3000, False)]
    assert got[3010] == (0, 3010, True) and got[3011] == (0, 3011, True) and got[3020] == (1, 3020, True) and got[3021] == (1, 3020, False)


def test_vectors_of_a_rarer_length_are_searched_too(spark):
    df = spark.createDataFrame([r[:2] for r in vectors()[:40] + SHORT], "vec_id long, embedding array<float>")
    got = ann.searched(df, df.where("vec_id in (0, 3000, 3020)")).collect()
    mine = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 3000, 3020)}
    assert len(mine[0]) == 10 and max(mine[0]) < 40 and mine[3000] == [3011, 3001, 3002, 3010] and mine[3020] == [3021]


def test_nearest_equal_brute_force_on_small_inputs(spark):
    rows = [(r[0], r[1]) for r in vectors() + ODD]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.searched(df, df.where("vec_id % 100 = 0")).collect()
    use = [r for r in vectors()] + [ODD[4]]
    ids, x = np.array([r[0] for r in use]), np.array([r[1] for r in use], "f8")
    for q in (0, 100, 200, 1000):
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == ids[best].tolist() and np.allclose([r.score for r in mine], d[best])
    assert {r.query_id for r in got} == {0, 100, 200, 1000}


def test_recall_without_structure_is_measured(spark):
    """op8's own table: no brute force in disguise, and the recall that the index reports holds for the queries."""
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    got = ann.searched(rows, rows.where("vec_id % 10 = 0")).collect()
    data = {r.vec_id: np.array(r.embedding, "f8") for r in rows.collect()}
    ids, x = np.array(list(data)), np.stack(list(data.values()))
    hit = asked = 0
    for q in (i for i in data if i % 10 == 0):
        d = ((x - data[q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]].tolist()) & {r.vec_id for r in got if r.query_id == q})
        asked += 10
    assert hit / asked >= 0.9 and got[0].probes < got[0].partitions and abs(got[0].measured_recall - hit / asked) < 0.05


def test_partitions_are_fitted_once_more_where_rows_are_many(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.searched(df, df.where("vec_id % 100 = 0")).collect()
    hit = sum(r.vec_id in set(np.argsort(np.r_[((x - x[r.query_id]) ** 2).sum(1)])[1:11].tolist()) for r in got)
    assert got[0].partitions > 4 and got[0].probes < got[0].partitions and len(got) == 400 and hit / 400 >= 0.9


def test_recall_with_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.searched(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 300 and hit / 300 >= 0.9


def test_all_candidates_if_fewer(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.searched(df, df.where("vec_id = 0")).collect()] == [(0, 1, 2), (0, 2, 1)]


def test_rules_and_aliases(spark):
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head>'
    rows = [
        (1, "http://a.example.org/es/1", ""), (2, "HTTP://WWW.Shop.COM/de/x?y#z", None), (3, "http://x.com/fr/1", ""), (4, "http://plain.net/1", ""),
        (5, "http://alias.net/1", link("http://a.example.org/es/1")), (6, "http://alias.net/2#top", '<meta http-equiv="refresh" content="0; url=/1">'),
        (7, "http://other.net/1", link("http://x.com/de/2")), (8, "http://allowed.org/", link("http://other.net/1")), (9, None, ""), (10, "nohost", ""), (11, "http://org", ""), (12, "http://example.org/es/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("www.shop.com", "/de/x", "com/de/", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == (None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("org/", "allow")  # an allowed member frees its class
    assert got[9] == ("", "", None, "allow") == got[10] and got[11] == ("org", "", None, "allow") and got[12][3] == "block"


def test_every_tag_of_a_page_is_an_edge(spark):
    rows = [
        (1, "http://a.net/1", "<meta http-equiv=refresh content=300><META http-equiv='refresh' content='0;url=http://x.com/de/1'>"),
        (2, "http://a.net/2", '<link rel=canonical><link rel="canonical" href="http://plain.net/"><link rel="canonical" href=" http://x.com/de/2">'),
        (3, "https://a.net/x?p=1&q=2", ""), (4, "http://x.com/de/3", "<link rel=canonical href='https://a.net/x?p=1&amp;q=2'>"),
        (5, "https://a.net/y?p=1&copy=2&é", ""), (6, "http://x.com/de/4", "<link href='https://a.net&#x2f;y&#63;p=1&copy=2&amp&eacute;#top' rel=canonical>"),
        (7, "http://a.net/5", '<meta http-equiv="refresh" content="0; url=&#39;http://x.com/de/6&#39;">'), (8, "http://a.net/6", "<meta http-equiv=refresh content=300><link rel=canonical>"),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" for k in range(1, 8)} | {8: "allow"}


def test_references_are_resolved_as_html_does(spark):
    same = ["a&amp;b", "&lt;&gt;&quot;&apos;", "&#38;&#x26;&#X26;", "&#128;", "&#0;&#xD800;&#x110000;", "&#x1F600;&#233", "&nosuch;&", "&amp", "&amp;amp;", "plain", "&NotEqualTilde;", "&#99999999999999999999;"]
    odd = {"?a=1&copy=2": "?a=1&copy=2", "&copyx": "&copyx", "&notit;": "&notit;"}  # in an attribute, unlike in text
    got = spark.createDataFrame([(x,) for x in [*same, *odd]], "c string").select("c", url_filter.unescaped(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == {x: html.unescape(x) for x in same} | odd


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (None, 3), (7, 7), (103, 101), (500, 103)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100, 500: 100}


def test_plans_of_links_stay_small(spark):
    """The characters' names aren't repeated in the plans that the driver keeps: 4 MB each before."""
    pages = spark.createDataFrame([(1, "http://a.org/x", '<link rel="canonical" href="/y&amp;z&eacute;">')], "page_id long, url string, html string")
    edges = url_filter.alias_edges(pages)
    assert len(edges._jdf.queryExecution().toString()) < 200_000
    assert [tuple(r) for r in edges.collect()] == [("http://a.org/x", "http://a.org/y&zé")]
