"""Near-duplicates by MinHash, filter interactions and sort-means, against plain definitions."""

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkway.llm import filter_audit, longmatch, minhash, sentences, sort_means

from . import brute
from .conftest import LONG, ROWS, TIED


def as_map(rows, n):
    return {r[0]: tuple(r)[1 : 1 + n] for r in rows.collect()}


def named(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def variants(n, words, changes, seed):
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(words)], []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, rng.integers(0, changes + 1)):
            t[at] = f"x{rng.integers(0, 5)}"
        out.append(" ".join(t))
    return out


# MinHash


@pytest.mark.parametrize("k,num", [(5, 90)])
def test_near_duplicates(docs, texts, k, num):
    got = as_map(minhash.near_duplicates(docs, k, num, 100), 3)
    assert got == {d: (n, c, d == c) for d, (n, c) in brute.components(texts, k, num, 100).items()}


@pytest.mark.parametrize("words,changes", [(12, 2), (150, 8)])
def test_near_duplicates_near_the_threshold(spark, words, changes):
    texts = dict(enumerate(variants(150, words, changes, words)))
    assert as_map(minhash.near_duplicates(named(spark, texts)), 2) == brute.components(texts, 4, 80, 100)


@pytest.mark.parametrize("rounds,left", [(8, 0), (1, 10**9)])
def test_rounds_change_no_component(spark, monkeypatch, rounds, left):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "LEFT", left)
    groups = [" ".join(f"{c}{x}" for x in t.split()) for c in "abc" for t in variants(60, 60, 5, ord(c))]
    texts = dict(enumerate(groups + ["one two", "one two", "", "other words here now then"]))
    assert as_map(minhash.near_duplicates(named(spark, texts)), 2) == brute.components(texts, 4, 80, 100)


def test_posterior_bounds():
    """The bound against the posterior added up numerically; pairs at the threshold pass, unlike ones end early."""
    least = minhash.least_agreeing(0.8, 128, 32, 1e-6)
    assert least == sorted(least) and len(least) == 4
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip((32, 64, 96, 128), least, strict=True):
        def tail(k):
            logs = k * np.log(grid) + (n - k) * np.log1p(-grid)
            w = np.exp(logs - logs.max())
            return w[grid >= 0.8].sum() / w.sum()

        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (20_000, 128)).astype(np.uint16)
    for share, passed in ((0.8, (0.999, 1.0)), (0.4, (0, 0.001))):
        b = np.where(rng.random(a.shape) < share, a, a + 1)
        assert passed[0] <= minhash.plausible(a, b, least).mean() <= passed[1]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.sort(x[:2000]), np.sort(x[1000:])]
    s = minhash.signatures(sets, *minhash.families(2048))
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.04
    one = minhash.signatures([sets[1]], *minhash.families(2048))
    assert (one[0] == s[1]).all()


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {tuple(r) for r in rows if r.doc_id in (3, 4, 5)} == {(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)}
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == len(brute.shingles(TIED, 4))} == {(1, 1, True), (2, 1, False), (10, 1, False), (None, 1, False)}
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id == 10} == {(len(brute.shingles(TIED, 4)), 1), (1, 10)}
    assert minhash.near_duplicates(none).count() == 0


# Filter interactions

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs, labels):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in filter_audit.interactions(docs, labels).collect()}


def test_interactions(docs, labels):
    rows = docs.select("doc_id", "text", "lang").collect()
    assert audit(docs, labels) == brute.interactions([tuple(r) for r in rows], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_interactions_of_odd_rows(spark, odd, none, labels):
    rows = [(d, t, lang) for d, t, lang, _ in ROWS]
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1), (10, 1, 0)]
    table = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert audit(odd, table) == brute.interactions(rows, [m for m in marks if m[0] is not None])
    assert audit(none, labels) == {}
    assert len(audit(odd, labels.where(F.lit(False)))) == 600 * len({lang or "" for _, _, lang in rows})


def test_every_copy_but_the_first_fails_across_boundaries(spark):
    """A group of copies over many ranges; other groups at the edges; equal ids."""
    rows = [(i, "the one text of a third") for i in range(400)] + [(i // 2, f"text of {i // 7}") for i in range(600)] + [(None, "the one text of a third")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(7)
    first = {}
    for d, t in rows:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    got = filter_audit.masks(df).groupBy((F.col("mask").bitwiseAND(filter_audit.DUPLICATE) != 0).alias("e")).count().collect()
    want = sum(d is not None and d > first[t] for d, t in rows)
    assert {r.e: r["count"] for r in got} == {True: want, False: len(rows) - want}


@pytest.mark.parametrize("size", [1, 7])
def test_boundaries_with_few_rows_a_batch(spark, size):
    """Runs of equal texts that go on from batch to batch and from range to range."""
    rows = [(i, f"t{i % 3}") for i in range(60)] + [(60 + i, "only") for i in range(30)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
        got = {r.doc_id: bool(r.mask & filter_audit.DUPLICATE) for r in filter_audit.masks(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {d: any(t == u and e < d for e, u in rows) for d, t in rows}


# Sort-means

VECTOR = "vec_id long, embedding array<double>, label int, v string, cluster string"


def clustered(df, **options):
    return sorted((tuple(r)[:6] for r in sort_means.cluster(df, **options).collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTOR)


def test_sort_means_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(90)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[5][1])]
    rows += [(200, None), (201, [0.1] * 63), (202, [0.1] * 65), (203, [math.nan] + [0.1] * 63), (204, [math.inf] + [0.0] * 63), (205, [None] + [0.0] * 63), (206, [])]
    assert clustered(vectors(spark, rows)) == sorted(brute.lloyd(rows), key=str)


@pytest.mark.parametrize("n", [1, 60])
def test_sort_means_with_ties(spark, n):
    """Vectors on a coarse grid: many equal distances, empty centroids, fewer vectors than centroids."""
    rng = np.random.default_rng(n)
    rows = [(i, (rng.integers(-1, 2, 64) * (rng.random(64) < 0.05)).astype(float).tolist()) for i in range(n)]
    assert clustered(vectors(spark, rows)) == sorted(brute.lloyd(rows), key=str)


def test_the_scan_finds_the_nearest_and_looks_at_few(monkeypatch):
    """Well parted groups: each vector meets its own centroid's neighbourhood only."""
    rng = np.random.default_rng(4)
    cents = rng.integers(-1000, 1000, (30, 8)).astype(np.int64)
    x = cents[rng.integers(0, 30, 500)] + rng.integers(-20, 21, (500, 8))
    between = np.array([sort_means.square(cents, c) for c in cents])
    every = np.array([sort_means.square(x, c) for c in cents])
    for before in (np.zeros(500, np.int64), every.argmin(0)):
        best, least = sort_means.assign(x, before, cents, between, np.argsort(between, axis=1, kind="stable"))
        assert (best == every.argmin(0)).all() and (least == every.min(0)).all()
    looks, square = [], sort_means.square
    monkeypatch.setattr(sort_means, "square", lambda a, b: looks.append(len(a)) or square(a, b))
    sort_means.assign(x, every.argmin(0), cents, between, np.argsort(between, axis=1, kind="stable"))
    assert sum(looks) < 4 * len(x)


def test_wide_components_have_a_result(spark):
    rows = [(0, [1e300] * 64), (1, [-1e300] * 64), (2, [0.0] * 64)]
    got = clustered(vectors(spark, rows))
    assert [r[2] for r in got] == [0, 0, 0]


# One doc_id with two texts


def test_an_id_with_two_texts_is_cut_by_its_own_spans(spark):
    once = " ".join(f"{x}{i}." if i % 9 == 8 else f"{x}{i}" for x in "ab" for i in range(40))
    rows = [(1, once), (5, once), (5, "A short one."), (5, LONG), (6, f"Lead in. {once}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in sentences.dedup(df).collect()}
    assert {(1, once), (5, "A short one.")} <= got and (5, once) not in got and (6, f"Lead in. {once}") not in got
    turned = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.text) for r in sentences.dedup(turned).collect()} == got
    cut = longmatch.remove(df).collect()
    assert len(cut) == len(rows) and all(0 <= r.n_removed <= r.n_bytes for r in cut)


def test_every_operator_runs_where_the_package_is_not(tmp_path):
    """Workers start in an empty folder and have no path to the package: all they need travels with the tasks."""
    code = """
import sys, tempfile
sys.path.insert(0, {root!r})
from sparkway.session import build
spark = build("away", "local-cluster[1,2,2048]", 4, **{{"spark.checkpoint.dir": "file://{tmp}", "spark.ui.showConsoleProgress": "false", "spark.executor.memory": "1g"}})
import __spark_entry__ as e
for name in {names!r}:
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""
    import corpus_pipeline
    from sparkway.llm import queries

    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    names = [*sorted(queries.queries()), "pipeline"]
    done = subprocess.run([sys.executable, "-c", code.format(root=root, tmp=tmp_path, names=names)], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-3000:]
