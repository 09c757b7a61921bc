"""Learned operators: held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkway.llm import language, quality_fm, sampling, toxicity, urlfilter

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.mark.parametrize("module,label,least", [(quality_fm, "quality", 0.93), (toxicity, "toxic", 0.90)])
def test_held_out(big, module, label, least):
    docs, labels = big
    rows = module.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    right = sum(r.predicted == r[label] for r in rows) / len(rows)
    assert right >= least and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module", [quality_fm, toxicity])
def test_labelled_odd_rows(big, odd, none, module):
    docs, labels = big
    rows = module.score(odd, module.train(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert module.classify(none, labels).count() == 0
    assert {r.score for r in module.classify(odd, labels.limit(0)).collect()} <= {0.0, 0.5}


def test_keep_good_keeps_columns(big, odd):
    docs, labels = big
    kept = quality_fm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    bad = labels.where("quality = 0").join(docs, "doc_id").count()
    assert bad / 2 < docs.count() - kept.count() < 4 * bad
    assert quality_fm.keep_good(odd, labels).columns == odd.columns


def test_factorisation_identity():
    """The linear-time score equals the sum over pairs."""
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.5)
    m.w, m.v = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    slot, value, dense = np.array([3, 5, 9]), np.array([0.5, 1.0, 2.0]), rng.normal(size=(1, quality_fm.DENSE))
    x = np.zeros(len(m.w))
    x[slot], x[quality_fm.SLOTS :] = value, dense[0]
    at = np.flatnonzero(x)
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for a, i in enumerate(at) for j in at[a + 1 :])
    got = m.raw(1, slot, value, np.zeros(3, int), dense)[0]
    assert got == pytest.approx(m.w0 + m.w @ x + pairs)


def test_isotonic_is_monotone():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=300), 1 + seed % 3)
        y = (x + rng.normal(size=300) > 0).astype(float)
        at, to = toxicity.isotonic(x, y)
        assert (np.diff(at) > 0).all() and (np.diff(to) > 0).all() and 0 <= to.min() and to.max() <= 1
    # Without a prior it is the least-squares fit: blocks at their means.
    at, to = toxicity.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), 0.0)
    assert to.tolist() == [0, 0.5, 1] and at.tolist() == [0, 2.5, 5]
    model = toxicity.Model()
    model.forest.base, model.at, model.to = 0.0, np.array([0.0]), np.array([0.3])
    assert 0.29 < model.scores(np.zeros((1, len(toxicity.NAMES))))[0] < 0.31


def test_language_held_out(big, odd, none):
    docs, _ = big
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97
    got = {r.doc_id: r for r in language.identify(odd, language.train(docs)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5, 9)) and got[7].lang_pred == "en"
    assert language.identify(none).count() == 0


def test_language_training_of_few_and_many(spark):
    """A language of one document, and hundreds of languages: the sample is bounded in all."""
    one = spark.createDataFrame([(i, f"wort{i} und so weiter", "de") for i in range(0, 60, 3)] + [(2, "only one text here", "en"), (2, "only one text here", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(one).collect()} <= {"de", "en"}
    many = spark.createDataFrame([(i, f"l{i % 300} text of language {i % 300}", f"x{i % 300:03d}") for i in range(3000)], "doc_id long, text string, lang string")
    sample, names = sampling.by_language(many, 800, 600)
    assert len(names) == 300 and 0 < sample.count() <= 4 * 2 * 300


def test_language_counts_of_short_rows_are_bounded():
    column = pa.array(["ab cd"] * 1000 + ["x"] + [""] * 5)
    parts = list(language.counts(column))
    assert sum(n for n, _, _ in parts) == 1006 and max(n for n, _, _ in parts) <= language.RUN_ROWS
    assert (parts[0][1][0] == parts[0][1][1]).all() and parts[0][1][0].sum() == 4 + 3


def test_codewords_are_far_apart():
    for n in (2, 4, 5, 12):
        c = language.codewords(n)
        apart = (c.shape[1] - c @ c.T) / 2
        assert (apart + 1000 * np.eye(n)).min() >= max(1, c.shape[1] // 4)


def test_url_rules(spark):
    urls = ["http://a.org/x", "https://Example.ORG/es/1", "https://x.example.org/en/12?q", "http://example.com/fr/", "http://b.com/de/2#t", "http://c.com/fr", "http://org", "no scheme", None, "http://notexample.org/es/1", "x://h:80/p://q", "http://cheap-pills.example.com/en/4", "https://therin.example.net/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("b.com", "/de/2", "com/de/", "block")
    assert got[5][2] is None and got[6] == ("org", "", None, "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][2] == "org/" and got[10][:2] == ("h:80", "/p://q")
    assert got[11][3] == "block" and got[12][3] == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0


def plain_url(url):
    """Host, path, rule and its verdict, read character by character."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest, host, path = url[url.index("://") + 3 :], "", ""
    while rest and rest[0] not in "/?#":
        host, rest = host + (chr(ord(rest[0]) + 32) if "A" <= rest[0] <= "Z" else rest[0]), rest[1:]
    while rest and rest[0] not in "?#":
        path, rest = path + rest[0], rest[1:]
    best = None
    for h, p, v in urlfilter.RULES:
        if (host == h or host[-len(h) - 1 :] == "." + h) and path[: len(p)] == p and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def test_url_parts_and_rules_against_plain_reading(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet")
    odd = ["", "://", "http://", "a://B.ORG", "http://ORG/", "http://org/", "http://x.org?/y", "http://example.org/en/1", "http://xexample.org/en/1", "HTTP://É.Com/DE/é?#", "h://a.com/de/#/fr/", "h://com/fr", "h://.com/fr/", "://a.com/fr/x://b", "h://a.com/fr/\n/x", "h:/\u00a0/a.com", "h://" + "a" * 30_000 + ".com/de/" + "b" * 30_000, None, "h://org/", "h://org/"]
    extra = spark.createDataFrame([(10**9 + i, u, "x", "y", 0.5) for i, u in enumerate(odd)], "page_id long, url string, host string, rule string, score double")
    for df in (pages, extra):
        urls = {r.page_id: r.url for r in df.select("page_id", "url").collect()}
        rows = urlfilter.judge(df).collect()
        assert len(rows) == len(urls)
        for r in rows:
            host, path, rule, verdict = plain_url(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_url_scores_against_a_plain_sum():
    """Distinct n-grams of each url by itself give what runs of urls give."""
    w = urlfilter.fit()
    rows = urlfilter.training_urls()[:40] + [("a", "", 0), ("", "", 0), ("a" * 9, "é" * 5, 0)]
    hosts, paths = (pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))
    each = [urlfilter.scores(hosts.slice(i, 1), paths.slice(i, 1), w)[0] for i in range(len(rows))]
    assert np.allclose(urlfilter.scores(hosts, paths, w), each)


def test_url_model_learns():
    """On folds of the table that it has not seen, by host and by path."""
    rows, right = urlfilter.training_urls(), {"host": [], "path": []}
    for fold in range(5):
        seen, unseen = ([r for r in rows if (zlib.crc32((r[1] if ".example." in r[0] else r[0]).encode()) % 5 == fold) == held] for held in (False, True))
        p = urlfilter.scores(pa.array([r[0] for r in unseen], pa.string()), pa.array([r[1] for r in unseen], pa.string()), urlfilter.fit(seen))
        for (host, _, y), s in zip(unseen, p, strict=True):
            right["path" if ".example." in f".{host}" else "host"].append((s >= 0.5) == bool(y))
    assert np.mean(right["host"]) > 0.75 and np.mean(right["path"]) > 0.5, {k: np.mean(v) for k, v in right.items()}
    hosts, paths = (pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))
    assert ((urlfilter.scores(hosts, paths, urlfilter.fit()) >= 0.5) == np.array([r[2] for r in rows])).mean() > 0.97
