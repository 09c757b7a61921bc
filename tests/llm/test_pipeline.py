"""The corpus pipeline, stage by stage against plain definitions, and on odd rows."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkway.llm import quality_fm

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage got and gave, as run() has them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('pipeline')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def texts_of(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])
    assert all(0 < after.count() <= before.count() for before, after in stages[:-1])


def test_quality_stage(spark, stages):
    before, after = stages[0]
    verdicts = quality_fm.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert set(texts_of(after)) == {r.doc_id for r in verdicts.collect()}


def test_near_copy_stage(stages):
    before, after = map(texts_of, stages[1])
    groups = brute.components(before, 5, 80, 100)
    assert set(after) == {d for d, (n, c) in groups.items() if n == 0 or c == d}
    assert all(before[d] == t for d, t in after.items())


def test_passage_stage(stages):
    """Words go only if they lie in a repeated run of 16 words; of words in a repeated run of 51, most go."""
    before, after = map(texts_of, stages[2])
    assert set(before) == set(after)
    seen, long_seen, lost, due = set(), set(), 0, 0
    count = {}
    words = {d: brute.ALNUM.findall(brute.lower(before[d])) for d in sorted(before)}
    for w in words.values():
        for i in range(len(w) - 15):
            g = tuple(w[i : i + 16])
            count[g] = count.get(g, 0) + 1
    for d, w in words.items():
        left = brute.ALNUM.findall(brute.lower(after[d]))
        may = [False] * len(w)
        for i in range(len(w) - 15):
            if count[tuple(w[i : i + 16])] > 1:
                may[i : i + 16] = [True] * 16
        assert len(w) - len(left) <= sum(may)
        must = [False] * len(w)
        for i in range(len(w) - 50):
            g = tuple(w[i : i + 51])
            if g in long_seen:
                must[i : i + 51] = [True] * 51
            long_seen.add(g)
        due += sum(must)
        lost += min(sum(must), len(w) - len(left))
        if not any(may):
            assert after[d] == before[d]
        seen.update(w)
    assert lost >= 0.8 * due


def test_benchmark_stage(spark, stages):
    before, after = map(texts_of, stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination(before, items)
    assert set(before) == set(after)
    for d, (n, n_hit, *_) in hit.items():
        assert len(brute.ALNUM.findall(brute.lower(after[d]))) == n - n_hit
        assert n_hit or after[d] == before[d]


def test_packing_stage(stages):
    before, after = texts_of(stages[4][0]), stages[4][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before.items()}
    got, held = {}, {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(want.values()) // 4096) + 1


def test_odd_rows_pass_every_stage(spark, odd, none):
    """Nulls, empty, very long and repeated rows, clashing names and empty tables: no stage fails, all but the last keep the columns."""
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert len(rows) <= docs.count() + 20 and (docs is odd or not rows), name
            assert name == "best_fit_packing" or out.columns == docs.columns


def test_run_leaves_only_its_result(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(corpus_pipeline, "delete", lambda s, path: gone.append(path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(gone) == len(corpus_pipeline.STAGES) - 1
