"""Groups of sets that share bands and are mostly not similar: the third round's finding on op11."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkway.llm import minhash

from . import brute
from .test_round_three import as_map, named, variants


def apart(n, words, seed):
    """Texts that share most of their words, and few of which are similar."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{i}" if rng.random() < 0.97 else f"x{rng.integers(0, 10**6)}" for i in range(words)) for _ in range(n)]


@pytest.mark.parametrize("block,blocks,left", [(10_000, 8, 1), (7, 100, 1), (7, 2, 0), (7, 2, 10**9)])
def test_groups_dealt_out_or_by_bucket(spark, monkeypatch, block, blocks, left):
    for name, x in (("BLOCK_SETS", block), ("BLOCKS", blocks), ("LEFT", left)):
        monkeypatch.setattr(minhash, name, x)
    texts = dict(enumerate(apart(60, 200, 1) + variants(60, 150, 8, 2) + ["one two", "one two", "", "a b c d e"]))
    assert as_map(minhash.near_duplicates(named(spark, texts)), 2) == brute.components(texts, 4, 80, 100)


def test_rows_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    """What the step that compares gives on: a link for each component joined at most, whatever the pairs are."""
    met, made = [], minhash.links_in
    monkeypatch.setattr(minhash, "links_in", lambda *a: met.append((a[0], made(*a))) or met[-1][1])
    texts = dict(enumerate(apart(150, 200, 3) + variants(150, 150, 8, 4)))
    minhash.near_duplicates(named(spark, texts)).count()
    rows, links = met[0]
    assert 150 <= rows.count() <= 300 and 100 <= links.count() < rows.count()
    assert rows.groupBy("kind", "group", "x", "y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > 100
