"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of lexicon words and word beginnings,
hits near second-person words, capitals, punctuation and obfuscation rates.
The lexicon is a short seed list joined by what a bounded labelled sample shows
to be used in toxic texts; it, the trees and the calibration are fitted on
different folds of that sample. Scoring needs no shuffle.

Null and empty texts have zero features and get the score of those. Very long
texts are read whole, in a run of their own. Repeated rows get equal scores. An
empty table gives no rows. Columns other than doc_id and text are not read, whatever
their names. Without labels of both classes every score is the share
of label 1 seen, or 0 if none was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import arrow_map, crc_mod
from .textvec import ALNUM, byte_class, byte_keys, chunks, span_hash, words

SAMPLE_ROWS = 8000
#: Learned lexicon entries at most, and the documents that must hold one.
LEXICON, SUPPORT = 400, 4
PREFIXES = (4, 5, 6, 7, 8, 9)
NEAR = 6

SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown", "dumb", "hate", "kill", "ugly"]
YOU = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "vosotros", "tus"]
WORD = ALNUM | byte_class((0x40, 0x40), (0x24, 0x24))
#: Look-alikes read as letters.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
ODD = byte_class((0x30, 0x39), (0x40, 0x40), (0x24, 0x24))
UPPER, BANG, PUNCT, LETTER = byte_class((0x41, 0x5A)), byte_class((0x21, 0x21), (0x3F, 0x3F)), byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NAMES = ["seed_density", "you_density", "near_you", "word_density", "word_weight", "word_max", "stem_density", "stem_weight", "stem_max", "weight_near_you", "capitals", "shouts", "punctuation", "obfuscated", "log_words"]


def keys() -> np.ndarray:
    k = byte_keys(lower=True)
    for a, b in LOOKS.items():
        k[ord(a)] = k[ord(b)]
    return k


def hash_words(list_: list[str]) -> np.ndarray:
    k = keys()
    return np.array([span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), k)[0] for w in list_], np.uint64)


class Lookup:
    """Weights of hashed entries; a bit table turns most words away at once."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.h, self.w = hashes[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.h >> np.uint64(48)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `h` of entries, and their weights."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(48)])
        if not len(at) or not len(self.h):
            return at[:0], self.w[:0]
        i = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
        ok = self.h[i] == h[at]
        return at[ok], self.w[i[ok]]


def word_hashes(body: np.ndarray, offs: np.ndarray, k: np.ndarray):
    """Hashes of words, and of each beginning of PREFIXES bytes: (position of word, salted hash)."""
    s, e, first = words(body, offs, WORD)
    whole = span_hash(body, s, e, k)
    stems = []
    for n in PREFIXES:
        at = np.flatnonzero(e - s > n)
        stems.append((at, span_hash(body, s[at], s[at] + n, k) ^ np.uint64(0x5851F42D4C957F2D)))
    return s, e, first, whole, stems


def features(column: pa.Array, seeds: Lookup, you: Lookup, lexicon: Lookup):
    """A matrix of NAMES for each run of rows."""
    k = keys()
    for lo, hi, body, offs in chunks(column):
        n = hi - lo
        s, e, first, whole, stems = word_hashes(body, offs, k)
        count = np.diff(first)
        per = 1 / np.maximum(count, 1)
        row = np.repeat(np.arange(n), count)
        out = np.zeros((n, len(NAMES)))

        def add(j: int, at: np.ndarray, weight=None) -> None:
            out[:, j] += np.bincount(row[at], weight, n)

        seed, _ = seeds.find(whole)
        me, _ = you.find(whole)

        def near(at: np.ndarray) -> np.ndarray:
            if not len(me) or not len(at):
                return np.zeros(len(at), bool)
            i = np.searchsorted(me, at)
            a, b = me[np.maximum(i - 1, 0)], me[np.minimum(i, len(me) - 1)]
            return ((np.abs(at - a) <= NEAR) & (row[a] == row[at])) | ((np.abs(b - at) <= NEAR) & (row[b] == row[at]))

        add(0, seed)
        add(1, me)
        add(2, seed[near(seed)])
        for j, found in ((3, [(np.arange(len(whole)), whole)]), (6, stems)):
            for pos, h in found:
                at, w = lexicon.find(h)
                at = pos[at]
                add(j, at)
                add(j + 1, at, w)
                np.maximum.at(out[:, j + 2], row[at], w)
                if j == 3:
                    c = near(at)
                    add(9, at[c], w[c])
        for j in (0, 1, 2, 3, 4, 6, 7, 9):
            out[:, j] *= 100 * per

        def rate(lut: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(lut[body], dtype=np.int64)])[offs]) / np.maximum(np.diff(offs), 1)

        out[:, 10], out[:, 11], out[:, 12] = rate(UPPER), rate(BANG), rate(PUNCT)
        odd, letter = np.concatenate([[0], np.cumsum(ODD[body], dtype=np.int64)]), np.concatenate([[0], np.cumsum(LETTER[body], dtype=np.int64)])
        mixed = (odd[e] > odd[s]) & (letter[e] > letter[s]) & LETTER[body[s]] & LETTER[body[np.maximum(e - 1, 0)]]
        add(13, np.flatnonzero(mixed))
        out[:, 13] *= per
        out[:, 14] = np.log1p(count)
        yield out


class Forest:
    """Depth-limited regression trees on binned features, boosted on the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 4.0, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        d, nodes = x.shape[1], 2**self.depth
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(nodes - 1, np.int64), np.full(nodes - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                best = np.zeros(width)
                pick = [(0, np.inf)] * width
                at = width - 1
                for j in range(d):
                    slot, m = node * (self.bins + 1) + binned[:, j], width * (self.bins + 1)
                    gs = np.bincount(slot, g, m).reshape(width, -1).cumsum(1)
                    hs = np.bincount(slot, h, m).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    b = gain[:, : len(edges[j])].argmax(1) if len(edges[j]) else np.zeros(width, int)
                    for i in range(width):
                        if len(edges[j]) and gain[i, b[i]] > best[i] + 1e-9:
                            best[i], pick[i] = gain[i, b[i]], (j, edges[j][b[i]])
                for i in range(width):
                    feature[at + i], cut[at + i] = pick[i]
                node = node * 2 + (x[np.arange(len(y)), feature[at + node]] > cut[at + node])
            value = -self.rate * np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + self.l2)
            self.split.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.split:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray, prior: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing fit, each block at its mean input; ties in `raw` are one block.

    Shares are drawn a little towards the overall one, as by `prior` rows more in each
    block; blocks that this puts out of order are pooled as well.
    """
    values, back = np.unique(raw, return_inverse=True)
    sums, counts = np.bincount(back, y), np.bincount(back).astype(float)
    mean = float(y.mean())

    def pooled(level) -> None:
        """Merges the last blocks while they are out of order by `level`."""
        while len(blocks) > 1 and level(blocks[-2]) >= level(blocks[-1]):
            last = blocks.pop()
            blocks[-1] = blocks[-1] + last

    blocks: list[np.ndarray] = []
    for v, s, n in zip(values, sums, counts, strict=True):
        blocks.append(np.array([s, n, v * n]))
        pooled(lambda x: x[0] / x[1])
    plain, blocks = blocks, []

    def drawn(x: np.ndarray) -> float:
        return (x[0] + prior * mean) / (x[1] + prior)

    for x in plain:
        blocks.append(x)
        pooled(drawn)
    return np.array([x[2] / x[1] for x in blocks]), np.array([drawn(x) for x in blocks])


class Model:
    def __init__(self) -> None:
        self.seeds = Lookup(hash_words(SEEDS), np.ones(len(SEEDS)))
        self.you = Lookup(hash_words(YOU), np.ones(len(YOU)))
        self.lexicon = Lookup(np.zeros(0, np.uint64), np.zeros(0))
        self.forest, self.constant, self.at, self.to = Forest(), None, np.zeros(1), np.zeros(1)

    def matrix(self, column: pa.Array):
        return features(column, self.seeds, self.you, self.lexicon)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a hundredth comes of the raw score, so that it still orders what calibration makes equal."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.forest.raw(x)
        return np.clip(0.99 * np.interp(raw, self.at, self.to) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> Lookup:
    """Words and word beginnings whose documents are mostly toxic, from counts merged over batches."""

    def count(batches):
        k = keys()
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), np.int64)
            ids, at = [], 0
            for lo, hi, body, offs in chunks(batch.column(1)):
                _, _, first, whole, stems = word_hashes(body, offs, k)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                for pos, h in [(np.arange(len(whole)), whole), *stems]:
                    ids.append(np.unique(np.rec.fromarrays([h, row[pos] + at], names="h,r")))
                at += hi - lo
            both = np.unique(np.concatenate(ids)) if ids else np.zeros(0, [("h", np.uint64), ("r", np.int64)])
            h, back = np.unique(both["h"], return_inverse=True)
            label = y[both["r"]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(back, label, len(h)).astype(np.int64)), pa.array(np.bincount(back, 1 - label, len(h)).astype(np.int64))], names=["h", "toxic", "clean"])

    parts = arrow_map(sample.select(F.col("y").cast("int").alias("y"), "text"), count, "h long, toxic long, clean long")
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = parts.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("w", weight)
    found = found.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= 4 * F.col("clean"))).orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "h").limit(LEXICON).collect()
    return Lookup(np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["w"] for r in found], float))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    m = Model()
    sample = sampling.labelled(docs, labels, "toxic", rows)
    # Half of the sampled ids, by another hash, teach the lexicon; fold 4 the calibration; the rest the trees.
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    lexical = sample.where(half & (F.col("fold") != 4))
    n = {r["y"]: r["count"] for r in lexical.groupBy("y").count().collect()}
    m.lexicon = learn_lexicon(lexical, n.get(1, 0), n.get(0, 0))

    def featurise(batches):
        for batch in batches:
            x = [r.tobytes() for part in m.matrix(batch.column(2)) for r in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["fold", "y", "x"])

    rest = sample.where(~half | (F.col("fold") == 4)).select(F.col("fold").cast("int").alias("fold"), F.col("y").cast("int").alias("y"), "text")
    got = sorted(((r["fold"], r["y"], bytes(r["x"])) for r in arrow_map(rest, featurise, "fold int, y int, x binary").collect()))
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        m.constant = float(y.mean()) if len(y) else 0.0
        return m
    x = np.stack([np.frombuffer(r[2]) for r in got])
    hold = np.array([r[0] for r in got]) == 4
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold = np.arange(len(y)) % 3 == 0
    m.forest.fit(x[~hold], y[~hold])
    m.at, m.to = isotonic(m.forest.raw(x[hold]), y[hold])
    return m


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches):
        for batch in batches:
            parts = [model.scores(x) for x in model.matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    return score(docs, train(docs, labels, rows), threshold)
