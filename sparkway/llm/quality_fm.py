"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).(x^2))): pairwise
interactions in linear time. It is fitted on the driver from features of a
bounded sample of labelled rows, and scored where the texts are, with no shuffle.

Null and empty texts have zero features and get the score of those. Very long texts
are read whole, in a run of their own. Repeated rows get equal scores. An empty table
gives no rows. Other columns are not read, whatever their names; `keep_good` passes
them on. Without labels of both classes every score is the share
of label 1 seen, or 0.5 if none was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import arrow_map, crc_mod
from .textvec import ALNUM, NOT_SPACE, byte_class, byte_keys, chunks, span_hash, words

#: Slots of hashed words, and rank of the interactions.
SLOTS, RANK = 1 << 12, 6
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 3000

CLASSES = [byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A)), byte_class((0x30, 0x39)), byte_class((0x80, 0xFF)), byte_class((0x21, 0x21), (0x3F, 0x3F)), byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)), byte_class((0x23, 0x26), (0x2A, 0x2A), (0x3C, 0x3C), (0x3E, 0x3E), (0x40, 0x40)), byte_class((0x7C, 0x7C)), byte_class((0x0A, 0x0A))]
DENSE = len(CLASSES) + 5


def features(column: pa.Array):
    """Yields (rows, slot, value, row of each entry, dense matrix) for runs of rows."""
    keys = byte_keys(lower=True)
    for lo, hi, body, offs in chunks(column):
        n = hi - lo
        size = np.diff(offs).astype(np.float64)
        dense = np.zeros((n, DENSE))
        for j, lut in enumerate(CLASSES):
            dense[:, j] = np.diff(np.concatenate([[0], np.cumsum(lut[body], dtype=np.int64)])[offs]) / np.maximum(size, 1)
        s, e, first = words(body, offs, ALNUM)
        raw_s, raw_e, raw_first = words(body, offs, NOT_SPACE)
        count, raw = np.diff(first), np.diff(raw_first)
        length = np.concatenate([[0], np.cumsum(raw_e - raw_s)])
        row = np.repeat(np.arange(n), count)
        key, times = np.unique(row.astype(np.int64) * SLOTS + (span_hash(body, s, e, keys) >> np.uint64(40)).astype(np.int64) % SLOTS, return_counts=True)
        row, slot = key // SLOTS, key % SLOTS
        value = np.log1p(times.astype(np.float64))
        norm = np.sqrt(np.bincount(row, value * value, n))
        value /= norm[row]
        distinct = np.bincount(row, minlength=n)
        dense[:, len(CLASSES) :] = np.stack([np.log1p(size), np.log1p(raw), np.diff(length[raw_first]) / np.maximum(raw, 1), distinct / np.maximum(count, 1), count / np.maximum(raw, 1)], 1)
        dense[size == 0] = 0
        yield n, slot, value, row, dense


class Machine:
    """w0, w, V over SLOTS word features and DENSE standardised statistics."""

    def __init__(self, share: float) -> None:
        d = SLOTS + DENSE
        self.w0, self.w = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0, np.zeros(d)
        self.v = np.random.default_rng(7).normal(0, 0.02, (d, RANK))
        self.mean, self.std = np.zeros(DENSE), np.ones(DENSE)
        self.constant: float | None = None

    def raw(self, n: int, slot: np.ndarray, value: np.ndarray, row: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.mean) / self.std, -4, 4)
        wd, vd = self.w[SLOTS:], self.v[SLOTS:]
        linear = self.w0 + z @ wd + np.bincount(row, self.w[slot] * value, n)
        squares = (z * z) @ (vd * vd).sum(1) + np.bincount(row, (self.v * self.v).sum(1)[slot] * value * value, n)
        both = z @ vd
        for f in range(RANK):
            both[:, f] += np.bincount(row, self.v[slot, f] * value, n)
        return linear + 0.5 * ((both * both).sum(1) - squares)

    def scores(self, *x) -> np.ndarray:
        return np.full(x[0], self.constant) if self.constant is not None else 1 / (1 + np.exp(-np.clip(self.raw(*x), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.08, l2: float = 2e-4, batch: int = 64) -> Machine:
    """rows: (y, slots, values, dense) each. AdaGrad over shuffled batches."""
    y = np.array([r[0] for r in rows], float)
    m = Machine(float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) < 2:
        m.constant = float(y.mean()) if len(y) else 0.5
        return m
    dense = np.stack([r[3] for r in rows])
    m.mean, m.std = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    z = np.clip((dense - m.mean) / m.std, -4, 4)
    rng, d = np.random.default_rng(11), SLOTS + DENSE
    gw, gv, g0 = np.full(d, 1e-2), np.full((d, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.zeros((len(pick), d))
            for i, k in enumerate(pick):
                x[i, rows[k][1]] = rows[k][2]
            x[:, SLOTS:] = z[pick]
            xx, both = x * x, x @ m.v
            p = 1 / (1 + np.exp(-np.clip(m.w0 + x @ m.w + 0.5 * ((both * both).sum(1) - xx @ (m.v * m.v).sum(1)), -30, 30)))
            err = (p - y[pick]) / len(pick)
            dw = x.T @ err + l2 * m.w
            dv = x.T @ (err[:, None] * both) - m.v * (xx.T @ err)[:, None] + l2 * m.v
            gw += dw * dw
            gv += dv * dv
            g0 += err.sum() ** 2
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.5 * rate * dv / np.sqrt(gv)
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `rows` labelled documents outside fold 0; a row sends at most SLOTS slots and values."""

    def featurise(batches):
        for batch in batches:
            y, out, at = batch.column(0).to_pylist(), [], 0
            for n, slot, value, row, dense in features(batch.column(1)):
                cut = np.searchsorted(row, np.arange(n + 1))
                for i in range(n):
                    a, b = cut[i], cut[i + 1]
                    out.append((y[at + i], slot[a:b].astype(np.int16).tobytes(), value[a:b].astype(np.float32).tobytes(), dense[i].tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["y", "slots", "vals", "dense"])

    sample = sampling.labelled(docs, labels, "quality", rows).select(F.col("y").cast("int").alias("y"), "text")
    got = arrow_map(sample, featurise, "y int, slots binary, vals binary, dense binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["dense"]), bytes(r["slots"])))
    return fit([(r["y"], np.frombuffer(r["slots"], np.int16), np.frombuffer(r["vals"], np.float32), np.frombuffer(r["dense"])) for r in got])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches):
        for batch in batches:
            parts = [machine.scores(*x) for x in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    return score(docs, train(docs, labels, rows), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """The documents (all columns) that score at least `threshold`."""
    machine = train(docs, labels, rows)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            parts = [machine.scores(*x) for x in features(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return arrow_map(docs, run, schema)
