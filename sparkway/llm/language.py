"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1; one binary classifier on hashed byte
n-grams predicts each bit. Decoding weighs every bit's logistic loss by the
bit's accuracy in training and takes the nearest codeword; a small lead over
the second is flagged. Fitted on a bounded sample, scored without a shuffle.

Null texts and texts without letters are `und` with score 0. Very long texts are
counted whole. Repeated rows get equal answers. Columns other than doc_id, text and,
for training, lang are not read. An empty table gives no rows. If no language can be learned, every answer is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import arrow_map, crc_mod
from .textvec import byte_class, chunks

SLOTS = 1 << 12
#: Rows whose counts are held at once, as SLOTS numbers each.
RUN_ROWS = 256
#: Documents a language in the training sample, about, and in all, at most some.
SAMPLE_ROWS, SAMPLE_ALL = 800, 20_000
UNKNOWN = "und"

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
HIGH = byte_class((0x80, 0xFF))


def fold_table() -> np.ndarray:
    """Bytes as the n-grams see them: A-Z lower-cased, other ASCII but letters as a space."""
    t = np.arange(256, dtype=np.uint64)
    t[:128] = 32
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def counts(column: pa.Array):
    """Yields (rows, n-gram counts by slot, has-letter flags) for runs of rows."""
    fold = fold_table()
    for lo, hi, body, offs in chunks(column, rows=RUN_ROWS):
        n, size = hi - lo, np.diff(offs)
        c = fold[body]
        row = np.repeat(np.arange(n), size)
        two = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(c) > 1 else c[:0]
        three = (two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)) if len(c) > 2 else c[:0]
        total = np.zeros(n * SLOTS, np.int64)
        for k, h in ((2, two), (3, three)):
            if len(h):
                inside = row[: len(h)] == row[k - 1 :]
                slot = (h >> np.uint64(52 - k)).astype(np.int64) % SLOTS
                total += np.bincount((row[: len(h)] * SLOTS + slot)[inside], minlength=n * SLOTS)
        letters = np.diff(np.concatenate([[0], np.cumsum(LETTERS[body])])[offs]) > 0
        high = np.diff(np.concatenate([[0], np.cumsum(HIGH[body])])[offs]) > 0
        for i in np.flatnonzero(high & ~letters):
            letters[i] = any(map(str.isalpha, bytes(body[offs[i] : offs[i + 1]]).decode("utf-8", "ignore")))
        yield n, total.reshape(n, SLOTS), letters


def scaled(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1/-1 for each of n classes, rows and columns far apart: all splits of up to five classes, else the best of random codes."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 else (-1 if (b + 1) >> (i - 1) & 1 else 1) for b in range(bits)] for i in range(n)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2
        least = (apart + bits * np.eye(n)).min()
        if least > far:
            best, far = code, least
    return best


class Coder:
    def __init__(self, names: list[str]) -> None:
        self.names, self.code = names, codewords(max(1, len(names)))
        self.w = np.zeros((SLOTS, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        self.trust = np.ones(self.code.shape[1], np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and lead over the second class of each row."""
        margin = np.clip(x @ self.w + self.b, -8, 8)
        loss = np.stack([np.log1p(np.exp(-margin * c)) @ self.trust for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return loss.argmin(1), p.max(1), top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


class Rows:
    """Scaled rows of counts, kept sparse; dense only as many at a time as asked for."""

    def __init__(self, slots: list[np.ndarray], n: list[np.ndarray]) -> None:
        self.slots, self.n = slots, n

    def __len__(self) -> int:
        return len(self.slots)

    def dense(self, which) -> np.ndarray:
        x = np.zeros((len(which), SLOTS), np.float32)
        for i, k in enumerate(which):
            x[i, self.slots[k]] = self.n[k]
        return scaled(x)


def fit(x: Rows, y: np.ndarray, names: list[str], epochs: int = 20, rate: float = 0.5, l2: float = 1e-5) -> Coder:
    """y: class numbers. All bits at once, AdaGrad over shuffled batches; classes weigh alike."""
    m = Coder(names)
    if len(names) < 2:
        return m
    target = m.code[y]
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(names)), 1) / len(names))[y].astype(np.float32)[:, None]
    rng = np.random.default_rng(3)
    gw, gb = np.full_like(m.w, 1e-4), np.full_like(m.b, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            k = order[at : at + 128]
            part = x.dense(k)
            err = -target[k] / (1 + np.exp(np.clip(target[k] * (part @ m.w + m.b), -30, 30))) * weight[k]
            dw, db = part.T @ err / len(k) + l2 * m.w, err.mean(0)
            gw += dw * dw
            gb += db * db
            m.w -= rate * dw / np.sqrt(gw)
            m.b -= rate * db / np.sqrt(gb)
    right = np.zeros(target.shape[1])
    for at in range(0, len(y), 512):
        k = np.arange(at, min(at + 512, len(y)))
        right += ((x.dense(k) @ m.w + m.b) * target[k] > 0).sum(0)
    m.trust = np.maximum(2 * right / len(y) - 1, 0.05).astype(np.float32)
    return m


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Coder:
    def featurise(batches):
        for batch in batches:
            out, at = [], []
            for _, x, _ in counts(batch.column(1)):
                for r in x:
                    k = np.flatnonzero(r)
                    at.append(k.astype(np.int16).tobytes())
                    out.append(r[k].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(out, pa.binary())], names=["lang", "slots", "n"])

    sample, names = sampling.by_language(docs, rows, SAMPLE_ALL)
    got = arrow_map(sample, featurise, "lang string, slots binary, n binary").collect()  # a row has at most SLOTS entries
    got.sort(key=lambda r: (r["lang"], bytes(r["slots"]), bytes(r["n"])))
    names = sorted({r["lang"] for r in got})
    x = Rows([np.frombuffer(r["slots"], np.int16) for r in got], [np.frombuffer(r["n"], np.int32) for r in got])
    return fit(x, np.array([names.index(r["lang"]) for r in got], int), names)


def identify(docs: DataFrame, coder: Coder | None = None, rows: int = SAMPLE_ROWS, lead: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and `ambiguous` where the lead over the second language is small."""
    coder = coder or train(docs, rows)
    names = np.array([*coder.names, UNKNOWN], object)

    def run(batches):
        for batch in batches:
            pred, score, unsure = [], [], []
            for n, x, letters in counts(batch.column(1)):
                k, p, gap = coder.decode(scaled(x)) if coder.names else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                known = letters & bool(coder.names)
                pred.append(names[np.where(known, k, len(names) - 1)])
                score.append(np.where(known, p, 0.0))
                unsure.append(~known | (gap < lead))
            if pred:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score).astype(float)), pa.array(np.concatenate(unsure).astype(bool))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
