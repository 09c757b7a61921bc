"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

The model is trained from the small labelled table in `url_table`.

Null urls, and urls without `://`, have an empty host and path and are judged by
the method on that; the table holds that case as one to allow. Very long urls are
read whole. Rows are judged one by one: no shuffle, so repeated rows, ties and hot
hosts cost nothing extra. Columns other than page_id and url are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import url_table
from .common import arrow_map
from .textvec import byte_keys, chunks, mix, span_hash

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Lengths of the n-grams.
SIZES = (3, 4, 5, 6)


def split(url: str) -> tuple[str, str]:
    """Host and path of a url of the table."""
    rest = url.partition("://")[2]
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[at:]
    return rest[:at].lower(), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def training_urls() -> list[tuple[str, str, int]]:
    """The labelled table: (host, path, 1 to block)."""
    return [(*split(u), y) for text, y in ((url_table.BLOCK, 1), (url_table.ALLOW, 0)) for u in text.split()] + [("", "", 0)]


def grams(column: pa.Array, salt: int, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, slot) of the distinct n-grams of each text, its ends marked, for runs of rows."""
    marked = pc.binary_join_element_wise("^", column.cast(pa.string()), "$", "", null_handling="replace", null_replacement="")
    keys = byte_keys(lower=False) ^ mix(np.array([salt], np.uint64))
    for lo, hi, body, offs in chunks(marked, 1 << 18):
        row = np.repeat(np.arange(hi - lo), np.diff(offs))
        found = []
        for n in SIZES:
            at = np.arange(max(0, len(body) - n + 1))
            at = at[row[at] == row[at + n - 1]]
            found.append(row[at] * dims + (span_hash(body, at, at + n, keys) >> np.uint64(20)).astype(np.int64) % dims)
        both = np.unique(np.concatenate(found))
        yield hi - lo, both // dims, both % dims


def features(host: pa.Array, path: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, slot): n-grams of hosts in the lower half of the slots, of paths in the upper. Runs hold a few thousand urls, or one very long one."""
    for at in range(0, len(host), 4096):
        rows, slots, n = [], [], min(4096, len(host) - at)
        for salt, column in ((1, host), (2, path)):
            first = 0
            for k, row, slot in grams(column.slice(at, n), salt, dims // 2):
                rows.append(row + first)
                slots.append(slot + (salt - 1) * (dims // 2))
                first += k
        yield n, np.concatenate(rows), np.concatenate(slots)


def values(row: np.ndarray) -> np.ndarray:
    """The value of each n-gram: those of a url share unit length."""
    return np.bincount(row)[row] ** -0.5 if len(row) else np.zeros(0)


def fit(rows: list[tuple[str, str, int]] | None = None, dims: int = 1 << 15, rounds: int = 400, rate: float = 2.0, l2: float = 3e-4, caution: float = 1.0) -> np.ndarray:
    """Weights by full-batch gradient descent; the last is the bias. A url to allow weighs `caution` times one to block."""
    rows = training_urls() if rows is None else rows
    ((_, row, slot),) = features(pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), dims)
    used, at = np.unique(slot, return_inverse=True)  # weights of other slots stay 0
    x = np.zeros((len(rows), len(used) + 1), np.float32)
    x[row, at] = values(row)
    x[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    weight = np.where(y > 0, 1, caution).astype(np.float32)
    weight /= weight.sum()
    w = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * (x.T @ ((p - y) * weight) * 4 + l2 * w)
    out = np.zeros(dims + 1, np.float32)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def scores(host: pa.Array, path: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probability of `block` for each url."""
    out = [np.zeros(0)]
    for n, row, slot in features(host, path, len(weights) - 1):
        z = np.bincount(row, weights[slot] * values(row), n) + weights[-1]
        out.append(1 / (1 + np.exp(-z)))
    return np.concatenate(out)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0), F.lit(""))
    return host, path


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, training=None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the regression's score of every url."""
    weights = fit(training)
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(1), batch.column(2), weights))], names=schema.names)

    base = arrow_map(base, run, schema)
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
