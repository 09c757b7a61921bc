"""Benchmark decontamination by an FM-index of each shard of the corpus.

A shard is a run of documents as they come from the scan. Its words are mapped
to the benchmark's alphabet; words outside it part the text, and runs shorter
than the shortest window, which can't hold one, are left out. The rest is
indexed; every window is searched backward through the wavelet ranks, its
occurrences located by sampled suffix positions, and the hits merged into spans.
Nothing is shuffled: documents are judged where they are read.

The benchmark's windows travel to the executors in groups of at most
`GROUP_BYTES` of text; a larger benchmark takes several passes over the rows.

Null texts have no words. Items without words are skipped, as are null item_ids.
Repeated documents are judged as often as they occur, repeated items count once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh
from .fmindex import FMIndex
from .textvec import ALNUM, byte_keys, chunks, span_hash, words

WINDOW = 10
SHARD_BYTES = 2 << 20
GROUP_BYTES = 16 << 20
#: What a pass adds to, after a table's own columns.
STATE = ("_hits", "_items", "_words", "_starts", "_ends")


class Windows:
    """Distinct windows of a group of items, over an alphabet of the group's words (1, 2, ...)."""

    def __init__(self, items: list[tuple[int, str]], width: int = WINDOW) -> None:
        column = pa.array([t for _, t in items], pa.large_string())
        keys = byte_keys(lower=True)
        every: list[tuple[int, np.ndarray]] = []
        at = 0
        for lo, hi, body, offs in chunks(column):
            s, e, first = words(body, offs, ALNUM)
            h = span_hash(body, s, e, keys)
            every += [(items[at + i][0], h[first[i] : first[i + 1]]) for i in range(hi - lo)]
            at += hi - lo
        self.alphabet = np.unique(np.concatenate([h for _, h in every])) if every else np.zeros(0, np.uint64)
        owners: dict[tuple, set[int]] = {}
        for item, h in every:
            sym = np.searchsorted(self.alphabet, h) + 1
            for i in range(max(1, len(sym) - width + 1) if len(sym) else 0):
                owners.setdefault(tuple(sym[i : i + width].tolist()), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), width), np.int64)
        for i, w in enumerate(owners):
            self.patterns[i, : len(w)] = w
        self.owners = [sorted(o) for o in owners.values()]
        self.least = int(self.lengths.min()) if len(owners) else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == h, i + 1, 0)


def occurrences(sym: np.ndarray, first: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) for all occurrences within rows."""
    none = np.zeros(0, np.int64)
    if not windows.least or not len(sym):
        return none, none
    known = sym > 0
    begin, stop = known.copy(), known.copy()
    begin[1:] &= ~known[:-1]
    stop[:-1] &= ~known[1:]
    cut = first[(first > 0) & (first < len(sym))]
    begin[cut] = known[cut]
    stop[cut - 1] = known[cut - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= windows.least
    a, b = a[long], b[long]
    if not len(a):
        return none, none
    # The kept runs, a separator after each; `where` leads back to word numbers.
    size = b - a + 1
    ends = np.cumsum(size)
    where = np.repeat(a - (ends - size), size) + np.arange(ends[-1])
    text = np.append(sym, 0)[np.minimum(where, len(sym))]
    text[ends - 1] = 0
    index = FMIndex(text, len(windows.alphabet) + 1)
    lo, hi = index.search(windows.patterns, windows.lengths)
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(found, n), where[index.locate(rows)]


def scan(rows: DataFrame, items: list[tuple[int, str]], width: int, finish=None, schema=None) -> DataFrame:
    """One pass: adds this group's hits to the state columns. Column 0 is the text. The last pass ends with `finish`, in the same worker."""
    last = finish is not None
    windows = Windows(items, width)
    keys = byte_keys(lower=True)

    def run(batches):
        for batch in batches:
            state = len(batch.schema.names) - 5
            hits, found, count, starts, ends = [], [], [], [], []
            before = batch.column(state).to_pylist(), batch.column(state + 1).to_pylist()
            at = 0
            for lo, hi, body, offs in chunks(batch.column(0), SHARD_BYTES):
                s, e, first = words(body, offs, ALNUM)
                window, pos = occurrences(windows.symbols(span_hash(body, s, e, keys)), first, windows)
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, pos, 1)
                np.add.at(edge, pos + windows.lengths[window], -1)
                row = np.searchsorted(first, pos, "right") - 1
                items_of: dict[int, set[int]] = {}
                for r, w in np.unique(np.stack([row, window], 1), axis=0).tolist() if len(row) else []:
                    items_of.setdefault(r, set()).update(windows.owners[w])
                flags = np.cumsum(edge[:-1]) > 0
                for i in range(hi - lo):
                    f = flags[first[i] : first[i + 1]]
                    old = before[0][at + i]
                    if old:
                        f = f | np.unpackbits(np.frombuffer(old, np.uint8), count=len(f)).astype(bool)
                    hits.append(np.packbits(f).tobytes() if f.any() else b"")
                    found.append(sorted(items_of.get(i, set()) | set(before[1][at + i] or [])))
                    count.append(len(f))
                    if last:  # merged spans, in bytes from the start of the text
                        k = np.flatnonzero(f)
                        new, end = (np.concatenate([[True], k[1:] != k[:-1] + 1]), np.concatenate([k[1:] != k[:-1] + 1, [True]])) if len(k) else (k == 0, k == 0)
                        starts.append((s[first[i] + k[new]] - offs[i]).tobytes())
                        ends.append((e[first[i] + k[end]] - offs[i]).tobytes())
                at += hi - lo
            blank = [b""] * len(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:state], pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(count, pa.int64()), pa.array(starts if last else blank, pa.binary()), pa.array(ends if last else blank, pa.binary())], names=batch.schema.names)

    return arrow_map(rows, (lambda batches: finish(run(batches))) if last else run, schema if last else rows.schema)


def find(docs: DataFrame, benchmark: DataFrame, width: int, finish, schema) -> DataFrame:
    """What `finish` makes of `docs` (text first) with the state columns: hit words, items, word count, and spans to remove."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + int(total) // GROUP_BYTES
    rows = docs.select("text", *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    blank = F.lit(b"").cast("binary")
    rows = rows.withColumns(dict(zip(fresh(docs.columns, *STATE), (blank, F.expr("cast(array() as array<bigint>)"), F.lit(0).cast("long"), blank, blank), strict=True)))
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).distinct().collect()
        last = (finish, schema) if g == groups - 1 else ()
        rows = scan(rows, sorted((r["item_id"], r["text"]) for r in part), width, *last)
    return rows


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items and spans (byte ranges)."""

    def digest(batches):
        for batch in batches:
            doc, n, hits, items, starts, ends = (batch.column(c).to_pylist() for c in ("doc_id", "_words", "_hits", "_items", "_starts", "_ends"))
            hit = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in hits]
            sha = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for i in items]
            spans = [[{"start": a, "end": b} for a, b in zip(np.frombuffer(s, np.int64).tolist(), np.frombuffer(e, np.int64).tolist(), strict=True)] for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<start:long,end:long>>"
    return find(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), benchmark, width, digest, schema)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with the merged spans cut out of their texts; n_chars, if there, follows."""
    own = ["text", *(c for c in docs.columns if c != "text")]
    state = len(own)

    def cut(batches):
        for batch in batches:
            text = []
            for t, s, e in zip(batch.column(0).to_pylist(), batch.column(state + 3).to_pylist(), batch.column(state + 4).to_pylist(), strict=True):
                if s:
                    b, at, kept = t.encode(), 0, []
                    for x, y in zip(np.frombuffer(s, np.int64), np.frombuffer(e, np.int64), strict=True):
                        kept.append(b[at:x])
                        at = y
                    t = (b"".join(kept) + b[at:]).decode()
                text.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *batch.columns[1:state]], names=batch.schema.names[:state])

    schema = T.StructType([docs.schema[c] for c in own])
    out = find(docs, benchmark, width, cut, schema).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
