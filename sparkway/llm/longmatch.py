"""Exact removal of long byte matches that occur earlier in the corpus.

A window of `LENGTH` bytes has one anchor: of its `GRAM`-byte substrings the one
of least hash, the leftmost on ties. Equal windows have equal anchors at equal
places, so they can only meet under one anchor. Windows that follow each other
under one anchor are one row (some thirty of them), with a fingerprint of the
bytes they span:

1. Rows with equal fingerprints hold equal windows. All but a batch's first are
   settled where they are read; the firsts meet under their anchor, once.
2. The bytes of distinct rows under anchors with several fingerprints are
   indexed, some thousand rows at a time and whole anchors only, in order of
   (doc_id, start): a run-compressed BWT with sampled run ends streams the match
   of every position with the suffix before it in order. Windows linked by
   matches of `LENGTH` are equal; all but the first of each class are repeats.
   Anchors with more than `HOT` rows, which would make one index too large, have
   their windows aggregated by hash instead.
3. Covered ranges are merged per document and cut.

Null texts are empty. Rows with a null doc_id are left whole and match nothing.
Repeated rows of a doc_id are the same document and don't remove each other. Of a
doc_id with several texts the one of least hash takes part; the others are left
whole and match nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, join_sized, materialize
from .fmindex import RunIndex
from .textvec import POWERS, buffers, byte_keys, chunks, mix

LENGTH, GRAM = 100, 32
#: Rows of one anchor that an index may hold, and rows from which an index is built.
HOT, SHARD = 20_000, 8_000
_U = np.uint64
RANGES = "doc_id long, a long, b long"


def prefix(body: np.ndarray, keys: np.ndarray):
    up, down = POWERS.get(len(body) + 1)
    acc = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(keys[body] * up[: len(body)], out=acc[1:])
    return acc, down


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def anchored(body: np.ndarray, offs: np.ndarray, keys: np.ndarray, length: int, gram: int):
    """(row, anchor hash, fingerprint, first window, windows) of each run of windows, starts counted in `body`."""
    size = np.maximum(np.diff(offs) - (length - 1), 0)
    none = np.zeros(0, np.int64)
    if not size.any():
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    acc, down = prefix(body, keys)
    n = len(body) - gram + 1
    h = mix((acc[gram:] - acc[:n]) * down[:n])
    least = sliding_min(h >> _U(32) << _U(32) | np.arange(n, dtype=np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(size)), size)
    p = np.arange(size.sum()) + np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    a = (least[p] & _U(0xFFFFFFFF)).astype(np.int64)
    st = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (row[1:] != row[:-1])) + 1])
    m = np.diff(np.append(st, len(a)))
    p0, anchor = p[st], a[st]
    print_ = mix((acc[p0 + m - 1 + length] - acc[p0]) * down[p0] + mix((anchor - p0).astype(np.uint64) << _U(32) | m.astype(np.uint64)))
    return row[st], h[anchor], print_, p0, m


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) merged within each doc; given in order of (doc, a)."""
    if not len(a):
        return doc, a, b
    # Ends made monotone across docs by an offset for each doc.
    place = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(b.max()) + 1)
    top = np.maximum.accumulate(b + place)
    new = np.concatenate([[True], (a + place)[1:] > top[:-1]])
    new[1:] |= doc[1:] != doc[:-1]
    st = np.flatnonzero(new)
    return doc[st], a[st], (top - place)[np.append(st[1:], len(a)) - 1]


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Batch-first rows (own = false), and ranges that the batch itself shows to be repeats (own = true)."""

    def run(batches):
        keys = byte_keys(False)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for lo, hi, body, offs in chunks(batch.column(1)):
                row, anchor, print_, p0, m = anchored(body, offs, keys, length, gram)
                parts.append((ids[lo:hi][row], anchor, print_, p0 - offs[row], m))
            if not parts:
                continue
            doc, anchor, print_, p0, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            key = mix(anchor ^ mix(print_))
            order = np.lexsort((p0, doc, key))
            k = key[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            lead, rest = order[first], order[~first]
            rest = rest[np.lexsort((p0[rest], doc[rest]))]
            # A repeated row of the same doc_id and place is no repeat.
            head = np.repeat(order[first], np.diff(np.append(np.flatnonzero(first), len(k))))
            same = np.zeros(len(k), bool)
            same[order] = (doc[head] == doc[order]) & (p0[head] == p0[order])
            rest = rest[~same[rest]]
            d, a, b = merged(doc[rest], p0[rest], p0[rest] + m[rest] - 1 + length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([anchor[lead], mix(d.astype(np.uint64) ^ mix(a.astype(np.uint64)))]).view(np.int64)),
                    pa.array(np.concatenate([print_[lead], np.zeros(len(d), np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([doc[lead], d])),
                    pa.array(np.concatenate([p0[lead], a])),
                    pa.array(np.concatenate([m[lead], b - a])),
                    pa.array(np.concatenate([np.zeros(len(lead), bool), np.ones(len(d), bool)])),
                ],
                names=["anchor", "print", "doc_id", "p", "m", "own"],
            )

    return arrow_map(docs, run, "anchor long, print long, doc_id long, p long, m long, own boolean")


def pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted rows (anchor, doc_id, p, m)."""
    asked = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "p", "m", "hot")).alias("w"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                t = text.as_buffer()
                rows += [(x["anchor"], x["hot"], doc, x["p"], x["m"], t[x["p"] : x["p"] + x["m"] - 1 + length].to_pybytes()) for x in w.as_py() if x["p"] + x["m"] - 1 + length <= len(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "hot", "doc_id", "p", "m", "bytes"])

    return arrow_map(docs.join(asked, "doc_id").select("doc_id", "text", "w"), run, "anchor long, hot boolean, doc_id long, p long, m long, bytes binary")


def window_hashes(column: pa.Array, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of each row's bytes, and each row's number of windows."""
    out, count = [np.zeros(0, np.uint64)], []
    for _, _, body, offs in chunks(column.cast(pa.large_binary()).view(pa.large_string())):
        acc, down = prefix(body, keys)
        n = np.diff(offs) - (length - 1)
        p = np.arange(n.sum()) + np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        out.append(mix((acc[p + length] - acc[p]) * down[p]))
        count.append(n)
    return np.concatenate(out), np.concatenate(count) if count else np.zeros(0, np.int64)


def ranges_batch(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((a, doc))
    doc, a, b = merged(doc[order], a[order], b[order])
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a), pa.array(b)], names=["doc_id", "a", "b"])


def compare(parts: DataFrame, length: int) -> DataFrame:
    """Ranges of windows that occur earlier under their anchor. Groups come sorted and are taken a few at a time."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        body, offs = buffers(table.column("bytes").chunk(0).cast(pa.large_binary()).view(pa.large_string()))
        n, size = len(offs) - 1, np.diff(offs)
        doc, p0 = (table.column(c).to_numpy() for c in ("doc_id", "p"))
        # A separator of its own after each row's bytes.
        row = np.repeat(np.arange(n), size)
        text = np.empty(len(body) + n, np.int32)
        start = offs[:-1] + np.arange(n)
        text[np.arange(len(body)) + row] = body.astype(np.int32) + n
        text[start + size] = np.arange(n)
        longest, other = RunIndex(text).matching(text)
        linked = longest >= length
        root = np.where(linked, other, np.arange(len(text)))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        least = np.arange(len(text))
        at = np.flatnonzero(linked)
        np.minimum.at(least, root[at], at)
        lead, own = least[root[np.concatenate([at, np.unique(root[at])])]], np.concatenate([at, np.unique(root[at])])
        r, q = (np.searchsorted(start, x, "right") - 1 for x in (own, lead))
        p, first = p0[r] + own - start[r], p0[q] + lead - start[q]
        later = (doc[r] != doc[q]) | (p != first)
        return ranges_batch(doc[r][later], p[later], p[later] + length)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= SHARD:
                table = pa.concat_tables(held)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if cut:
                    yield settle(table.slice(0, cut))
                    held, rows = [table.slice(cut)], table.num_rows - cut
        if held:
            yield settle(pa.concat_tables(held))

    return arrow_map(parts.drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "p"), run, RANGES)


def compare_hot(parts: DataFrame, length: int) -> DataFrame:
    """The same for large groups: windows are aggregated by hash, with partial aggregates."""

    def run(batches):
        for batch in batches:
            h, n = window_hashes(batch.column(4), byte_keys(False), length)
            row = np.repeat(np.arange(len(n)), n)
            doc, p0 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            p = p0[row] + np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            yield pa.RecordBatch.from_arrays([pa.array(mix(h ^ mix(batch.column(0).to_numpy().view(np.uint64))[row]).view(np.int64)), pa.array(doc[row]), pa.array(p)], names=["h", "doc_id", "p"])

    every = arrow_map(parts.select("anchor", "doc_id", "p", "m", "bytes"), run, "h long, doc_id long, p long")
    first = every.groupBy("h", "doc_id").agg(F.min("p").alias("fp")).groupBy("h").agg(F.min("doc_id").alias("fd"), F.min_by("fp", "doc_id").alias("fp"), F.count("*").alias("n"))
    later = every.join(first, "h").where((F.col("doc_id") != F.col("fd")) | (F.col("p") != F.col("fp")))
    return later.select("doc_id", F.col("p").alias("a"), (F.col("p") + length).alias("b"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, scope: str = "default") -> DataFrame:
    """doc_id and its covered ranges [a, b) of bytes, one array a document."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = anchor_rows(docs, length, gram).repartition("anchor")
    by_anchor, by_print = Window.partitionBy("anchor"), Window.partitionBy("anchor", "print")
    met = rows.withColumns({"_n": F.count("*").over(by_anchor), "_lo": F.min("print").over(by_anchor), "_hi": F.max("print").over(by_anchor)}).where("own or _n > 1")
    met = met.withColumn("_first", F.min("doc_id").over(by_print)).withColumn("_repeat", F.expr("own or doc_id > _first"))
    met = met.where("_repeat or _lo < _hi").select("_repeat", "anchor", "doc_id", "p", "m", "own", (F.col("_n") > hot).alias("hot"))
    met = materialize(met, scope)
    known = met.where("_repeat").select("doc_id", F.col("p").alias("a"), F.expr(f"p + if(own, m, m - 1 + {length})").alias("b"))
    open_ = met.where("not _repeat").select("anchor", "doc_id", "p", "m", "hot")
    parts = materialize(pieces(docs, open_, length), scope)
    found = known.unionByName(compare(parts.where("not hot"), length))
    if not open_.where("hot").isEmpty():
        found = found.unionByName(compare_hot(parts.where("hot"), length))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def one_text(docs: DataFrame, scope: str) -> DataFrame:
    """Adds own: whether the row's text takes part, as the one of least hash of its doc_id."""
    h = F.xxhash64("text")
    several = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(h).alias("least"), F.max(h).alias("_most")).where("least < _most").drop("_most")
    return join_sized(docs, materialize(several, scope), ["doc_id"]).withColumn("own", F.expr("least is null or xxhash64(text) = least")).drop("least")


def union(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, scope: str = "default") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed) of every document."""
    docs = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scope)
    found = repeats(docs.where("own"), length, gram, hot, scope)
    both = docs.join(found, "doc_id", "left").select("doc_id", "text", F.when(F.col("own"), F.col("ranges")).alias("ranges"))

    def run(batches):
        for batch in batches:
            out = []
            for text, r in zip(batch.column(1), batch.column(2), strict=True):
                b = (text.as_py() or "").encode()
                spans = union(r.as_py())
                kept, at = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(b[at:x])
                    at = y
                kept.update(b[at:])
                out.append((len(b), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return arrow_map(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
