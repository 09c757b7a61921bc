"""Substring dedup by sliding sentence spans.

A text is parted into sentences (ended by . ! ? before white space, or by a line
break), and these into pieces at content-defined places: where the hash of the
two words around is a least one within `REACH` places. Whether a place is an edge
hangs on the few words around it only, so equal passages have equal edges
whatever stands before them, with or without stops. From every edge a span runs
over at least `LEAST_PIECES` pieces and `LEAST_WORDS` words. Spans are hashed by
their words (A-Z lower-cased, punctuation and spacing left out) and joined
globally: the first occurrence, by (doc_id, place), stays; pieces that any other
occurrence covers are removed. n_removed counts the sentences that lose words.

Of a span that a batch of documents holds several times only the first goes on;
the others are settled there and then, as runs of pieces, so a passage that a third
of the documents share costs one row a batch. The firsts meet under their hash in one
shuffle. Spans of one document are gathered in one row, bounded by its own text.

Null texts stay null. Rows with a null doc_id are kept as they are. Repeated
rows (one doc_id, one text) are the same document, so they don't remove each other;
rows of one doc_id with different texts are documents of their own, in the order of
their texts' hashes. Copies under other ids lose all but short texts. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, fresh
from .textvec import ALNUM, byte_class, byte_keys, chunks, mix, span_hash, words

REACH, LEAST_PIECES, LEAST_WORDS = 3, 3, 16
STOP, SPACE = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)), byte_class((0x20, 0x20), (0x09, 0x0D))
_U = np.uint64


def content_edges(h: np.ndarray, row: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Flags of words before which a sentence is cut by content, none within `REACH` places of a hard edge or a row's end."""
    c = np.zeros(len(h), np.uint64)
    c[1:] = mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])
    ok = ~hard
    for k in range(1, REACH + 1):
        inside = row[k:] == row[:-k]
        ok[k:] &= inside & ~hard[:-k] & (c[k:] <= c[:-k])
        ok[:-k] &= inside & ~hard[k:] & (c[:-k] <= c[k:])
        ok[-k:] = False
    return ok


def sentences(body: np.ndarray, offs: np.ndarray, keys: np.ndarray):
    """Words (start, end, hash); first words of pieces (one more at the end) and their sentences' numbers; the first piece of each row (one more)."""
    s, e, first = words(body, offs, ALNUM)
    h = span_hash(body, s, e, keys)
    n = len(body)
    last = np.zeros(n, bool)
    if n:
        last[:-1] = STOP[body[:-1]] & SPACE[body[1:]]
        last |= body == 0x0A
    stops = np.concatenate([[0], np.cumsum(last)])
    # A word begins a sentence if a stop lies between it and the word before, or if it is a row's first.
    begin = np.zeros(len(s), bool)
    begin[1:] = stops[s[1:]] > stops[e[:-1]]
    begin[first[:-1][first[:-1] < len(s)]] = True
    at = np.flatnonzero(begin | content_edges(h, np.repeat(np.arange(len(offs) - 1), np.diff(first)), begin))
    return s, e, h, np.append(at, len(s)), np.cumsum(begin)[at], np.searchsorted(at, first)


def spans(body: np.ndarray, offs: np.ndarray, keys: np.ndarray):
    """(row, first piece, end piece, hash) of every span; pieces counted from the row's first."""
    _, _, h, at, _, rows = sentences(body, offs, keys)
    n = len(at) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    i = np.arange(n)
    # Forward: the nearest end with enough pieces and words. Ends that none reaches get the shortest span backward.
    end = np.maximum(i + LEAST_PIECES, np.searchsorted(at, at[:-1] + LEAST_WORDS))
    ok = end <= rows[row + 1]
    a, b = i[ok], end[ok]
    reached = np.zeros(n + 1, bool)
    reached[b] = True
    j = np.flatnonzero(~reached[1:]) + 1
    start = np.minimum(j - LEAST_PIECES, np.searchsorted(at, at[j] - LEAST_WORDS, "right") - 1)
    good = (start >= 0) & (start >= rows[row[j - 1]])
    a, b = np.concatenate([a, start[good]]), np.concatenate([b, j[good]])
    up = np.multiply.accumulate(np.full(len(h) + 1, 0xC6BC279692B5C323 | 1, np.uint64))
    down = np.multiply.accumulate(np.full(len(h) + 1, pow(0xC6BC279692B5C323 | 1, -1, 1 << 64), np.uint64))
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    wa, wb = at[a], at[b]
    return row[a], a - rows[row[a]], b - rows[row[a]], mix((acc[wb] - acc[wa]) * down[wa] + (wb - wa).astype(np.uint64))


def merged(doc: np.ndarray, txt: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The spans of each document (doc_id, hash of its text), those that overlap or touch as one."""
    order = np.lexsort((a, txt, doc))
    doc, txt, a, b = doc[order], txt[order], a[order], b[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1])
    step = np.cumsum(new) * (int(b.max(initial=0)) + 1)
    top = np.maximum.accumulate(b + step)
    new[1:] |= (a + step)[1:] > top[:-1]
    at = np.flatnonzero(new)
    return doc[at], txt[at], a[at], (top - step)[np.append(at[1:], len(doc)) - 1] if len(at) else b


def span_rows(docs: DataFrame) -> DataFrame:
    """Batch-first spans, and those that the batch itself shows to be repeats, under a hash of their own.

    A span [a, b) is one long, a in the upper half; that of a settled repeat is negated and one less.
    """

    def run(batches):
        keys = byte_keys(lower=True)
        for batch in batches:
            ids, texts, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for lo, hi, body, offs in chunks(batch.column(2)):
                row, a, b, h = spans(body, offs, keys)
                parts.append((h, ids[lo:hi][row], texts[lo:hi][row], a, b))
            if not parts:
                continue
            h, doc, txt, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((b, a, txt, doc, h))
            k = h[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            head = np.repeat(order[first], np.diff(np.append(np.flatnonzero(first), len(k))))
            later = (doc[head] != doc[order]) | (txt[head] != txt[order]) | (a[head] != a[order])
            lead, rest = order[first], order[~first & later]
            d, t, lo, hi = merged(doc[rest], txt[rest], a[rest], b[rest])
            out = np.concatenate([h[lead], mix(d.astype(np.uint64) ^ mix(t.view(np.uint64) ^ mix(lo.astype(np.uint64))))])
            span = np.concatenate([a[lead] << 32 | b[lead], ~(lo << 32 | hi)])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(np.concatenate([doc[lead], d])), pa.array(np.concatenate([txt[lead], t])), pa.array(span)], names=["h", "doc_id", "txt", "span"])

    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("txt"), "text")
    return arrow_map(named, run, "h long, doc_id long, txt long, span long")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, and its spans of pieces that occur earlier, as one array of longs as in `span_rows`, none negated."""
    rows = span_rows(docs).repartition("h")
    first = F.min(F.when(F.col("span") >= 0, F.struct("doc_id", "txt"))).over(Window.partitionBy("h"))
    later = rows.withColumn("first", first).where("span < 0 or struct(doc_id, txt) > first")
    return later.groupBy("doc_id", "txt").agg(F.collect_set(F.expr("if(span < 0, ~span, span)")).alias("spans"))


def cut(text: bytes, covered: list[tuple[int, int]], keys: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the covered pieces; its number of sentences, and how many lost words."""
    body = np.frombuffer(text, np.uint8)
    s, _, _, at, of, _ = sentences(body, np.array([0, len(body)]), keys)
    n = int(of[-1]) if len(of) else 0
    edge = np.zeros(len(at), np.int64)
    for a, b in covered:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    if not gone.any():
        return text, n, 0
    # A piece holds the bytes from its first word to the next piece's.
    begin = np.append(s[at[:-1]], len(body))
    kept, head = [text[: begin[0]]] if not gone[0] else [], True
    for i in np.flatnonzero(~gone):
        kept.append(text[begin[i] : begin[i + 1]])
    return b"".join(kept), n, len(np.unique(of[gone]))


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with cleaned texts (n_chars, if there, follows), and n_sentences and n_removed."""
    found = repeated(docs)
    spare, txt, spans_, n_all, n_gone = fresh(docs.columns, "_id", "_txt", "_spans", "n_sentences", "n_removed")
    left = docs.select("text", *(F.col(f"`{c}`") for c in docs.columns if c != "text")).withColumns({spare: F.col("doc_id").cast("long"), txt: F.xxhash64("text")})
    both = left.join(found.select(F.col("doc_id").alias(spare), F.col("txt").alias(txt), F.col("spans").alias(spans_)), [spare, txt], "left").drop(spare, txt)
    schema = both.drop(spans_).schema.add(n_all, "long").add(n_gone, "long")

    def run(batches):
        keys = byte_keys(lower=True)
        for batch in batches:
            texts, n, gone = [], [], []
            for t, c in zip(batch.column(0), batch.column(batch.num_columns - 1), strict=True):
                t = t.as_py()
                if t is None:
                    out, k, m = None, 0, 0
                else:
                    out, k, m = cut(t.encode(), [(x >> 32, x & 0xFFFFFFFF) for x in c.as_py() or []], keys)
                    out = out.decode()
                texts.append(out)
                n.append(k)
                gone.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[f.name for f in schema])

    out = arrow_map(both, run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(n_all).alias(n_all), F.col(n_gone).alias(n_gone))
