"""How filters overlap: what each removes, alone and after others, in every order.

Five filters judge every text (null: empty); words are `[^\\x20\\x09-\\x0D]+`, and a
text fails

A  with under 100 words,
B  with distinct words under 80 % of its words,
C  with `[A-Z]` over 10 % of its code points,
D  if it holds any of `#$%&*|`,
E  if a row of a smaller doc_id has the same text.

E is found by sorting: rows are dealt into ranges of (fingerprint of the text,
doc_id) and sorted there by fingerprint, whole text and doc_id, so that equal texts
are neighbours and a row is a duplicate if the row before it has its text. A group of
copies, however large, is cut by doc_id over as many ranges as it needs. At the
boundaries, a range gives on the texts of its last fingerprint, and takes for the
first row of each text of its first fingerprint whether an earlier range had that text
(known there by fingerprint and SHA-256): a few narrow rows a range.

The failures of a document are a mask of five bits. Masks are summed with the
documents' labels into at most 32 counters a part, which add up over tasks; all
orders and steps are read off these, without the documents.

Null and empty texts are equal, and fail A. A row without doc_id has no smaller id
and is nobody's earlier copy, so it never fails E and never makes another fail;
repeated rows of a doc_id are documents of their own that don't make each other fail.
A document has a label if any of the rows of `labels` with its doc_id has it. Null
and empty parts are one. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .textvec import NOT_SPACE, buffers, byte_class, byte_keys, chunks, span_hash, words

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 100, 80, 10
CAPITALS, SYMBOLS = byte_class((0x41, 0x5A)), byte_class((0x23, 0x26), (0x2A, 0x2A), (0x7C, 0x7C))
MASKS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")


def text_masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails, A the lowest."""
    keys, out = byte_keys(lower=False), np.zeros(len(column), np.int64)
    for lo, hi, body, offs in chunks(column):
        s, e, first = words(body, offs, NOT_SPACE)
        n = np.diff(first)
        row = np.repeat(np.arange(hi - lo), n)
        h = span_hash(body, s, e, keys)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=hi - lo)
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])  # noqa: E731, B023
        fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PCT * n, 100 * count(CAPITALS[body]) > MOST_CAPITALS_PCT * count(body & 0xC0 != 0x80), count(SYMBOLS[body]) > 0)
        out[lo:hi] = sum(f.astype(np.int64) << i for i, f in enumerate(fails))
    return out


def sorted_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every document, E judged within its range of the sort.

    Rows of a range's first fingerprint that have no copy before them there carry the
    range, fingerprint and SHA-256 (`pid`, `print`, `digest`). Rows with mask null are the
    boundary's: texts of the range's last fingerprint.
    """
    names = ["doc_id", "part", "mask", "pid", "print", "digest"]
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        pid = TaskContext.get().partitionId()
        # The range's first fingerprint; (fingerprint, text) of the run of equal texts, its first doc_id; texts of the last fingerprint.
        start = head = lead = None
        tail: dict[tuple[int, bytes], None] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            mask = text_masks(batch.column(2))
            body, offs = buffers(batch.column(2))
            prints, ids = batch.column(3).to_numpy(), batch.column(0)
            doc, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            size = np.diff(offs)
            # Neighbours of equal fingerprint and length are compared byte by byte.
            new = np.ones(n, bool)
            for i in (np.flatnonzero((prints[1:] == prints[:-1]) & (size[1:] == size[:-1])) + 1).tolist():
                new[i] = not np.array_equal(body[offs[i] : offs[i + 1]], body[offs[i - 1] : offs[i]])
            one, digest = [None] * n, [None] * n
            start = int(prints[0]) if start is None else start
            begins = np.flatnonzero(new).tolist()
            for at, end in zip(begins, [*begins[1:], n], strict=True):
                key = int(prints[at]), body[offs[at] : offs[at + 1]].tobytes()
                if head != key:
                    head, lead = key, None
                own = np.flatnonzero(known[at:end]) + at
                if not len(own):
                    continue
                lead = int(doc[own[0]]) if lead is None else lead
                mask[own[doc[own] > lead]] |= DUPLICATE
                if key[0] == start or key[0] == prints[-1]:
                    sha = hashlib.sha256(key[1]).digest()
                    tail[key[0], sha] = None
                    for i in own[doc[own] == lead].tolist() if key[0] == start else ():
                        one[i], digest[i] = pid, sha
            tail = {k: None for k in tail if k[0] == prints[-1]}
            rows = (ids, batch.column(1), mask, one, prints, digest)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)
        k = len(tail)
        cols = ([None] * k, [None] * k, [None] * k, [pid] * k, [p for p, _ in tail], [d for _, d in tail])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("print", F.xxhash64("text"))
    ranged = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    return arrow_map(ranged, run, "doc_id long, part string, mask int, pid int, print long, digest binary")


def masks(docs: DataFrame, scope: str = "default") -> DataFrame:
    """doc_id, part and mask of every document, over all ranges."""
    found = materialize(sorted_masks(docs), scope)
    seen = found.where("mask is null").groupBy("print", "digest").agg(F.min("pid").alias("_at"))
    first = found.where("mask is not null and digest is not null").join(seen, ["print", "digest"], "left")
    settled = first.select("doc_id", "part", F.expr(f"if(_at < pid, mask | {DUPLICATE}, mask)").alias("mask"))
    return found.where("mask is not null and digest is null").select("doc_id", "part", "mask").unionByName(settled)


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic; rows of one doc_id are added up before they meet the labels."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    each = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def interactions(docs: DataFrame, labels: DataFrame, scope: str = "default") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = counters(masks(docs, scope), labels)
    # At most 32 entries a part, null where no document has the mask.
    at = [F.first(F.when(F.col("mask") == m, F.struct("n", "good", "toxic")), ignorenulls=True) for m in range(MASKS)]
    parts = sums.groupBy("part").agg(F.array(*at).alias("c"))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(f"{''.join(o)}", k + 1, bit[f], sum(bit[x] for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    plan = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"p":{p}}}' for o, s, b, p in steps) + "]"), "array<struct<o:string,s:int,b:int,p:int>>"))

    def total(field: str, test, times=None) -> Column:
        """Sum of a field over the masks that pass the test."""
        terms = F.transform("c", lambda x, m: F.when(test(m), F.coalesce(x[field], F.lit(0)) * (times(m) if times else 1)).otherwise(0))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    b, p = F.col("e.b"), F.col("e.p")
    hit = lambda m: m.bitwiseAND(b) != 0
    gone = lambda m: m.bitwiseAND(p) != 0
    orders = len(list(permutations(FILTERS)))
    rows = parts.select("part", "c", plan.alias("e"))
    return rows.select(
        "part",
        F.col("e.o").alias("filter_order"),
        F.col("e.s").alias("step"),
        total("n", lambda m: ~hit(m) & ~gone(m)).alias("kept"),
        total("n", lambda m: hit(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: hit(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == b).alias("unique_fails"),
        total("good", lambda m: hit(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: hit(m) & ~gone(m)).alias("toxic_lost"),
        # Of the filters that a document fails, each is the first in an equal share of the orders.
        total("n", hit, lambda m: F.floor(F.lit(orders) / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"),
    )
