"""Best-fit packing of token sequences by exact complements.

Pieces are cut and counted where the texts are (one tokenizer pass). What the
plan needs of the corpus is its histogram of piece lengths, which has at most
`capacity` entries at any corpus size; the plan is a list of recipes
(lengths that fill a sequence, how often), a few per length. Ranks within a
length turn recipes into places without gathering the pieces of a length.

Null text is an empty document: it holds its end token only. Very long texts are cut
into pieces; their ids are held one text at a time. A null doc_id is packed like any.
Repeated rows are packed as often as they occur; pieces of one length are told apart
by their rank, so ties need no order. Columns other than doc_id and text are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_map, materialize, partitions, worker_cache

CAPACITY = 4096
#: Chunks in a generation of the encoder's memory.
WORDS_KEPT = 100_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Bytes that byte-level models write as other characters: those that don't print, in order, from U+0100.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class ChunkEncoder:
    """Ids of whole texts as little-endian bytes, by way of the ids of their white-space-free chunks.

    The tokenizer drops white space and joins nothing across it, so chunks are
    encoded alone and remembered. A chunk of letters up to U+00FF with a tail of
    stops is the two encoded apart, in lower case and by its bytes, which is what
    the tokenizer's own steps make of it before its model sees it. Two
    generations of at most `WORDS_KEPT` chunks are held.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Afterwards the young generation has all of `chunks`."""
        known, old, plain, tokenize = self.young, self.old, LETTERS.fullmatch, self.model.tokenize
        rest = []
        for c in chunks:
            if c in known:
                continue
            ids = old.get(c)
            if ids is None:
                core = c.rstrip(".,;:!?")
                if not plain(core):
                    rest.append(c)
                    continue
                low, tail = core.lower(), c[len(core) :]
                ids = known.get(low) or old.get(low)
                if ids is None:
                    seen = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
                    ids = known[low] = array("I", [t.id for t in tokenize(seen)]).tobytes()
                if tail:
                    stops = known.get(tail)
                    if stops is None:
                        stops = known[tail] = array("I", self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
                    ids += stops
            known[c] = ids
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [""] for t in texts]
        if len(self.young) > WORDS_KEPT:
            self.old, self.young = self.young, {"": b""}
        self.learn(set().union(*split))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]


def chunk_encoder(path: str) -> ChunkEncoder:
    """One per worker."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = ChunkEncoder(path)
    return cache["encoder", path]


def groups(texts: pa.Array, size: int = 1 << 19):
    """Lists of whole texts, of about `size` characters each."""
    held, n = [], 0
    for t in texts:
        held.append(t.as_py())
        n += len(held[-1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Token counts and checksums of the pieces that documents are cut into."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder = chunk_encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            encoded = (ids for texts in groups(batch.column(1)) for ids in encoder.encode(texts))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * min(n, start + capacity)]
                    out.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), cut, PIECE_SCHEMA)


class Stock:
    """Counts of unused pieces by length, with an index of the pair sums that the lengths in stock can make."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()
        self.pairs: np.ndarray | None = None

    def take(self, parts: list[int], times: int) -> None:
        for p in parts:
            self.n[p] -= times
            if not self.n[p]:
                self.pairs = None

    def pair_sums(self) -> np.ndarray:
        if self.pairs is None:
            have = (self.n > 0).astype(np.float64)
            size = 1 << (2 * len(have) - 1).bit_length()
            self.pairs = np.fft.irfft(np.fft.rfft(have, size) ** 2, size)[: len(have)] > 0.5
        return self.pairs

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.n[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the largest part."""
        a = np.arange(1, gap // 2 + 1)
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0) & ((2 * a != gap) | (self.n[a] > 1))
        hit = np.argmax(ok) if len(ok) else 0
        return [int(gap - a[hit]), int(a[hit])] if len(ok) and ok[hit] else None

    def triple(self, gap: int) -> list[int] | None:
        """The triple with the largest part."""
        big = np.arange(gap - 2, 0, -1)
        big = big[(self.n[big] > 0) & self.pair_sums()[gap - big]] if len(big) else big
        for c in map(int, big):
            self.n[c] -= 1
            rest = self.pair(gap - c)
            self.n[c] += 1
            if rest:
                return [c, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap) if gap > 0 else []


def recipes(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, times): longest first; gaps filled exactly by one, two or three pieces, else best fit.

    A recipe is repeated as often as the stock allows, so each uses up a length
    or leaves less than one more round of it: the list has a few entries a length.
    """
    stock, plan = Stock(counts), []
    longest = capacity
    while True:
        while longest and not stock.n[longest]:
            longest -= 1
        if not longest:
            return plan
        parts, gap = [longest], capacity - longest
        stock.n[longest] -= 1
        held = [longest]
        while gap:
            fill = stock.exact(gap)
            if fill is None:
                fits = np.flatnonzero(stock.n[1 : gap + 1])
                if not len(fits):
                    break
                fill = [int(fits[-1]) + 1]
            for p in fill:
                stock.n[p] -= 1
            held += fill
            parts += fill
            gap -= sum(fill)
        for p in held:
            stock.n[p] += 1
        need = {p: parts.count(p) for p in parts}
        times = int(min(stock.n[p] // k for p, k in need.items()))
        stock.take(parts, times)
        stock.pairs = None
        plan.append((parts, times))


def places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, the runs of ranks that a recipe's slot takes: rank lo+i sits in sequence first+i at `offset`."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for parts, times in plan:
        at = 0
        for p in parts:
            lo = used.get(p, 0)
            rows.append((p, lo, first, at))
            used[p] = lo + times
            at += p
        first += times
    return pd.DataFrame(rows, columns=["length", "lo", "first", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def pack(cut: DataFrame, capacity: int = CAPACITY, scope: str = "default") -> DataFrame:
    """Adds sequence_id and offset to a materialized table of pieces (columns of `pieces`)."""
    spark = cut.sparkSession
    salts = max(8, partitions(spark))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = materialize(cut.groupBy("length", "_salt").agg(F.count("*").alias("n")), scope)
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    runs = places(recipes(counts, capacity))
    # Rank of a piece within its length: ranks within (length, salt), shifted by what lower salts hold.
    shift = by_salt.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_shift"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(shift, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    key = runs["length"].to_numpy(np.int64) << 44 | runs["lo"].to_numpy(np.int64)
    lo, first, at = (runs[c].to_numpy(np.int64) for c in ("lo", "first", "offset"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy(np.int64)
        i = np.searchsorted(key, length.to_numpy(np.int64) << 44 | r, "right") - 1
        return pd.DataFrame({"sequence_id": first[i] + r - lo[i], "offset": at[i]})

    return ranked.withColumn("_at", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, scope: str = "default") -> DataFrame:
    """Cut, count, plan and place every document; one row per piece."""
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id), scope), capacity, scope)
