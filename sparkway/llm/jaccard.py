"""Exact Jaccard similarity join on word n-grams by vertical partitioning.

The global order of n-grams puts those that many sets hold last, and goes by
64-bit hash otherwise. Every set is cut along it, and overlaps are counted in each
fragment by itself:

Candidates come from the fragment that stands first in the order: the n - ceil(t n)
+ 1 first n-grams of a set. Two sets of n-grams with Jaccard >= t share at least
one of them, so their overlap counted there is not zero. Rows (n-gram, set) meet
in one shuffle; n-grams met once go out at once, and so do pairs whose sizes, or
whose places of the n-gram in both orders, leave too few n-grams for a match: at the
first one that two sets share, what stands before it in either is not shared.

Verification. Each set has a parity sketch of two bits an n-gram and more: an n-gram
flips one, so sketches differ in no more bits than sets do in n-grams, and pairs
whose sketches differ in more are out. The sets of the others are cut into
vertical parts by hash range; overlaps are counted part by part, and summed per pair.

Which n-grams are frequent is counted over all texts: those that `LEAST` or more of
some `UNIT` n-grams' worth of sets share are summed. The order bears on speed alone,
any order gives the same links. The list has at most mean size / `FREQUENT` entries.

Large groups. Of the sets that share an n-gram the `HUBS` that have least before it,
so are nearest to what all have in common, are compared with all others, and leave;
then sets are labelled by the most linked set that they are similar to, and n-grams
whose remaining sets have one label leave. This goes on for a few rounds while pairs
of different labels are many, then all of these are compared. Sets with one label are
connected, so no component is lost, and a group of m near copies costs some m pairs.

Equal sets are first collapsed into one (in each batch, then by hash), so groups of
copies cost one row a batch. Sets are known by a 64-bit hash.

Null texts, and texts without words, have no n-grams and no links. Fewer than k
words make one n-gram. Very long texts are whole sets like others. Repeated rows are
copies, each with a row in the result. A null doc_id has no links of its own; it
gets the component of an equal set. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, id_filter, materialize, passes
from .components import connected
from .textvec import NOT_SPACE, byte_keys, chunks, mix, runs_of, span_hash, words

#: Vertical parts in which overlaps are counted.
PARTS = 4
#: Sets of an n-gram that are compared with all its others in one round; rounds at most before the last; pairs of different labels a row that may be left for it.
HUBS, ROUNDS, LEFT = 4, 2, 64
#: N-grams that are counted together, sets among them that make one worth summing, and the share of all sets that makes it frequent.
UNIT, LEAST, FREQUENT = 1 << 21, 3, 0.001
_U = np.uint64


def gram_sets(column: pa.Array, k: int, lut: np.ndarray = NOT_SPACE):
    """The sorted distinct n-gram hashes of each row, in order of rows."""
    keys = byte_keys(lower=True)
    for lo, hi, body, offs in chunks(column):
        s, e, first = words(body, offs, lut)
        h = span_hash(body, s, e, keys)
        grams = runs_of(h, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                g = np.sort(grams[a : b - k + 1])
            elif b > a:
                g = runs_of(h[a:b], b - a) ^ _U(b - a)
            else:
                g = grams[:0]
            if len(g) > 1:
                g = g[np.concatenate([[True], g[1:] != g[:-1]])]
            yield g


def set_id(g: np.ndarray) -> int:
    """64 bits of a set."""
    return int(mix(mix(g).sum(dtype=np.uint64, keepdims=True) + _U(len(g))).view(np.int64)[0])


def sketch(g: np.ndarray) -> bytes:
    """Parities of the counts of n-grams in slots, two bits an n-gram and more, a power of two."""
    size = 1 << max(9, (2 * len(g) - 1).bit_length())
    slot = np.bincount((mix(g ^ _U(0x8CB92BA72F3D8DD7)) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(slot.astype(np.uint8)).tobytes()


def sketches_differ(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ; the longer, folded, is the sketch of the shorter's length."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Order:
    """The global order, and the first fragment of a set at a threshold of num/den."""

    def __init__(self, num: int, den: int, frequent: np.ndarray | None = None) -> None:
        self.num, self.den = num, den
        self.frequent = np.zeros(0, np.uint64) if frequent is None else np.sort(frequent)

    def first(self, n: int) -> int:
        """N-grams of the first fragment; none if no other set can be similar."""
        return n - -(-self.num * n // self.den) + 1 if n * (self.den - self.num) >= self.num else 0

    def fragment(self, g: np.ndarray) -> np.ndarray:
        p = self.first(len(g))
        if not len(self.frequent) or not p:
            return g[:p]
        i = np.minimum(np.searchsorted(self.frequent, g), len(self.frequent) - 1)
        rare = self.frequent[i] != g
        out = g[rare][:p]
        return out if len(out) == p else np.concatenate([out, g[~rare][: p - len(out)]])


def base_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set id and sketch of every document (met null); rows of n-grams that some sets share (set_id: the n-gram, met: how many)."""
    names = ["doc_id", "n_shingles", "set_id", "bits", "met"]

    def batch_of(doc, n, ids, bits, met):
        return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()), met], names=names)

    def shared(sets):
        h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        h, n = h[n >= LEAST], n[n >= LEAST]
        return batch_of(pa.nulls(len(h), pa.int64()), np.zeros(len(h), np.int64), h.view(np.int64), [None] * len(h), pa.array(n.astype(np.int64)))

    def run(batches):
        sets, seen, held = [], set(), 0
        for batch in batches:
            n, ids, bits = [], [], []
            for g in gram_sets(batch.column(1), k):
                s = set_id(g)
                n.append(len(g))
                ids.append(s)
                bits.append(sketch(g))
                if s not in seen:
                    seen.add(s)
                    sets.append(g)
                    held += len(g)
                if held >= UNIT:
                    yield shared(sets)
                    sets, seen, held = [], set(), 0
            yield batch_of(batch.column(0), n, ids, bits, pa.nulls(len(n), pa.int64()))
        yield shared(sets)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, set_id long, bits binary, met long")


def frequent_grams(base: DataFrame, n_sets: int, share: float = FREQUENT) -> np.ndarray:
    """N-grams in at least `share` of the sets, as far as counted: at most mean size / share of them."""
    found = base.where("met is not null").groupBy("set_id").agg(F.sum("met").alias("n")).where(F.col("n") >= max(LEAST + 1, share * n_sets)).select("set_id").toArrow()
    return found.column(0).to_numpy().view(np.uint64)


def fragment_rows(docs: DataFrame, k: int, order: Order) -> DataFrame:
    """(n-gram, set, size, place in the order) for the first fragment of each distinct set in a batch."""
    # The array alone travels: an object of this package in a broadcast would need the package on the executors.
    num, den, frequent = order.num, order.den, docs.sparkSession.sparkContext.broadcast(order.frequent)

    def rows(grams, ids, size):
        reps = [len(x) for x in grams]
        col = lambda v, t: pa.array(np.repeat(np.array(v, t), reps))
        place = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(r, dtype=np.int32) for r in reps)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64)), col(ids, np.int64), col(size, np.int32), place], names=["gram", "a", "n", "p"])

    def run(batches):
        order = Order(num, den, frequent.value)
        for batch in batches:
            seen, grams, ids, size, held = set(), [], [], [], 0
            for g in gram_sets(batch.column(0), k):
                s = set_id(g)
                if s in seen:
                    continue
                seen.add(s)
                x = order.fragment(g)
                grams.append(x)
                ids.append(s)
                size.append(len(g))
                held += len(x)
                if held >= 100_000:
                    yield rows(grams, ids, size)
                    grams, ids, size, held = [], [], [], 0
            yield rows(grams, ids, size)

    return arrow_map(docs.select("text"), run, "gram long, a long, n int, p int")


def likely(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those whose sketches differ in no more bits than similar sets may."""
    both = pairs.join(sketches.select(F.col("set_id").alias("a"), F.col("bits").alias("ga")), "a").join(sketches.select(F.col("set_id").alias("b"), F.col("bits").alias("gb")), "b")

    def test(batches):
        for batch in batches:
            most = (batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()) * (den - num) // (den + num)
            keep = [sketches_differ(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) <= d for x, y, d in zip(batch.column(4), batch.column(5), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(both.select("a", "b", "na", "nb", "ga", "gb"), test, "a long, b long, na int, nb int")


def parts_of(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """(set, part, n-grams) of the sets that occur in pairs, in vertical parts of the hash order. Texts are not shuffled."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    ids = reps.join(wanted, "set_id").select("rep")
    bits, words_ = id_filter(ids)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(words_.value, batch.column(0).to_numpy())))
            ids, part, grams, held = [], [], [], 0
            for g in gram_sets(batch.column(1), k):
                s = set_id(g)
                edge = np.searchsorted(g, (np.arange(1, parts) * ((1 << 64) // parts)).astype(np.uint64))
                for p, x in enumerate(np.split(g, edge)):
                    if len(x):
                        ids.append(s)
                        part.append(p)
                        grams.append(x.tobytes())
                        held += x.nbytes
                if held >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], names=["set_id", "part", "grams"])
                    ids, part, grams, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], names=["set_id", "part", "grams"])

    return arrow_map(docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("bit"), "text"), run, "set_id long, part int, grams binary")


def similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those whose overlaps, summed over the parts, reach the threshold."""
    left = pairs.join(sets.select(F.col("set_id").alias("a"), "part", F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("set_id").alias("b"), "part", F.col("grams").alias("gb")), ["b", "part"])

    def overlap(batches):
        for batch in batches:
            n = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "part", "common"])

    counted = arrow_map(both.select("a", "b", "na", "nb", "ga", "gb", "part"), overlap, "a long, b long, na int, nb int, part int, common long")
    # A part counts once even if a document's row is repeated.
    total = counted.groupBy("a", "b", "na", "nb", "part").agg(F.max("common").alias("common")).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def labels(links: DataFrame) -> DataFrame:
    """(a, _comp): for each linked set the one with most links, of itself and those it is linked with."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.groupBy("a").agg(F.count("*").alias("c"))
    near = both.join(count.withColumnRenamed("a", "b"), "b").select("a", "b", "c").unionByName(count.select("a", F.col("a").alias("b"), "c"))
    return near.groupBy("a").agg(F.max(F.struct("c", "b")).alias("_m")).select("a", F.col("_m.b").alias("_comp"))


def unlike_pairs(sets: DataFrame) -> int:
    """How often two sets of an n-gram differ in their label."""
    m = sets.groupBy("gram", "comp").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return m.agg(F.sum(F.expr("(m * m - s) div 2"))).first()[0] or 0


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, scope: str = "default") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    base = materialize(base_rows(docs, k), scope)
    rows = base.where("met is null")
    named = docs.where("doc_id is not null and text is not null")
    reps = materialize(rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep")), scope)
    order = Order(num, den, frequent_grams(base, reps.count()))
    by_gram = Window.partitionBy("gram")
    # N-grams that more than one distinct set has in its first fragment.
    met = fragment_rows(named, k, order).repartition("gram").groupBy("gram", "a").agg(F.max("n").alias("n"), F.min("p").alias("p")).withColumn("_m", F.count("*").over(by_gram)).where("_m > 1").drop("_m")
    met = materialize(met.withColumn("comp", F.col("a")), scope)
    sketches = materialize(rows.join(met.select(F.col("a").alias("set_id")).distinct(), "set_id", "left_semi").where("doc_id is not null").groupBy("set_id").agg(F.first("bits").alias("bits")), scope)
    total, links, now = met.count(), None, met
    for turn in range(ROUNDS + 1):
        ranked = now.withColumn("_k", F.row_number().over(by_gram.orderBy("p", "n", "a")))
        last = turn == ROUNDS or turn > 0 and unlike_pairs(now) <= LEFT * total
        cols = ("a", "n", "p", "comp", "_k")
        x, y = (ranked.select("gram", *(F.col(c).alias(f"{c}_{t}") for c in cols)) for t in "xy")
        near = f"least(n_x, n_y) * {den} >= greatest(n_x, n_y) * {num} and least(n_x - p_x, n_y - p_y) * {den + num} >= (n_x + n_y) * {num}"
        pairs = (x if last else x.where(F.col("_k_x") <= HUBS)).join(y, "gram").where(f"_k_x < _k_y and comp_x != comp_y and {near}")
        one, two = (F.expr(f"if(a_x < a_y, struct(a_{i} as a, n_{i} as n), struct(a_{j} as a, n_{j} as n))") for i, j in ("xy", "yx"))
        pairs = pairs.select(one.alias("x"), two.alias("y")).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
        pairs = materialize(likely(pairs, sketches, num, den), scope)
        new = materialize(similar(pairs, materialize(parts_of(named, pairs, reps, k), scope), num, den), scope)
        links = new if links is None else links.unionByName(new)
        if last:
            break
        # Hubs are done with; n-grams whose rest has one label too. Sets with links to one hub are connected.
        label = labels(links)
        rest = ranked.where(F.col("_k") > HUBS).select("gram", "a", "n", "p").join(label, "a", "left").select("gram", "a", "n", "p", F.coalesce("_comp", "a").alias("comp"))
        rest = rest.withColumns({"_lo": F.min("comp").over(by_gram), "_hi": F.max("comp").over(by_gram)}).where("_lo < _hi").drop("_lo", "_hi")
        now = materialize(rest, scope)
        if now.isEmpty():
            break
    comps = connected(links.select("a", "b"), scope).join(reps.withColumnRenamed("set_id", "node"), "node")
    least = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select(F.col("node").alias("set_id"), "component_id")
    found = reps.join(least, "set_id", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(found, "set_id", "left")
    # A set without n-grams is linked with nothing.
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
