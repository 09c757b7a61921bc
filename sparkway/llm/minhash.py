"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Candidates. A set of word n-grams has `HASHES` least hashes, `ROWS` of them a band.
Sets that agree in a whole band are candidates: two sets of similarity s miss each
other in all bands with probability (1 - s^ROWS)^(HASHES/ROWS), at s = 0.8 under
10^-7.

Groups. Sets that buckets connect make a group (a chain over the sets of each bucket
suffices, so no pair is written), and sets of different groups are not similar but for
pairs missed in all bands. The n-grams of each grouped set are sent to the task of its
group, which compares all pairs there, and gives on one link for each component that is
joined, so a group of m sets makes at most m - 1 rows, whether or not they are similar.

Verification. In a task, signatures are compared a batch of `BATCH` hashes at a time.
After n hashes of which m agree, the similarity has, from a flat prior, the posterior
Beta(m + 1, n - m + 1); a pair is dropped as soon as the posterior probability that it
reaches the threshold is under `MISS`. Most pairs that share a boilerplate end after a
batch or two. What is left is verified exactly on the full sets. Agreement alone never
makes a link, and sets that have one label by then are not compared again.

Large groups. A group of more than a block is dealt out: each two of its blocks meet in a
task. One of more than `BLOCKS` blocks goes by bucket instead, after some rounds: in each
round every set is compared with one other, of those in its buckets and in another
component the one that meets most others (each bucket gives on its best two, of unlike
components); links are joined into components, and buckets that lie in one component
leave. After `ROUNDS` rounds, or as soon as pairs of different components are few, the
sets of each bucket meet as a group's do. What a bucket gives on is found by partial
aggregates and met by joins on the bucket, which adaptive execution splits.

Equal sets are collapsed into one first, in each batch and then by their 64-bit
hash; n-grams and sets are known by such hashes.

Null texts, and texts without words, have no n-grams and no links. Fewer than k words
make one n-gram. Very long texts are whole sets like others. Repeated rows are copies,
each with a row in the result. A null doc_id has no links of its own; it gets the
component of an equal set, and is kept if it has none. Ties between sets that
meet as many go to the larger hash. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_filter, materialize, passes
from .components import connected
from .jaccard import gram_sets, parts_of, set_id, similar
from .textvec import mix

HASHES, ROWS, BATCH = 128, 4, 32
#: Posterior probability of reaching the threshold under which a pair is dropped.
MISS = 1e-9
#: Rounds at most before the last; pairs of different components a row that may be left for it.
ROUNDS, LEFT = 5, 1
#: N-grams that are hashed at once.
GRAMS = 1 << 16
#: Sets and n-grams of a block; blocks of a group up to which each two of them meet, beyond it goes by bucket.
BLOCK_SETS, BLOCK_GRAMS, BLOCKS = 1024, 1 << 20, 8
_U = np.uint64


def families(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of n hash functions."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    return seeds[:n] | _U(1), seeds[n:]


def signatures(sets: list[np.ndarray], times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of each set (none empty) under each function."""
    grams, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(times)), np.uint16)
    for j, (a, b) in enumerate(zip(times, plus, strict=True)):
        # The low bits of the least product are mixed: its high bits are small by choice.
        out[:, j] = (mix(np.minimum.reduceat(grams * a + b, starts)) >> _U(48)).astype(np.uint16)
    return out


def least_agreeing(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch the fewest agreements so far with which a pair goes on.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(x: np.ndarray, y: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Flags of the pairs of signatures that no batch rules out."""
    going, agree = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        at = slice(i * batch, (i + 1) * batch)
        agree[going] += (x[going, at] == y[going, at]).sum(1)
        going = going[agree[going] >= m]
    out = np.zeros(len(x), bool)
    out[going] = True
    return out


def base_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id of every document, with the signature at a set's first row in its batch."""
    names = ["doc_id", "n_shingles", "set_id", "sig"]

    def run(batches):
        times, plus = families()
        for batch in batches:
            n, ids, sig, seen, sets, rows, held = [], [], [None] * batch.num_rows, set(), [], [], 0

            def sign():
                if sets:
                    for r, s in zip(rows, signatures(sets, times, plus), strict=True):
                        sig[r] = s.tobytes()
                    sets.clear()
                    rows.clear()

            for i, g in enumerate(gram_sets(batch.column(1), k)):
                s = set_id(g)
                n.append(len(g))
                ids.append(s)
                if len(g) and s not in seen:
                    seen.add(s)
                    sets.append(g)
                    rows.append(i)
                    held += len(g)
                    if held >= GRAMS:
                        sign()
                        held = 0
            sign()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sig, pa.binary())], names=names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, set_id long, sig binary")


def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, a, n, comp): the sets of every band value that several sets have, each its own label. `sets` should be materialized: it is read twice."""
    width = 2 * ROWS
    band = F.explode(F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))"))
    rows = sets.select(band.alias("bucket"), F.col("set_id").alias("a"), F.col("n_shingles").cast("int").alias("n"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    return rows.join(several, "bucket").withColumn("comp", F.col("a"))


def survivors(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those that the posterior does not rule out."""
    least = least_agreeing(num / den)
    x, y = (sets.select(F.col("set_id").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")

    def test(batches):
        for batch in batches:
            sx, sy = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(plausible(sx, sy, least)))

    return arrow_map(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb"), test, "a long, b long, na int, nb int")


def one_each(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, na, nb), a < b: each set with the one that meets most others, of those of another component that its buckets give on."""
    size = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    weight = rows.join(size, "bucket").groupBy("a").agg(F.sum("c").alias("w"))
    weighed = rows.join(weight, "a").select("bucket", "comp", F.struct("w", F.col("a").alias("hub"), F.col("n").alias("hn"), F.col("comp").alias("hcomp")).alias("m"))
    # The best of each component in a bucket, then the best two of these.
    top = weighed.groupBy("bucket", "comp").agg(F.max("m").alias("m"))
    first = top.groupBy("bucket").agg(F.max("m").alias("m1"))
    second = top.join(first, "bucket").where("m.hcomp != m1.hcomp").groupBy("bucket").agg(F.max("m").alias("m2"), F.first("m1").alias("m1"))
    met = rows.join(second, "bucket").withColumn("m", F.expr("if(comp = m1.hcomp, m2, m1)")).where(fits("n", "m.hn", num, den))
    best = met.groupBy("a", "n").agg(F.max("m").alias("m")).select("a", "n", "m.hub", "m.hn")
    return ordered(best)


def fits(n: str, m: str, num: int, den: int) -> str:
    """Sizes that allow a match."""
    return f"least({n}, {m}) * {den} >= greatest({n}, {m}) * {num}"


def ordered(met: DataFrame) -> DataFrame:
    pair = met.select(F.expr("if(a < hub, struct(a, hub as b, n as na, hn as nb), struct(hub as a, a as b, hn as na, n as nb))").alias("p"))
    return pair.select("p.*").distinct()


def unlike_pairs(rows: DataFrame) -> int:
    """How often two sets of a bucket differ in their label."""
    m = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return m.agg(F.sum(F.expr("(m * m - s) div 2"))).first()[0] or 0


def by_rounds(now: DataFrame, sets: DataFrame, named: DataFrame, k: int, num: int, den: int, scope: str) -> tuple[DataFrame | None, DataFrame]:
    """Links (a, b) that some rounds of one comparison a set find, and what is left of the buckets, labelled by them."""
    reps, links, tried = sets.select("set_id", "rep"), None, None
    total = now.count()
    for _ in range(ROUNDS):
        if unlike_pairs(now) <= LEFT * total:
            break
        pairs = one_each(now, num, den)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, scope)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        likely = materialize(survivors(pairs, sets, num, den), scope)
        new = materialize(similar(likely, materialize(parts_of(named, likely, reps, k), scope), num, den), scope)
        links = new if links is None else links.unionByName(new)
        comps = connected(links, scope)
        rest = now.drop("comp").join(comps.withColumnsRenamed({"node": "a", "comp": "_comp"}), "a", "left").select("bucket", "a", "n", F.coalesce("_comp", "a").alias("comp"))
        rest = materialize(rest, scope)
        open_ = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        now = materialize(rest.join(open_, "bucket"), scope)
    return links, now


def blocks_of(members: DataFrame) -> DataFrame:
    """Adds to (group, a, n) the blocks that the group has."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_GRAMS)).cast("int")
    return members.join(members.groupBy("group").agg(blocks.alias("blocks")), "group")


def dealt(members: DataFrame) -> DataFrame:
    """(group, x, y, a, comp): the sets of (group, a, comp, blocks) once for each task that their block meets another in; in one task if there is no other."""
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("_i")) | (F.col("blocks") == 1))
    met = members.withColumn("_i", own).withColumn("_j", F.explode(others))
    return met.select("group", F.least("_i", "_j").alias("x"), F.greatest("_i", "_j").alias("y"), "a", "comp")


def whole_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(a, grams, sig) of the wanted sets (set_id). Texts are not shuffled."""
    bits, words = id_filter(reps.join(wanted, "set_id").select("rep"))

    def run(batches):
        times, plus = families()

        def rows(sets):
            sig = [x.tobytes() for x in signatures(list(sets.values()), times, plus)] if sets else []
            return pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([g.tobytes() for g in sets.values()], pa.binary()), pa.array(sig, pa.binary())], names=["a", "grams", "sig"])

        for batch in batches:
            batch = batch.filter(pa.array(passes(words.value, batch.column(0).to_numpy())))
            sets, held = {}, 0
            for g in gram_sets(batch.column(1), k):
                if len(g):
                    sets[set_id(g)] = g
                    held += len(g)
                if held >= GRAMS:
                    yield rows(sets)
                    sets, held = {}, 0
            yield rows(sets)

    return arrow_map(docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("bit"), "text"), run, "a long, grams binary, sig binary")


def spanning(sets: list[np.ndarray], sig: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of places of similar sets, none empty, that join up all that are connected; sets of one label are so already."""
    n, least = np.array([len(g) for g in sets]), least_agreeing(num / den)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(n)[:-1])
    label, mark, out = label.copy(), np.zeros(len(values), bool), []
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num]
        j = j[plausible(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)]
        if not len(j):
            continue
        mark[codes[i]] = True
        common = np.add.reduceat(mark[np.concatenate([codes[x] for x in j])], np.cumsum([0, *n[j][:-1]]), dtype=np.int64)
        mark[codes[i]] = False
        hit = j[den * common >= num * (n[i] + n[j] - common)]
        joined, first = np.unique(label[hit], return_index=True)
        out += [(i, int(x)) for x in hit[first]]
        label[np.isin(label, joined)] = label[i]
    return out


def links_in(met: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join up what is connected in each task of (kind, group, x, y, a, comp)."""
    keys = ["kind", "group", "x", "y"]

    def run(t):
        # A set comes once for each row of its document.
        ids, at = np.unique(t.column("a").to_numpy(), return_index=True)
        grams, sig = t.column("grams").to_pylist(), t.column("sig").to_pylist()
        sets = [np.frombuffer(grams[i], np.uint64) for i in at]
        found = spanning(sets, np.frombuffer(b"".join(sig[i] for i in at), np.uint16).reshape(-1, HASHES), t.column("comp").to_numpy()[at], num, den)
        pairs = ids[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return met.join(whole, "a").groupBy(*keys).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, scope: str = "default") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links of num/den reach) and kept of every document."""
    base = materialize(base_rows(docs, k), scope)
    named = docs.where("doc_id is not null and text is not null")
    sets = materialize(base.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")), scope)
    reps = sets.select("set_id", "rep")
    now = materialize(buckets(sets), scope)
    chain = now.join(now.groupBy("bucket").agg(F.min("a").alias("b")), "bucket").select("a", "b")
    group = connected(chain, scope).select(F.col("node").alias("a"), F.col("comp").alias("group"))
    members = materialize(blocks_of(group.join(now.select("a", "n").distinct(), "a")).withColumn("comp", F.col("a")), scope)
    met, links, large = dealt(members.where(F.col("blocks") <= BLOCKS)).withColumn("kind", F.lit(0)), None, members.where(F.col("blocks") > BLOCKS)
    if not large.isEmpty():
        links, rest = by_rounds(materialize(now.join(large, "a", "left_semi"), scope), sets, named, k, num, den, scope)
        met = met.unionByName(dealt(blocks_of(rest.withColumnRenamed("bucket", "group"))).withColumn("kind", F.lit(1)))
    met = materialize(met, scope)
    new = materialize(links_in(met, whole_sets(named, met.select(F.col("a").alias("set_id")).distinct(), reps, k), num, den), scope)
    links = new if links is None else links.unionByName(new)
    comps = connected(links, scope).join(reps.withColumnRenamed("set_id", "node"), "node")
    least = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select(F.col("node").alias("set_id"), "component_id")
    found = reps.join(least, "set_id", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_id").join(found, "set_id", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
