"""Adaptive quality rules, in DataFrame functions only.

Base counts are exact over whole texts. In place of fixed cutoffs, each
(lang, source) group has its own fences, read from mergeable KLL sketches of the
group's documents: far beyond the quartiles, by a multiple of the spread. A
group of n documents has the weight n / (n + PRIOR) against its language, whose
fences come of the merged sketches of its groups, and a language likewise against
the corpus; so a group of any size bears on its own fences, and a document more
never moves them by a jump. A sketch has a fixed size, so a hot group costs partial
aggregates only.

Null text has no words and fails the base rule. Very long texts are counted whole.
Null lang or source form groups of their own. Other columns are not read. Repeated rows count and are judged as often as they occur. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize

SPACES = "\t\n\x0b\x0c\r"
#: name -> (least spread, side): a document is rejected beyond quartile +/- FENCE * max(spread, least).
MEASURES = {"symbol_rate": (0.02, 1), "dup_line_rate": (0.10, 1), "repeat_rate": (0.10, 1), "mean_word": (1.0, 1), "mean_word_low": (1.0, -1)}
FENCE = 3.0
#: Documents for which the fences of the next larger group count in a blend.
PRIOR = 10


def counted(docs: DataFrame, text: str = "text", window_hash: str = "xxhash64({0}, {1}, {2})") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to the other columns.

    Repeated 3-word windows are found by sorting, in each row, 64-bit keys that
    hold the window's hash above its position; neighbours with equal hashes are
    compared word by word, and where neither is equal all windows with that hash are,
    so a chance collision neither adds nor hides a repeat. `window_hash` is SQL of three words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flat = t
    for c in SPACES:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    one = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split(flat, " ", -1), ""))
    two = one.withColumn("n_words", F.size("_w").cast("long")).withColumn("_lines", lines)
    two = two.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bits": F.length(F.bin(F.col("n_words"))),
    }).drop("_lines", "_t")
    key = f"transform(sequence(1, cast(n_words as int) - 2), i -> shiftleft({window_hash.format('_w[i - 1]', '_w[i]', '_w[i + 1]')}, _bits) | i)"
    three = two.withColumn("_k", F.expr(f"case when n_words > 3 then sort_array({key}) else cast(array() as array<bigint>) end"))
    near = "(shiftright(x, _bits) = shiftright(_k[{j}], _bits))"
    four = three.withColumn("_p", F.expr(f"filter(_k, (x, j) -> (j > 0 and {near.format(j='greatest(j - 1, 0)')}) or (j < n_words - 3 and {near.format(j='least(j + 1, cast(n_words as int) - 3)')}))"))
    low = "cast(x & (shiftleft(1L, _bits) - 1) as int)"
    # Candidates in key order: keep those whose words equal those of the one before or after.
    def same(other: str) -> str:
        return " and ".join(f"_w[_q[j] + {d}] = _w[_q[{other}] + {d}]" for d in (-1, 0, 1))

    five = four.withColumn("_q", F.expr(f"transform(_p, x -> {low})")).drop("_k", "_p")
    ok = same("greatest(j - 1, 0)"), same("least(j + 1, size(_q) - 1)")
    far = "exists(_q, y -> y != x and " + " and ".join(f"_w[y + {d}] = _w[x + {d}]" for d in (-1, 0, 1)) + ")"
    six = five.withColumn("_r", F.expr(f"sort_array(filter(_q, (x, j) -> (j > 0 and {ok[0]}) or (j < size(_q) - 1 and {ok[1]}) or {far}))")).drop("_q", "_w")
    return six.withColumn("n_repeat_words", F.expr("aggregate(transform(_r, (x, j) -> if(j + 1 < size(_r), least(3, _r[least(j + 1, size(_r) - 1)] - x), 3)), 0L, (s, v) -> s + v)")).drop("_r", "_bits")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def measured(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.withColumns({
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / n * 10,
        "repeat_rate": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
        "mean_word_low": F.col("word_chars") / n,
    })


SKETCHED = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_word")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The number of documents in each group, and a KLL sketch of each measure."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.kll_sketch_agg_double(m).alias(m) for m in SKETCHED))


def merged(sketched: DataFrame, keys: list[str]) -> DataFrame:
    return sketched.groupBy(*keys).agg(F.sum("_n").alias("_n"), *(F.kll_merge_agg_double(m).alias(m) for m in SKETCHED))


def fences(sketched: DataFrame, keys: list[str], fence: float = FENCE) -> DataFrame:
    """Upper (or lower) fence of each measure in each group, from its sketches."""
    cols = []
    for name, (least, side) in MEASURES.items():
        m = name.removesuffix("_low")
        q = [F.kll_sketch_get_quantile_double(m, F.lit(p)) for p in (0.25, 0.75)]
        spread = F.greatest(q[1] - q[0], F.lit(least))
        cols.append((q[1] + fence * spread if side > 0 else q[0] - fence * spread).alias(f"_f_{name}"))
    return sketched.select(*keys, "_n", *cols)


def blended(own: DataFrame, wider, prior: float) -> DataFrame:
    """`own` with each fence moved towards wider(name), the more the fewer documents it comes of."""
    w = F.col("_n") / (F.col("_n") + F.lit(float(prior)))
    return own.withColumns({f"_f_{m}": w * F.col(f"_f_{m}") + (1 - w) * wider(f"_f_{m}") for m in MEASURES})


def group_fences(rows: DataFrame, fence: float = FENCE, prior: float = PRIOR, scope: str = "default") -> DataFrame:
    """Fences of each (lang, source), blended with those of its language, and these with the corpus's."""
    sketched = materialize(sketches(rows, ["lang", "source"]), scope)
    # One row of numbers; without documents that have words there are none.
    whole = {} if sketched.isEmpty() else fences(merged(sketched, []), [], fence).first().asDict()
    lang = blended(fences(merged(sketched, ["lang"]), ["lang"], fence), lambda f: F.lit(whole.get(f)).cast("double"), prior)
    lang = materialize(lang.select(F.col("lang").alias("_of"), *(F.col(f"_f_{m}").alias(f"_l_{m}") for m in MEASURES)), scope)
    few = lang.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = fences(sketched, ["lang", "source"], fence).join(F.broadcast(lang) if few else lang, F.col("lang").eqNullSafe(F.col("_of")))
    return blended(both, lambda f: F.col(f.replace("_f_", "_l_", 1)), prior).select("lang", "source", *(f"_f_{m}" for m in MEASURES))


def judge(docs: DataFrame, fence: float = FENCE, prior: float = PRIOR, scope: str = "default") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    rows = materialize(measured(counted(docs.select("doc_id", "text", "lang", "source")).drop("text")), scope)
    scored = rows.where(F.col("n_words") > 0)
    group = materialize(group_fences(scored, fence, prior, scope), scope).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    few = group.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(group) if few else group, on, "left")
    verdict = F.lit(True)
    for m, (_, side) in MEASURES.items():
        edge = F.col(f"_f_{m}")
        verdict = verdict & F.coalesce(F.col(m) <= edge if side > 0 else F.col(m) >= edge, F.lit(True))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"))
