"""Quality rules whose thresholds follow the data of each language and source.

Per document four ratios are taken, in parts per million. For every (language,
source) a mergeable quantile sketch of each ratio is kept: a log-linear
histogram whose buckets are the values rounded down to five significant bits
(relative error at most 1/16), so merging is adding counts and the result does
not depend on how rows were partitioned. The quartiles of the sketches give an
outlier fence per group; documents outside a fence are rejected by a join with
the table of fences.

A group with fewer than ``min_group`` documents takes the fences of its
language, and a language with fewer those of all documents, from the merged
sketches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import let, set_aside, words, written

SYMBOLS = "#*$%&|<>"
RATIOS = ("symbol", "word_len", "dup_line", "repeat")
SCALE = 1_000_000


@dataclass(frozen=True)
class Rules:
    """``reach`` spreads beyond the quartiles make the fence; a spread counts as
    at least ``least_spread`` (parts per million; of a character for the word
    length), so groups of almost equal documents keep normal ones."""

    reach: int = 4
    least_spread: tuple[int, ...] = (10_000, 500_000, 50_000, 100_000)
    min_group: int = 100
    min_words: int = 50
    max_repeat_percent: int = 50


POS_BITS = 24


def _repeated_words(h: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each counted once.

    ``h``: word hashes. Equal windows are neighbours after sorting (window hash,
    position). To sort plain longs, positions are packed under the upper hash
    bits; only windows whose upper bits repeat - a superset of the repeated ones -
    are then sorted by their full hash. The marked positions, in order, each cover
    up to three words that no later one covers. Texts beyond 2^24 windows skip
    the packing.
    """
    mask = F.lit(-2 ** POS_BITS).cast("long")
    high = lambda x: x.bitwiseAND(mask)                                       # noqa: E731
    window = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
    position = lambda x: x.bitwiseAND(F.lit(2 ** POS_BITS - 1).cast("long")).cast("int")
    starts = F.sequence(F.lit(0), F.size(h) - 3)

    def suspects(packed: Column) -> Column:
        after = F.filter(F.sequence(F.lit(1), F.size(packed) - 1),
                         lambda j: high(F.get(packed, j)) == high(F.get(packed, j - 1)))
        return F.array_distinct(F.flatten(F.transform(after, lambda j: F.array(
            position(F.get(packed, j - 1)), position(F.get(packed, j))))))

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))     # noqa: E731
        return F.sort_array(F.transform(F.filter(
            s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(pos: Column) -> Column:
        return F.aggregate(F.transform(pos, lambda p, j: F.least(
            F.lit(3), F.coalesce(F.get(pos, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    packed = F.sort_array(F.transform(starts, lambda i: high(window(i)).bitwiseOR(i.cast("long"))))
    where = F.when(F.size(h) > 2 ** POS_BITS, starts).otherwise(let(packed, suspects))
    exact = let(where, lambda p: F.sort_array(F.transform(p, lambda i: F.struct(
        window(i).alias("h"), i.alias("i")))))
    return F.when(F.size(h) < 4, F.lit(0)).otherwise(let(let(exact, marked), covered))


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed. Null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words(F.col("text"))).withColumns({
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.char_length(F.array_join(ws, "")).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(reduce(
            lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.transform(ws, lambda w: F.xxhash64(w)), _repeated_words).cast("long"),
    })
    out = out.drop("_words")
    failed = (F.col("n_words") < rules.min_words) | \
        (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _ratios() -> list[Column]:
    n = "greatest(n_words, 1)"
    return [F.expr(e).cast("long") for e in (
        f"(n_symbols * {SCALE}) div greatest(word_chars, 1)", f"(word_chars * {SCALE}) div {n}",
        f"(n_dup_lines * {SCALE}) div {n}", f"(n_repeat_words * {SCALE}) div {n}")]


def _bucket(v: Column) -> Column:
    """``v`` rounded down to its five leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) over the documents that pass the base rules."""
    each = measures.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("ratio"), _bucket(c).alias("bucket"))
        for k, c in enumerate(_ratios())])).alias("r"))
    return each.groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count("*").alias("n"))


def merge(sk: DataFrame, *keys: str) -> DataFrame:
    """The sketches merged to coarser groups: counts of equal buckets are added."""
    return sk.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sk: DataFrame, *keys: str) -> DataFrame:
    """Per group and ratio: documents, first and third quartile bucket."""
    group = [*keys, "ratio"]
    run = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*group)
    c = sk.select(*group, "bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(all_).alias("docs"))
    return c.groupBy(*group).agg(
        F.max("docs").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("bucket"))).alias("q3"))


def fences(sk: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (lang, source): ``low`` and ``high`` of every ratio, and the
    level the sketches came from (group, language or all)."""
    def wide(q: DataFrame, keys: list[str], name: str) -> DataFrame:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.get(
            F.array(*[F.lit(x) for x in rules.least_spread]), F.col("ratio")))
        q = q.withColumn("low", F.col("q1") - rules.reach * spread) \
            .withColumn("high", F.col("q3") + rules.reach * spread)
        return q.groupBy(*keys).agg(F.max("docs").alias(f"{name}_docs"), F.array_sort(F.collect_list(
            F.struct("ratio", "low", "high"))).alias(name))          # four entries

    group = wide(quartiles(sk, "lang", "source"), ["lang", "source"], "g")
    lang = wide(quartiles(merge(sk, "lang"), "lang"), ["lang"], "l")
    lang = lang.withColumnRenamed("lang", "_lang")
    total = wide(quartiles(merge(sk)), [], "a").first()              # one row
    if total is None:
        return sk.sparkSession.createDataFrame(
            [], "lang string, source string, level string, "
                "f array<struct<ratio:int,low:bigint,high:bigint>>")
    whole = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in (
        ("ratio", "int"), ("low", "long"), ("high", "long"))]) for r in total["a"] or []])
    out = group.join(lang, F.col("lang").eqNullSafe(F.col("_lang")))
    g, lg = F.col("g_docs") >= rules.min_group, F.col("l_docs") >= rules.min_group
    return out.select("lang", "source",
                      F.when(g, "group").when(lg, "language").otherwise("all").alias("level"),
                      F.when(g, F.col("g")).when(lg, F.col("l")).otherwise(whole).alias("f"))


BROADCAST_GROUPS = 20_000      # fences of this many groups are under 10 MB


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def learned_fences(measures: DataFrame, rules: Rules) -> DataFrame:
    """The fences of every (lang, source), under the names _lang, _source and _f;
    marked for broadcast if their groups are few."""
    f = written(fences(written(sketches(measures), "quality-sketches"), rules), "quality-fences")
    f = f.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("f").alias("_f"))
    return F.broadcast(f) if f.count() <= BROADCAST_GROUPS else f


def with_verdict(measures: DataFrame, f: DataFrame) -> DataFrame:
    """``measures`` with the column ``kept``."""
    j = measures.join(f, F.col("lang").eqNullSafe(F.col("_lang"))
                      & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = [c.between(F.get(F.col("_f"), F.lit(k))["low"], F.get(F.col("_f"), F.lit(k))["high"])
              for k, c in enumerate(_ratios())]
    ok = inside[0] & inside[1] & inside[2] & inside[3]
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))


def judged(docs: DataFrame, rules: Rules = Rules(), carry_text: bool = True) -> DataFrame:
    """``docs`` (needs text, lang, source) plus the measures, base_failed and kept.

    Null lang or source is a group of its own; other columns pass through (ones
    named like a measure are replaced), the text only with ``carry_text``. ``kept`` is false where a base rule fails or
    a ratio lies outside the fences of the document's group. An empty table
    gives no rows. The measures are written once and read twice, so texts are
    scanned a single time.
    """
    plain, back = set_aside(docs, ["text", "lang", "source"])
    m = measured(plain, rules)
    m = written(m if carry_text else m.withColumn("text", F.lit(None).cast("string")), "quality-measures")
    out = back(with_verdict(m, learned_fences(m, rules)), *MEASURES, "kept")
    return out if carry_text else out.drop("text")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    The fences are learned from written measures; a second scan measures each text again
    and filters it in place, so that no text is written or shuffled at any size.
    """
    plain, back = set_aside(docs, ["text", "lang", "source"])
    m = written(measured(plain.select("text", "lang", "source"), rules).drop("text"), "quality-measures")
    return back(with_verdict(measured(plain, rules), learned_fences(m, rules)).where("kept"))
