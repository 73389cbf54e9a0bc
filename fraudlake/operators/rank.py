"""Exact order statistics without single-task windows.

A global ``row_number()`` or a running sum over row-level data puts every row
into one task. The helpers here keep all row-level work in partitioned
aggregates and only ever move small, bounded tables to the driver:

* :func:`cut_tuples` finds the rows at given ranks of a lexicographic order
  ``(key nulls last, tie)`` inside each group. Groups of at most FINAL_ROWS
  rows (a million) are answered by one bounded ordered pick; larger ones are
  first narrowed around about ``N_BINS`` quantile values per level. Values are
  only ever compared, in the column's own type, so fractions, extremes and
  infinities give the same rows either way. A heavy
  key value is resolved on the tie column instead, so a key holding a third of
  all rows costs nothing extra.
* :func:`before_cut` turns a cut tuple into a row predicate.
* :func:`values_at_ranks` is the same selection for a numeric column per part
  (exact medians without a per-column value buffer).
* :func:`prefix_sums` computes running sums over an ordered, already grouped
  table with literal bucket bounds: bucket totals (tiny) give offsets, the
  window runs partitioned by ``(group, bucket)``.
* :func:`ordinal_codes` numbers sorted distinct values per part; a part too
  large for one task is cut at sampled literal bounds first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.functions.buckets import block_ends, block_size, count_less_array, count_less_arrays

FINAL_ROWS = 1_000_000  # candidates at most this many: finish with one bounded sort
N_BINS = 64            # quantile values per narrowing level


@dataclass
class _Target:
    subset: int           # index of a disjoint row subset
    rank: int             # 0-based rank inside the subset
    lo: int | None = None
    hi: int | None = None
    below: int = 0        # rows of the subset with value < lo
    count: int = 0        # rows of the subset with lo <= value <= hi
    value: int | None = None
    eq: int = 0           # rows of the subset equal to the resolved value


def _subset_id(preds: list[Column]) -> Column:
    expr = F.lit(None).cast("int")
    for i in range(len(preds) - 1, -1, -1):
        expr = F.when(preds[i], F.lit(i)).otherwise(expr)
    return expr


def _select_values(df: DataFrame, col: str, subsets: list[Column], ranks: list[list[int]],
                   stats: dict | None = None) -> dict[tuple[int, int], tuple]:
    """Value of column ``col`` (numbers, dates or timestamps; no nulls) at each rank inside
    disjoint subsets.

    ``stats`` may give ``{subset: (n, lo, hi)}`` already known to the caller
    (lo/hi None: not known), which saves the first pass.
    Returns ``{(subset, rank): (value, rows_below_value, rows_equal_value)}``.
    """
    if not subsets:
        return {}
    base = df.select(_subset_id(subsets).alias("_sid"), F.col(col).alias("_v")) \
        .where(F.col("_sid").isNotNull())
    if stats is not None and all(sid in stats for sid in range(len(subsets))):
        st_map = stats
    else:
        st_map = {r["_sid"]: (r["n"], r["lo"], r["hi"]) for r in base.groupBy("_sid").agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            .collect()}
    targets = []
    for sid, rs in enumerate(ranks):
        st = st_map.get(sid)
        for r in rs:
            if st is None or r >= st[0]:
                continue
            targets.append(_Target(sid, r, st[1], st[2], 0, st[0]))
    while True:
        active = [t for t in targets if t.value is None]
        for t in active:
            if t.lo is not None and t.lo == t.hi:
                t.value, t.eq = t.lo, t.count
        active = [t for t in active if t.value is None]
        if not active:
            break
        small = [t for t in active if t.count <= FINAL_ROWS]
        big = [t for t in active if t.count > FINAL_ROWS]
        if small:
            _finish_small(base, small)
        if big:
            _narrow(base, big)
    return {(t.subset, t.rank): (t.value, t.below, t.eq) for t in targets}


def _range_groups(targets: list[_Target]) -> dict[tuple, list[_Target]]:
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.subset, t.lo, t.hi), []).append(t)
    return groups


def _range_id(groups) -> Column:
    expr = F.lit(None).cast("int")
    for i, (sid, lo, hi) in reversed(list(enumerate(groups))):
        cond = F.col("_sid") == sid
        if lo is not None:
            cond = cond & F.col("_v").between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, F.lit(i)).otherwise(expr)
    return expr


def _finish_small(base: DataFrame, targets: list[_Target]) -> None:
    """At most FINAL_ROWS candidates per range: a bounded ordered pick."""
    groups = _range_groups(targets)
    keys = list(groups)
    picks = {(g, t.rank - t.below) for g, k in enumerate(keys) for t in groups[k]}
    w = Window.partitionBy("_g").orderBy("_v")
    cand = (base.select(_range_id(keys).alias("_g"), "_v").where(F.col("_g").isNotNull())
            .withColumn("_p", F.row_number().over(w) - 1))
    wanted = reduce(lambda a, b: a | b,
                    [(F.col("_g") == g) & (F.col("_p") == p) for g, p in picks])
    # count of rows strictly below the picked value inside the range
    same = Window.partitionBy("_g", "_v")
    cand = (cand.withColumn("_below", F.min("_p").over(same))
            .withColumn("_eq", F.count(F.lit(1)).over(same)).where(wanted))
    found = {(r["_g"], r["_p"]): (r["_v"], r["_below"], r["_eq"]) for r in cand.collect()}
    for g, k in enumerate(keys):
        for t in groups[k]:
            v, b, eq = found[(g, t.rank - t.below)]
            t.value, t.eq = v, eq
            t.below += b


def _cut_values(lo, hi, quantiles: list) -> list:
    """Cuts of the range lo..hi (None: not known yet). Quantiles of integers and
    decimals pass through a double; where that cannot tell the range apart, even
    steps do. The ends are cuts too, so every level splits the range."""
    if lo is None:
        return sorted(set(quantiles))
    inside = {q for q in quantiles if lo < q < hi}
    if not inside and not isinstance(lo, float):
        inside = {lo + (hi - lo) * i // N_BINS for i in range(1, N_BINS)} if isinstance(lo, int) \
            else {lo + (hi - lo) / 2}
    return sorted({lo, hi} | inside)


def _narrow(base: DataFrame, targets: list[_Target]) -> None:
    """One level: every active range is cut at quantile values of its rows. The rows
    equal to a cut value are a class of their own, so a class is either one value
    or lies strictly between two cuts."""
    groups = _range_groups(targets)
    keys = list(groups)
    cand = base.select(_range_id(keys).alias("_g"), "_v").where(F.col("_g").isNotNull())
    marks = [i / N_BINS for i in range(1, N_BINS)]
    cuts = {r["_g"]: _cut_values(keys[r["_g"]][1], keys[r["_g"]][2], r["q"])
            for r in cand.groupBy("_g").agg(
                F.percentile_approx("_v", marks, max(1000, 20 * N_BINS)).alias("q")).collect()}
    bounds = reduce(lambda acc, g: F.when(F.col("_g") == g, F.lit(cuts[g])).otherwise(acc),
                    cuts, F.lit(None))
    v = F.col("_v")
    place = 2 * F.size(F.filter("_cuts", lambda c: c < v)) + F.array_contains("_cuts", v).cast("int")
    hist = (cand.withColumn("_cuts", bounds).groupBy("_g", place.alias("_b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
            .collect())
    per_group: dict[int, list] = {}
    for r in hist:
        per_group.setdefault(r["_g"], []).append(r)
    for g, k in enumerate(keys):
        bins = sorted(per_group.get(g, []), key=lambda r: r["_b"])
        for t in groups[k]:
            need = t.rank - t.below
            acc = 0
            for r in bins:
                if acc + r["n"] > need:
                    if (r["n"], r["mn"], r["mx"]) == (t.count, t.lo, t.hi) and t.lo != t.hi:
                        raise RuntimeError(f"rank selection makes no progress in {k}")
                    t.below += acc
                    t.lo, t.hi, t.count = r["mn"], r["mx"], r["n"]
                    break
                acc += r["n"]


def cut_tuples(df: DataFrame, group_col: str | None, key_col: str, tie_col: str,
               ranks, known: dict | None = None) -> dict:
    """Row at each 0-based rank of ``(key asc nulls last, tie asc)`` per group.

    ``ranks`` maps group value -> list of ranks (``group_col=None``: key ``None``),
    or is a callable ``(group, n) -> list of ranks`` evaluated after counting.
    ``known`` may give ``{group: (n, non-null keys, min key, max key)}``
    when the caller has the sizes already (small groups need no profile).
    ``tie`` must be unique within a group and non-null. Returns
    ``{(group, rank): (key_value_or_None, tie_value)}``; ranks beyond the group
    size are omitted (every row is before them).

    Passes over the data: one profile (counts, key range per group), one or
    more narrowing levels for the key, one bounded pick of the tie column
    (skipped when key and tie are the same column).
    """
    cols = ([group_col] if group_col else []) + list(dict.fromkeys([key_col, tie_col]))
    # every pass reads only (group, key, tie) from the source again
    if known is not None and all(n <= FINAL_ROWS for (n, *_rest) in known.values()):
        # every group is small and its size is known: one ordered pick, no profile
        return _cut_tuples(df.select(*cols), group_col, key_col, tie_col, ranks, known)
    return _cut_tuples(df.select(*cols), group_col, key_col, tie_col, ranks)


def _cut_tuples(df: DataFrame, group_col, key_col: str, tie_col: str, ranks,
                known: dict | None = None) -> dict:
    gcol = F.col(group_col) if group_col else F.lit(None)
    counts = {}
    if known is not None:
        counts = dict(known)
    else:
        agg = df.groupBy(gcol.alias("_grp")).agg(
            F.count(F.lit(1)).alias("n"), F.count(key_col).alias("nn"),
            F.min(key_col).alias("lo"), F.max(key_col).alias("hi")).collect()
        for r in agg:
            counts[r["_grp"]] = (r["n"], r["nn"], r["lo"], r["hi"])
    if callable(ranks):
        ranks = {g: ranks(g, c[0]) for g, c in counts.items()}

    def gpred(g):
        return gcol.isNull() if g is None else (gcol == F.lit(g))

    # groups of at most FINAL_ROWS rows: one bounded ordered pick for all of them
    small = [g for g in ranks if 0 < counts.get(g, (0,))[0] <= FINAL_ROWS
             and any(r < counts[g][0] for r in ranks[g])]
    out_small = _direct_pick(df, gcol, gpred, small, ranks, key_col, tie_col) if small else {}
    groups = [g for g in ranks if g not in small]

    # phase A: key value at the rank among non-null keys
    subs_a, ranks_a, idx_a, stats_a = [], [], {}, {}
    for g in groups:
        n, nn, lo, hi = counts.get(g, (0, 0, None, None))
        rs = [r for r in ranks[g] if r < nn]
        if rs:
            idx_a[g] = len(subs_a)
            stats_a[len(subs_a)] = (nn, lo, hi)
            subs_a.append(gpred(g) & F.col(key_col).isNotNull())
            ranks_a.append(rs)
    found_a = _select_values(df, key_col, subs_a, ranks_a, stats_a)

    # phase B: tie value inside (group, key == v) or (group, key is null)
    same_col = key_col == tie_col
    subs_b: list[Column] = []
    ranks_b: list[list[int]] = []
    stats_b: dict = {}
    sub_index: dict[tuple, int] = {}
    plan = {}
    out = {}
    for g in groups:
        n, nn, _, _ = counts.get(g, (0, 0, None, None))
        for r in ranks[g]:
            if r >= n:
                continue
            if r < nn:
                v, below, eq = found_a[(idx_a[g], r)]
                if same_col:
                    out[(g, r)] = (v, v)
                    continue
                skey, pred, rr, size = (g, v), gpred(g) & (F.col(key_col) == F.lit(v)), r - below, eq
            else:
                v, skey, rr, size = None, (g, None), r - nn, n - nn
                pred = gpred(g) & F.col(key_col).isNull()
            if skey not in sub_index:
                sub_index[skey] = len(subs_b)
                stats_b[len(subs_b)] = (size, None, None)
                subs_b.append(pred)
                ranks_b.append([])
            ranks_b[sub_index[skey]].append(rr)
            plan[(g, r)] = (v, sub_index[skey], rr)
    found_b = _select_values(df, tie_col, subs_b, ranks_b, stats_b)
    out.update({k: (v, found_b[(sid, rr)][0]) for k, (v, sid, rr) in plan.items()})
    out.update(out_small)
    return out


def _direct_pick(df: DataFrame, gcol: Column, gpred, groups: list, ranks: dict,
                 key_col: str, tie_col: str) -> dict:
    """Rows at the wanted ranks of small groups (each at most FINAL_ROWS rows):
    a window per group ordered by (key nulls last, tie), then the picks only."""
    cond = reduce(lambda a, b: a | b, [gpred(g) for g in groups])
    w = Window.partitionBy(gcol).orderBy(F.col(key_col).asc_nulls_last(), F.col(tie_col))
    pos = df.where(cond).select(gcol.alias("_grp"), key_col, tie_col,
                                (F.row_number().over(w) - 1).alias("_pos"))
    wanted = reduce(lambda a, b: a | b, [
        (F.col("_grp").isNull() if g is None else F.col("_grp") == F.lit(g))
        & F.col("_pos").isin(*ranks[g]) for g in groups])
    return {(r["_grp"], r["_pos"]): (r[key_col], r[tie_col])
            for r in pos.where(wanted).collect()}


def before_cut(key_col: str, tie_col: str, cut) -> Column:
    """Predicate: row sorts before the cut tuple under (key nulls last, tie)."""
    if cut is None:
        return F.lit(True)
    v, t = cut
    k, tie = F.col(key_col), F.col(tie_col)
    if v is None:
        return k.isNotNull() | (k.isNull() & (tie < F.lit(t)))
    return k.isNotNull() & ((k < F.lit(v)) | ((k == F.lit(v)) & (tie < F.lit(t))))


BUCKET_ROWS = 500_000      # rows of a running-sum bucket, about


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str],
                descending: bool = True, n_buckets: int = 128) -> DataFrame:
    """Add ``cum_<v>`` running sums (inclusive) over ``order_col`` per group.

    ``df`` must be unique on ``group_cols + [order_col]`` (a grouped table).
    Bucket bounds are quantiles collected once as literals, so recomputation
    gives the same buckets; their number follows the rows of the largest group
    (at least ``n_buckets``, at most BUCKET_ROWS rows a bucket).
    """
    def quantiles(k: int) -> list:
        fr = [i / k for i in range(1, k)]
        return df.groupBy(*group_cols).agg(
            F.percentile_approx(order_col, fr, 10 * k).alias("_bounds"),
            F.count(F.lit(1)).alias("_rows")).collect()

    bounds_rows = quantiles(n_buckets)
    needed = -(-max((r["_rows"] for r in bounds_rows), default=0) // BUCKET_ROWS)
    if needed > n_buckets:
        n_buckets = needed
        bounds_rows = quantiles(n_buckets)
    x = F.col(order_col).cast("double")
    every, ends, size = (F.lit(None).cast(t) for t in ("array<double>", "array<double>", "int"))
    for r in bounds_rows:
        bs = sorted(set(float(b) for b in r["_bounds"] if b is not None))
        if not bs:
            continue
        cond = reduce(lambda a, b: a & b,
                      [F.col(c).eqNullSafe(F.lit(r[c])) for c in group_cols], F.lit(True))
        every = F.when(cond, F.lit(bs)).otherwise(every)
        ends = F.when(cond, F.lit(block_ends(bs))).otherwise(ends)
        size = F.when(cond, F.lit(block_size(bs))).otherwise(size)
    bucket = F.when(size.isNull(), F.lit(0)).otherwise(count_less_arrays(x, every, ends, size))
    n_groups = len(bounds_rows)
    with_b = df.withColumn("_bucket", bucket)
    totals = with_b.groupBy(*group_cols, "_bucket").agg(
        *[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # buckets run in the order of the running sum
    border = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    w_off = Window.partitionBy(*group_cols).orderBy(border).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_bucket", *[
        F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_in = Window.partitionBy(*group_cols, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = with_b.join(F.broadcast(offsets), on=[*group_cols, "_bucket"], how="left") \
        if n_groups * n_buckets <= 1_000_000 else with_b.join(offsets, [*group_cols, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(w_in) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in value_cols])


WINDOW_LIMIT = 1_000_000   # distinct values one task may rank with a plain window
SAMPLE_PER_BUCKET = 20


def ordinal_codes(distinct: DataFrame, part_cols: list[str], value_col: str,
                  limit: int | None = None, bucket_rows: int = 200_000,
                  max_part_size: int | None = None) -> DataFrame:
    """0-based position of each value in the sorted distinct values of its
    partition (``distinct`` must be unique on part_cols + value).

    Partitions up to ``limit`` values are ranked with one window each. Larger
    ones are cut into buckets at literal bounds taken from a sample (collected
    once, so recomputation gives the same buckets); each bucket is ranked on
    its own and shifted by the counts of the buckets before it.
    ``max_part_size`` (if the caller knows it) skips the size pass.
    """
    limit = WINDOW_LIMIT if limit is None else limit
    if max_part_size is not None and max_part_size <= limit:
        sizes = []    # the caller knows no part is large: no size pass
    else:
        sizes = distinct.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") > limit).collect()
    w_plain = Window.partitionBy(*part_cols).orderBy(value_col)
    if not sizes:
        return distinct.withColumn("code", (F.row_number().over(w_plain) - 1).cast("long"))
    cond_of = {}
    bucket = F.lit(0)
    for r in sizes:
        key = tuple(r[c] for c in part_cols)
        cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(part_cols, key)])
        n_buckets = max(2, -(-r["n"] // bucket_rows))
        frac = min(1.0, n_buckets * SAMPLE_PER_BUCKET / r["n"])
        sample = sorted(x[0] for x in distinct.where(cond).select(value_col)
                        .sample(fraction=frac, seed=17).collect())
        step = max(1, len(sample) // n_buckets)
        bounds = sorted(set(sample[step::step]))
        cond_of[key] = cond
        bucket = F.when(cond, count_less_array(F.col(value_col), bounds, closed=True)).otherwise(bucket)
    b = distinct.withColumn("_bucket", bucket)
    totals = b.groupBy(*part_cols, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    w_off = Window.partitionBy(*part_cols).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*part_cols, "_bucket",
                            F.coalesce(F.sum("_c").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*part_cols, "_bucket").orderBy(value_col)
    return (b.join(offsets, [*part_cols, "_bucket"])
            .withColumn("code", (F.row_number().over(w_in) - 1 + F.col("_off")).cast("long"))
            .drop("_bucket", "_off"))


def values_at_ranks(df: DataFrame, part_col: str, value_col: str, ranks: dict,
                    stats: dict | None = None) -> dict:
    """Exact order statistics of a numeric column per part: ``{(part, rank): value}``.

    Same narrowing as :func:`cut_tuples`; memory per task stays bounded no
    matter how many distinct values a part holds (unlike an exact percentile
    aggregate, which keeps every distinct value of a group in one buffer).
    Every pass reads ``df`` anew: nothing table-sized is kept.
    """
    parts = list(ranks)
    subsets = [F.col(part_col) == F.lit(p) for p in parts]
    st = None if stats is None else {i: stats[p] for i, p in enumerate(parts)}
    found = _select_values(df.select(part_col, value_col), value_col, subsets,
                           [ranks[p] for p in parts], st)
    return {(parts[sid], r): v[0] for (sid, r), v in found.items()}
