"""Global order without a single hot task.

A ``Window.orderBy`` without ``partitionBy`` sends every row to one task.  Everything that
needs a global order (AUC, average precision, KS, PR table, Spearman ranks, exact quantiles,
time splits, deciles) is built on two pieces instead:

1. a *distinct-value histogram*: ``groupBy(group, value)`` with counts (combined map-side, so a
   value shared by a third of all rows is one histogram row);
2. a *two-phase prefix sum* over that histogram: the values of each group are cut into
   ``buckets`` ranges at approximate quantiles, running sums are taken inside each
   (group, range) in parallel, and the totals of all lower ranges are added from a small
   (groups x buckets) table.

The bucket table has at most ``n_groups * buckets`` rows, where groups are features or other
schema-bounded keys, so broadcasting it is safe; its size is checked anyway.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

_G = "_grp"


def _default_buckets(df: DataFrame) -> int:
    try:
        return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001
        return 64


def _with_group(df: DataFrame, group_cols: list[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn(_G, F.lit(0)), [_G]


def _drop_group(df: DataFrame, group_cols: list[str]) -> DataFrame:
    return df if group_cols else df.drop(_G)


def small_broadcast(df: DataFrame, bound_rows: int, row_bytes: int = 256) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by construction (``bound_rows`` of
    about ``row_bytes``); above the byte limit the hint is dropped and the planner chooses."""
    return F.broadcast(df) if bound_rows * row_bytes <= config.BROADCAST_LIMIT_BYTES else df


def _two_levels(cuts: Column, width: int) -> Column:
    """Sorted cut points in groups of ``width``, with the last one of each group: finding a value's
    range reads about twice the square root of their number instead of all."""
    n = F.size(cuts)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(width))).otherwise(F.array().cast("array<int>"))
    groups = F.transform(starts, lambda s: F.slice(cuts, s, F.lit(width)))
    return F.struct(groups.alias("groups"), F.transform(groups, lambda g: F.element_at(g, -1)).alias("tops"))


def _range_of(levels: Column, key: Column, width: int) -> Column:
    """How many cut points lie below ``key`` (0 without cut points)."""
    group = F.size(F.filter(levels["tops"], lambda t: t < key))
    inside = F.get(levels["groups"], group)
    return F.coalesce(group * width + F.coalesce(F.size(F.filter(inside, lambda c: c < key)), F.lit(0)), F.lit(0))


def value_histogram(df: DataFrame, group_cols: list[str], value: str | Column,
                    sums: dict[str, Column] | None = None) -> DataFrame:
    """``groupBy(group, value)`` -> ``n`` (row count) and optional named sums."""
    vcol = F.col(value) if isinstance(value, str) else value
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    return df.groupBy(*group_cols, vcol.alias("value")).agg(*aggs)


def running_histogram(df: DataFrame, features: list[str], sums: dict[str, Column] | None = None,
                      types: dict[str, str] | None = None, stored: bool = False, range_values: int = 1 << 20) -> DataFrame:
    """(feature, value) -> ``n``, the named sums and the inclusive running sums ``cum_*`` of them all, for the non-null
    values of numeric columns; written once, as are the columns it reads, unless the caller says they are ``stored``.

    The rows are never unpivoted: a task sorts its part of each column, cuts it at bounds taken from a bounded sample
    (as Spark's range partitioner does) and sends arrays of values with their sums.  One shuffle brings a range of a
    feature together, which is merged and accumulated; ranges of about ``range_values`` rows bound a task's memory, and
    the totals of the lower ranges, a small table, shift the sums."""
    from ..session import materialize
    sums, types = dict(sums or {}), dict(types or {})
    names = ["n", *sums]
    kinds = ["long", *[types.get(c, "double") for c in sums]]
    arrow = {"long": pa.int64(), "double": pa.float64()}
    k, n_sums = len(features), len(sums)
    wide = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                     *[c.cast(t).alias(f"s{j}") for j, (c, t) in enumerate(zip(sums.values(), kinds[1:], strict=True))])
    wide = wide if stored else materialize(wide)
    rows = wide.count()
    ranges = max(1, -(-rows // range_values))
    sample = wide.select(*[f"x{i}" for i in range(k)]).sample(False, min(1.0, 64.0 * ranges / max(rows, 1)), 42) if ranges > 1 else None
    shares = [r / ranges for r in range(1, ranges)]
    found = sample.agg(*[F.percentile_approx(f"x{i}", shares, max(1000, 4 * ranges)).alias(f"x{i}") for i in range(k)]).first() if ranges > 1 else [None] * k
    cuts = [np.unique(np.array([c for c in found[i] or [] if c == c], float)) for i in range(k)]

    def merged(x, parts):
        """Distinct values in order, with their sums."""
        order = np.argsort(x, kind="stable")
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
        starts = np.flatnonzero(new)
        return x[starts], [np.add.reduceat(p[order], starts) for p in parts]

    lists = ["value", *names]
    list_types = [pa.float64(), *[arrow[t] for t in kinds]]

    def spread(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 18:
                yield from cut(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from cut(pa.Table.from_batches(held))

    def cut(table):
        weights = [np.ones(table.num_rows, np.int64)]
        weights += [pc.fill_null(table.column(k + j), 0).to_numpy() for j in range(n_sums)]
        for i in range(k):
            known = table.column(i).is_valid().to_numpy()
            if not known.any():
                continue
            x = table.column(i).drop_null().to_numpy() + 0.0      # one zero
            x, parts = merged(x, [w[known] for w in weights])
            at = np.searchsorted(cuts[i], x, "left")
            ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(x))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            ranges_of = at[ends - 1].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), i, np.int32)), pa.array(ranges_of),
                 *[pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in zip([x, *parts], list_types, strict=True)]],
                ["i", "r", *lists])

    def merge(table):
        x, parts = merged(*(lambda a: (a[0], a[1:]))([pc.list_flatten(table.column(c)).to_numpy() for c in lists]))
        out = [pa.array(np.full(len(x), table.column(c)[0].as_py(), np.int32)) for c in ("i", "r")]
        out += [pa.array(x)] + [pa.array(p, arrow[t]) for p, t in zip(parts, kinds, strict=True)]
        out += [pa.array(np.cumsum(p), arrow[t]) for p, t in zip(parts, kinds, strict=True)]
        return pa.table(out, [*("i", "r"), *lists, *[f"_in_{c}" for c in names]])

    typed = ", ".join(f"{c} {t}" for c, t in zip(names, kinds, strict=True))
    sent = wide.mapInArrow(spread, "i int, r int, " + ", ".join(f"{c} array<{t}>" for c, t in zip(lists, ["double", *kinds], strict=True)))
    cells = materialize(sent.groupBy("i", "r").applyInArrow(
        merge, f"i int, r int, value double, {typed}, " + ", ".join(f"_in_{c} {t}" for c, t in zip(names, kinds, strict=True))))
    below = Window.partitionBy("i").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("i", "r").agg(*[F.sum(c).alias(c) for c in names])
    offsets = totals.select("i", "r", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_off_{c}") for c in names])
    out = cells.join(small_broadcast(offsets, k * ranges), ["i", "r"])
    return out.select(F.array(*map(F.lit, features))[F.col("i")].alias("feature"), "value", *names,
                      *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in names])


def prefix_sums(hist: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                descending: bool = False, buckets: int | None = None, n_groups_bound: int = 10_000) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``sum_cols`` over ``order_col`` within each group.

    ``order_col`` must be unique within a group (it is the value of a histogram).  A histogram that
    has them already (``running_histogram``) is returned as it is."""
    if not descending and all(f"cum_{c}" in hist.columns for c in sum_cols):
        return hist
    buckets = buckets or _default_buckets(hist)
    hist, gcols = _with_group(hist, group_cols)
    key = F.col(order_col)
    okey = -key if descending else key
    hist = hist.withColumn("_okey", okey.cast("double"))

    probs = [i / buckets for i in range(1, buckets)]
    cuts = hist.groupBy(*gcols).agg(F.percentile_approx("_okey", probs, max(1000, 4 * buckets)).alias("_cuts"))
    width = max(1, math.isqrt(buckets))
    cuts = cuts.withColumn("_cuts", _two_levels(F.array_distinct("_cuts"), width))
    cuts = small_broadcast(cuts, n_groups_bound, 64 + 9 * buckets)
    binned = (hist.join(cuts, gcols, "left")
              .withColumn("_bucket", _range_of(F.col("_cuts"), F.col("_okey"), width))
              .drop("_cuts"))

    totals = binned.groupBy(*gcols, "_bucket").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    wb = Window.partitionBy(*gcols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*gcols, "_bucket",
                            *[F.coalesce(F.sum(f"_tot_{c}").over(wb), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    offsets = small_broadcast(offsets, n_groups_bound * buckets)

    wr = (Window.partitionBy(*gcols, "_bucket").orderBy("_okey")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (binned.join(offsets, gcols + ["_bucket"], "left")
           .withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(wr) for c in sum_cols})
           .drop("_okey", "_bucket", *[f"_off_{c}" for c in sum_cols]))
    return _drop_group(out, group_cols)


def numpy_linspace(n_bins: int) -> list[float]:
    """Probabilities 0, 1/n, ..., 1 computed like ``numpy.linspace(0, 1, n + 1)``."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def lerp(a, b, t):
    """numpy's linear interpolation: a + (b - a) t, or b - (b - a)(1 - t) when t >= 0.5."""
    d = b - a
    return F.when(t >= 0.5, b - d * (1 - t)).otherwise(a + d * t)


def exact_quantiles(df: DataFrame, group_cols: list[str], value: str | Column, probs: list[float],
                    buckets: int | None = None, n_groups_bound: int = 10_000) -> DataFrame:
    """Exact quantiles with linear interpolation (the numpy / pandas default): position (n-1)p
    between order statistics lo and hi, value ``lerp(lo, hi, frac)``.

    Returns one row per group with ``quantiles`` = array in ``probs`` order (NULL values are
    ignored; a group without values has no row)."""
    from ..session import materialize
    vcol = F.col(value) if isinstance(value, str) else value
    base, gcols = _with_group(df.select(*group_cols, vcol.cast("double").alias("_v")), group_cols)
    hist = materialize(value_histogram(base.filter(F.col("_v").isNotNull()), gcols, "_v"))
    return _drop_group(quantiles_from_histogram(hist, gcols, probs, buckets, n_groups_bound), group_cols)


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each numeric column, nulls and NaN left out; a column without values has none."""
    if not columns:
        return {}
    hist = running_histogram(df.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]), columns)
    found = quantiles_from_histogram(hist, ["feature"], [0.5], n_groups_bound=len(columns)).collect()
    return {r["feature"]: float(r["quantiles"][0]) for r in found}


def fill_medians(df: DataFrame, medians: dict[str, float], suffix: str) -> DataFrame:
    """A column ``<name><suffix>`` for each median, missing values replaced by it."""
    filled = {f"{c}{suffix}": F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(m)) for c, m in medians.items()}
    return df.withColumns(filled) if filled else df


def quantiles_from_histogram(hist: DataFrame, group_cols: list[str], probs: list[float], buckets: int | None = None,
                             n_groups_bound: int = 10_000, count_col: str = "n") -> DataFrame:
    """Exact quantiles from a (group, value, count) histogram of non-missing values."""
    gcols = list(group_cols)
    running = [F.col(f"cum_{count_col}").alias("cum_n")] if f"cum_{count_col}" in hist.columns else []
    hist = hist.select(*gcols, "value", F.col(count_col).alias("n"), *running).filter(F.col("n") > 0)
    cum = prefix_sums(hist, gcols, "value", ["n"], buckets=buckets, n_groups_bound=n_groups_bound)
    cum = cum.withColumn("_before", F.col("cum_n") - F.col("n"))

    totals = hist.groupBy(*gcols).agg(F.sum("n").alias("_N"))
    targets = totals.withColumn("_t", F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                 F.floor((F.col("_N") - 1) * F.lit(float(p))).alias("lo"),
                 F.ceil((F.col("_N") - 1) * F.lit(float(p))).alias("hi"),
                 ((F.col("_N") - 1) * F.lit(float(p))).alias("pos"))
        for i, p in enumerate(probs)]))
    targets = small_broadcast(targets.select(*gcols, "_t"), n_groups_bound)

    hits = (cum.join(targets, gcols)
            .select(*gcols, "value", F.explode(F.filter(
                "_t", lambda t: ((t["lo"] >= F.col("_before")) & (t["lo"] < F.col("cum_n")))
                | ((t["hi"] >= F.col("_before")) & (t["hi"] < F.col("cum_n"))))).alias("_tg"),
                "_before", "cum_n"))
    per_prob = hits.groupBy(*gcols, F.col("_tg.i").alias("_i"), F.col("_tg.pos").alias("_pos"),
                            F.col("_tg.lo").alias("_lo")).agg(
        F.max(F.when((F.col("_tg.lo") >= F.col("_before")) & (F.col("_tg.lo") < F.col("cum_n")),
                     F.col("value"))).alias("_v_lo"),
        F.max(F.when((F.col("_tg.hi") >= F.col("_before")) & (F.col("_tg.hi") < F.col("cum_n")),
                     F.col("value"))).alias("_v_hi"),
    )
    q = lerp(F.col("_v_lo"), F.col("_v_hi"), F.col("_pos") - F.col("_lo"))
    return (per_prob.groupBy(*gcols)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_i"), q.alias("q")))).alias("_qs"))
            .withColumn("quantiles", F.transform("_qs", lambda s: s["q"]))
            .drop("_qs"))


def average_ranks(hist: DataFrame, group_cols: list[str], buckets: int | None = None) -> DataFrame:
    """Average (tie-sharing) ranks of a histogram: rank of value v = rows before v + (n + 1) / 2."""
    cum = prefix_sums(hist, group_cols, "value", ["n"], buckets=buckets)
    return cum.withColumn("avg_rank", (F.col("cum_n") - F.col("n")) + (F.col("n") + 1) / 2.0)



def _sample_cuts(keys: DataFrame, buckets: int, seed: int = 42) -> list:
    """Range cut points over a (possibly composite) sort key, from a bounded sample pulled to the
    driver - the same approach as Spark's range partitioner.  At most ~64 sampled keys per bucket
    reach the driver whatever the data size."""
    n = keys.count()
    if n == 0 or buckets <= 1:
        return []
    frac = min(1.0, 64.0 * buckets / n)
    sample = sorted((tuple(r) for r in keys.sample(False, frac, seed).collect()),
                    key=lambda t: tuple((x is None, x) for x in t))
    if not sample:
        return []
    step = len(sample) / buckets
    cuts = [sample[int(i * step)] for i in range(1, buckets)]
    return sorted(set(cuts), key=lambda t: tuple((x is None, x) for x in t))


def row_positions(df: DataFrame, order: list[tuple[str, bool]], buckets: int | None = None,
                  pos_col: str = "_pos", keep_bucket: bool = False) -> DataFrame:
    """0-based global row position under ``order`` = [(column, descending), ...] (the last
    columns should make the order unique).  Rows are cut into ranges at sampled key tuples,
    numbered inside each range in parallel, and shifted by the sizes of all lower ranges."""
    buckets = buckets or _default_buckets(df)
    names = [c for c, _ in order]
    key_fields = [(-F.col(c) if desc else F.col(c)).alias(f"_k{i}") for i, (c, desc) in enumerate(order)]
    keyed = df.withColumn("_key", F.struct(*key_fields))
    cuts = _sample_cuts(keyed.select(*[F.col("_key")[f"_k{i}"] for i in range(len(names))]), buckets)
    if cuts:
        cut_arr = F.array(*[F.struct(*[F.lit(v).cast(keyed.schema["_key"].dataType[f"_k{i}"].dataType).alias(f"_k{i}")
                                       for i, v in enumerate(t)]) for t in cuts])
        width = max(1, math.isqrt(len(cuts)))
        # a literal, folded once: the ranges' bounds are part of the plan
        keyed = keyed.withColumn("_bucket", _range_of(_two_levels(cut_arr, width), F.col("_key"), width))
    else:
        keyed = keyed.withColumn("_bucket", F.lit(0))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_sz"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_sz").over(
        Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy("_bucket").orderBy("_key")
    out = (keyed.join(small_broadcast(offsets, buckets), "_bucket")
           .withColumn(pos_col, F.col("_off") + F.row_number().over(w) - 1)
           .drop("_key", "_off"))
    return out if keep_bucket else out.drop("_bucket")


def cut_at(df: DataFrame, order: list[Column], share_after: float, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first rows of ``df`` in ascending ``order`` (nulls first) and the last ones, which are ``share_after`` of them.

    Sampled bounds cut the keys into ranges; their row counts name the range of the row at the cut, and that range
    alone is sorted.  Both parts are filters of ``df``: it is read several times and should be stored.  Of rows with
    equal keys any may come first."""
    buckets = buckets or _default_buckets(df)
    n = df.count()
    cut = int(n * (1 - share_after))
    if cut >= n:
        return df, df.where(F.lit(False))
    columns = df.columns
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)]))
    kinds = keyed.schema["_key"].dataType
    literal = lambda t: F.struct(*[F.lit(v).cast(kinds[f"_k{i}"].dataType).alias(f"_k{i}") for i, v in enumerate(t)])
    keys = keyed.select("_key")
    cuts = _sample_cuts(keys.select("_key.*"), buckets)
    if cuts:
        width = max(1, math.isqrt(len(cuts)))
        ranged = keys.withColumn("_bucket", _range_of(_two_levels(F.array(*map(literal, cuts)), width), F.col("_key"), width))
    else:
        ranged = keys.withColumn("_bucket", F.lit(0))
    below, at = 0, 0
    for at, size in sorted(tuple(r) for r in ranged.groupBy("_bucket").count().collect()):
        if below + size > cut:
            break
        below += size
    inside = ranged.where(F.col("_bucket") == at).select("_key")
    first = literal(tuple(inside.orderBy("_key").offset(cut - below).limit(1).first()[0]))
    lower = inside.where(F.col("_key") < first).count()
    early = cut - below - lower                                   # of the rows with the key of the cut, those before it
    before, after = keyed.where(F.col("_key") < first), keyed.where(F.col("_key") >= first)
    if early:
        # ties go by position among themselves alone
        tied = keyed.where(F.col("_key") == first).withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(F.hash(*columns))))
        before = before.unionByName(tied.where(F.col("_place") <= early).drop("_place"))
        after = keyed.where(F.col("_key") > first).unionByName(tied.where(F.col("_place") > early).drop("_place"))
    return before.select(*columns), after.select(*columns)
