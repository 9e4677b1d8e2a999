"""Drift monitoring: PSI, two-sample KS, chi-square, per-feature drift table, score drift and
the retrain verdict (X1-X6).

Both sides are stacked with a side flag (``unionByName``) and unpivoted once to
(feature, side, value); every statistic is then a grouped aggregate per feature.  Reference
deciles come from the distributed exact-quantile helper, cumulative distributions from the
two-phase prefix sum over the (feature, value) histogram.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import chi2_sf, ks_exact, ks_pvalue
from ..functions.columns import truth
from . import ranks

REF, CUR = 0, 1


def side_histogram(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) -> reference and current counts with running counts, written once to the checkpoint folder."""
    def side(df, flag):
        return df.select(*[F.col(c).cast("double").alias(c) for c in features], F.lit(flag).alias("_side"))
    both = side(reference, REF).unionByName(side(current, CUR))
    counts = {"nr": (F.col("_side") == REF).cast("long"), "nc": (F.col("_side") == CUR).cast("long")}
    return ranks.running_histogram(both, features, counts, {"nr": "long", "nc": "long"})


def value_counts(df: DataFrame, num_features: list[str], cat_features: list[str], label: str | None = None,
                 score: str | None = None, by: list[str] | None = None) -> DataFrame:
    """What the drift statistics need of one side, as a table that adds up: (by, kind, feature, value, level, n, pos).
    ``num`` rows count the values of a numeric feature (missing ones left out), ``cat`` rows the levels of a
    categorical one (a missing value is its own level), ``score`` rows the scores with their positive labels (rows with
    both).  One pass and one shuffle for all features; counts of disjoint parts of a side sum to those of the side."""
    none = F.lit(None)
    def entry(kind, c, value=none, level=none, pos=none):
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("feature"), value.cast("double").alias("value"),
                        level.cast("string").alias("level"), pos.cast("long").alias("pos"))
    every = [entry("num", c, F.col(c)) for c in num_features] + [entry("cat", c, level=F.col(c)) for c in cat_features]
    if score is not None:
        every.append(entry("score", score, F.col(score), pos=F.col(label)))
    if not every:
        raise ValueError("no feature to count")
    by = list(by or [])
    known = (F.col("e.kind") == "cat") | (F.col("e.value").isNotNull() & ((F.col("e.kind") == "num") | F.col("e.pos").isNotNull()))
    return (df.select(*by, F.explode(F.array(*every)).alias("e")).filter(known)
            .groupBy(*by, "e.kind", "e.feature", "e.value", "e.level")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("e.pos").alias("pos")))


def side_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``value_counts`` of two sides next to each other: (kind, feature, value, level, nr, nc), written once."""
    from ..session import materialize
    zero = F.lit(0).cast("long")
    keys = ["kind", "feature", "value", "level"]
    both = reference.select(*keys, F.col("n").alias("nr"), zero.alias("nc")).unionByName(
        current.select(*keys, zero.alias("nr"), F.col("n").alias("nc")))
    return materialize(both.groupBy(*keys).agg(F.sum("nr").alias("nr"), F.sum("nc").alias("nc")))


def numeric_sides(counts: DataFrame, kind: str = "num") -> DataFrame:
    """The histogram (feature, value, nr, nc) that PSI and KS read, out of ``side_counts``."""
    return counts.filter(F.col("kind") == kind).select("feature", "value", "nr", "nc")


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10,
        hist: DataFrame | None = None) -> DataFrame:
    """PSI per feature.  Edges are the distinct exact deciles of the reference; fewer than
    three edges gives 0; counts use [a, b) bins with the last one closed and drop values outside
    the reference range; shares get +1e-6; sum((c - r) ln(c / r)).  A side without values gives
    NULL."""
    hist = hist if hist is not None else side_histogram(reference, current, features)
    q = ranks.quantiles_from_histogram(hist, ["feature"], ranks.numpy_linspace(bins), n_groups_bound=len(features),
                                       count_col="nr")
    edges = q.select("feature", F.array_distinct("quantiles").alias("edges"))
    nb = F.size("edges") - 1
    binned = (hist.join(ranks.small_broadcast(edges, len(features)), "feature")
              .filter((F.size("edges") >= 3) & (F.col("value") >= F.col("edges")[0])
                      & (F.col("value") <= F.element_at("edges", -1)))
              .withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, nb - 1)))
    counts = binned.groupBy("feature", "bin").agg(F.sum("nr").alias("r"), F.sum("nc").alias("c"))
    all_bins = (edges.filter(F.size("edges") >= 3)
                .select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")))
    full = all_bins.join(counts, ["feature", "bin"], "left").fillna(0, ["r", "c"])
    w = Window.partitionBy("feature")
    shares = full.select(
        "feature",
        (F.col("r") / F.greatest(F.sum("r").over(w), F.lit(1)) + 1e-6).alias("rp"),
        (F.col("c") / F.greatest(F.sum("c").over(w), F.lit(1)) + 1e-6).alias("cp"))
    value = shares.groupBy("feature").agg(F.sum((F.col("cp") - F.col("rp")) * F.ln(F.col("cp") / F.col("rp"))).alias("psi"))
    sides = hist.groupBy("feature").agg(F.sum("nr").alias("n_ref"), F.sum("nc").alias("n_cur"))
    feats = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return (feats.join(sides, "feature", "left").join(edges, "feature", "left").join(value, "feature", "left")
            .select("feature",
                    F.when((F.coalesce("n_ref", F.lit(0)) == 0) | (F.coalesce("n_cur", F.lit(0)) == 0), F.lit(None))
                    .when(F.size("edges") < 3, F.lit(0.0))
                    .otherwise(F.col("psi")).cast("double").alias("psi")))


def ks_two_sample(reference: DataFrame, current: DataFrame, features: list[str],
                  hist: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Two-sample KS statistic D (largest gap of the two empirical CDFs, evaluated at every
    distinct value) and its p-value; fewer than two values on a side gives NULL.  The p-value is exact
    (lattice paths) where both sides have at most ``stats.EXACT_ROWS`` values, else, or without
    ``exact``, Kolmogorov's series."""
    hist = hist if hist is not None else side_histogram(reference, current, features)
    cum = ranks.prefix_sums(hist, ["feature"], "value", ["nr", "nc"], n_groups_bound=len(features))
    tot = hist.groupBy("feature").agg(F.sum("nr").alias("_n1"), F.sum("nc").alias("_n2"))
    d = (cum.join(ranks.small_broadcast(tot, len(features)), "feature")
         .groupBy("feature", "_n1", "_n2")
         .agg(F.max(F.abs(F.try_divide(F.col("cum_nr"), F.col("_n1")) - F.try_divide(F.col("cum_nc"), F.col("_n2")))).alias("d")))
    ok = (F.col("_n1") >= 2) & (F.col("_n2") >= 2)
    p = ks_pvalue(F.col("d"), F.col("_n1").cast("double"), F.col("_n2").cast("double"))
    if exact:
        p = F.coalesce(F.nullif(ks_exact("d", "_n1", "_n2"), F.lit(float("nan"))), p)
    return d.select("feature", F.when(ok, F.col("d")).alias("ks_stat"), F.when(ok, p).alias("p_value"))


def chi_square(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Chi-square of the 2 x k table of value counts over the union of values (a missing
    value is its own category), with 1 added to every cell and Yates' correction when k = 2."""
    def side(df, flag):
        return df.select(F.lit(flag).alias("side"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in features])).alias("kv"))
    long = side(reference, REF).unionByName(side(current, CUR)).select("side", "kv.feature", "kv.v")
    from ..session import materialize
    return chi_square_of_cells(materialize(long.groupBy("feature", "v").agg(
        (F.sum((F.col("side") == REF).cast("long")) + 1).alias("o_r"),
        (F.sum((F.col("side") == CUR).cast("long")) + 1).alias("o_c"))), features)


def chi_square_of_cells(cells: DataFrame, features: list[str]) -> DataFrame:
    """X3 from the cells (feature, v, o_r, o_c), to which 1 was added."""
    # per-feature margins from a grouped total (one row per feature), not a window over values
    margins = cells.groupBy("feature").agg(F.sum("o_r").alias("R"), F.sum("o_c").alias("C"),
                                           F.count(F.lit(1)).alias("k"))
    t = cells.join(ranks.small_broadcast(margins, len(features)), "feature")
    tot = F.col("R") + F.col("C")
    e_r, e_c = (F.col("o_r") + F.col("o_c")) * F.col("R") / tot, (F.col("o_r") + F.col("o_c")) * F.col("C") / tot

    def term(o, e):
        adj = F.when(F.col("k") == 2, F.signum(e - o) * F.least(F.lit(0.5), F.abs(e - o))).otherwise(F.lit(0.0))
        oo = o + adj
        return (oo - e) * (oo - e) / e

    stat = t.groupBy("feature", "k").agg(F.sum(term(F.col("o_r"), e_r) + term(F.col("o_c"), e_c)).alias("chi2"))
    return stat.select("feature", "chi2", chi2_sf(F.col("chi2"), (F.col("k") - 1).cast("double")).alias("p_value"))


def data_drift(reference: DataFrame, current: DataFrame, num_features: list[str], cat_features: list[str]) -> DataFrame:
    """Per feature kind, psi, ks_stat (chi-square for categorical), p_value and the drift flag
    (numeric: PSI > 0.25 or p < 0.01; categorical: p < 0.01); drifted first, then by PSI."""
    num = [f for f in num_features if f in reference.columns and f in current.columns]
    cat = [f for f in cat_features if f in reference.columns and f in current.columns]
    return _drift_table(side_histogram(reference, current, num) if num else None, num,  # shared by PSI and KS
                        chi_square(reference, current, cat) if cat else None)


def data_drift_of_counts(counts: DataFrame, num_features: list[str], cat_features: list[str]) -> DataFrame:
    """X4 from ``side_counts``: the same rows as ``data_drift`` of the two sides."""
    cells = counts.filter(F.col("kind") == "cat").select("feature", F.col("level").alias("v"), (F.col("nr") + 1).alias("o_r"),
                                                         (F.col("nc") + 1).alias("o_c"))
    return _drift_table(numeric_sides(counts) if num_features else None, num_features,
                        chi_square_of_cells(cells, cat_features) if cat_features else None)


def _drift_table(hist: DataFrame | None, num: list[str], chi: DataFrame | None) -> DataFrame:
    parts = []
    if hist is not None:
        n = psi(hist, hist, num, hist=hist).join(ks_two_sample(hist, hist, num, hist=hist), "feature", "left")
        parts.append(n.select(
            "feature", F.lit("num").alias("kind"), "psi", "ks_stat", "p_value",
            (truth(F.col("psi") > config.DRIFT_PSI_THRESHOLD)
             | (F.col("p_value").isNotNull() & ~F.isnan("p_value") & truth(F.col("p_value") < config.DRIFT_KS_PVALUE)))
            .alias("drift")))
    if chi is not None:
        parts.append(chi.select(
            "feature", F.lit("cat").alias("kind"), F.lit(None).cast("double").alias("psi"),
            F.col("chi2").alias("ks_stat"), "p_value",
            (F.col("p_value").isNotNull() & ~F.isnan("p_value") & truth(F.col("p_value") < config.DRIFT_KS_PVALUE))
            .alias("drift")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("drift"), F.desc_nulls_last("psi"), "feature")


def score_drift(reference: DataFrame, current: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """PSI of the model scores of the two sides."""
    return psi(reference.select(score_col), current.select(score_col), [score_col]).select(
        F.col("psi").alias("score_psi"))


def drift_verdict(features_drift: DataFrame, score_psi: float | None, auc_reference: float | None,
                  auc_current: float | None) -> dict:
    """Retrain if the relative AUC drop exceeds 10 %, the score PSI exceeds 0.25 or more than
    30 % of the features drifted; with summary counts.  Inputs are per-feature rows and scalars."""
    rows = features_drift.select("drift").groupBy().agg(
        F.sum(F.col("drift").cast("int")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    drifted, total = int(rows["d"] or 0), int(rows["n"] or 0)
    share = drifted / total if total else float("nan")
    needs = False
    if auc_reference is not None and auc_current is not None:
        drop = (auc_reference - auc_current) / max(auc_reference, 1e-6)
        needs = drop > config.MODEL_METRIC_DROP_PCT
    needs = needs or (score_psi is not None and score_psi > config.DRIFT_PSI_THRESHOLD) or (
        total > 0 and share > config.DRIFTED_SHARE_RETRAIN)
    return {"needs_retrain": bool(needs), "score_psi": score_psi,
            "summary": {"features_drifted": drifted, "features_total": total, "pct_drifted": share}}
