"""Segmentation: rule segments, segment profile and share, segment policy, k-means
(G1-G4, A4, A5, R3)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import truth
from . import cleaning, ranks
from .cleaning import last_slice


def rule_segment(df: DataFrame, out_col: str = "segment") -> DataFrame:
    """G1: later rule wins - delinquent (dpd > 30 or bankrupt) over stress (mom ratio < 0.5 or
    > 45 days without payment) over growing (utilisation > 0.6 and dpd <= 5) over stable.
    Absent columns default to util 0, dpd 0, mom 1, days 0, bankrupt 0; missing values never fire."""
    present = set(df.columns)

    def c(name, default):
        return F.col(name) if name in present else F.lit(default)

    util, dpd = c("utilization", 0.0), c("dpd", 0.0)
    mom, dslp, bankrupt = c("payment_ratio_mom", 1.0), c("days_since_last_payment", 0.0), c("is_bankrupt", 0)
    seg = (F.when(truth(dpd > 30) | truth(bankrupt == 1), F.lit("delinquent"))
           .when(truth(mom < 0.5) | truth(dslp > 45), F.lit("stress"))
           .when(truth(util > 0.6) & truth(dpd <= 5), F.lit("growing"))
           .otherwise(F.lit("stable")))
    return df.withColumn(out_col, seg)


def segment_profile(df: DataFrame, seg_col: str = "segment", target_col: str = config.TARGET_COL,
                    dedupe_last_obs: bool = True) -> DataFrame:
    """A4: per segment (NULL kept) distinct contracts, sums of debt / limit / payments, means of
    PDN, DPD, utilisation and the default rate; by default each contract counts once, with its
    latest row.  Most contracts first."""
    if seg_col not in df.columns:
        raise KeyError(seg_col)
    work = last_slice(df) if dedupe_last_obs and "report_date_as_of" in df.columns else df
    present = set(df.columns)
    aggs = [F.count_distinct("credit_id").alias("n_contracts")]
    aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ["total_debt", "available_limit", "payment_sum_1m"]
             if c in present]
    aggs += [F.avg(c).alias(c) for c in ["pdn_current", "dpd", "utilization"] if c in present]
    if target_col in present:
        aggs.append(F.avg(target_col).alias("default_rate"))
    return work.groupBy(seg_col).agg(*aggs).orderBy(F.desc("n_contracts"), seg_col)


def segment_share(profile: DataFrame, seg_col: str = "segment") -> DataFrame:
    """A5: share %, debt in billions, utilisation % and default % of a segment profile in the
    fixed order stable / growing / stress / delinquent.  The profile has one row per segment, so
    the total is a window over a handful of rows."""
    order = F.create_map(*[x for i, s in enumerate(config.SEGMENT_ORDER) for x in (F.lit(s), F.lit(i))])
    known = profile.filter(F.col(seg_col).isin(*config.SEGMENT_ORDER))
    total = F.sum("n_contracts").over(Window.partitionBy(F.lit(0)))
    return (known.select(
        F.col(seg_col).alias("segment"),
        F.bround(F.col("n_contracts") / total * 100, 1).alias("share_pct"),
        F.col("n_contracts"),
        F.bround(F.col("total_debt") / 1e9, 3).alias("debt_bn"),
        F.bround(F.col("utilization") * 100, 0).alias("util_pct"),
        F.bround(F.col("default_rate") * 100, 2).alias("default_pct"),
        order[F.col(seg_col)].alias("segment_order"),
    ).orderBy("segment_order").drop("segment_order"))


def segment_policy(summary: DataFrame, rate_col: str = "default_rate", high: float = config.POLICY_HIGH,
                   low: float = config.POLICY_LOW) -> DataFrame:
    """Tighten above ``high``, loosen below ``low``, else monitor."""
    r = F.col(rate_col)
    return summary.withColumn(
        "policy_recommendation",
        F.when(truth(r > high), F.lit(config.POLICY_TIGHTEN))
        .when(truth(r < low), F.lit(config.POLICY_LOOSEN))
        .otherwise(F.lit(config.POLICY_MONITOR)))


def kmeans_matrix(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Adds ``_km_x``, the behaviour features with missing values replaced by the column's exact
    median (a column without values counts as 0), z-scored.  The rows are written once: medians, moments, the passes of
    a clustering and what follows read them there."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from ..session import materialize
    df = materialize(df)
    feats = [c for c in (features or config.BEHAVIOR_FEATURES) if c in df.columns]
    imp = [f"{c}__km" for c in feats]
    filled = ranks.fill_medians(df, dict.fromkeys(feats, 0.0) | ranks.column_medians(df, feats), "__km")
    stages = [VectorAssembler(inputCols=imp, outputCol="_km_raw"),
              StandardScaler(inputCol="_km_raw", outputCol="_km_x", withMean=True, withStd=True)]
    return Pipeline(stages=stages).fit(filled).transform(filled).drop(*imp, "_km_raw")


def kmeans_segment(df: DataFrame, k: int = 4, features: list[str] | None = None, seed: int = config.RANDOM_STATE,
                   out_col: str = "cluster") -> DataFrame:
    """K-means cluster label per row (k-means|| initialisation, fixed seed)."""
    from pyspark.ml.clustering import KMeans
    x = kmeans_matrix(df, features)
    return KMeans(k=k, seed=seed, featuresCol="_km_x", predictionCol=out_col).fit(x).transform(x).drop("_km_x")


def silhouette(df: DataFrame, vector: str, cluster: str, sample: int = config.SILHOUETTE_SAMPLE, key_cols: list[str] | None = None,
               seed: int = config.RANDOM_STATE) -> float | None:
    """Mean Euclidean silhouette, exact over a sample of at most ``sample`` rows (all, if there are no
    more).  The sample, of bounded size, goes to every task; a task sums the distances of its rows to
    each cluster.  A row alone in its cluster scores 0; fewer than two clusters give None."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import vector_to_array

    from ..session import materialize
    rows = df.select(vector_to_array(vector).alias("x"), F.col(cluster).cast("int").alias("c"), *(key_cols or []))
    rows = materialize(cleaning.sample_rows(rows, sample, key_cols, seed).select("x", "c"))
    found = rows.collect()
    x, c = np.array([r["x"] for r in found], np.float64), np.array([r["c"] for r in found])
    labels, c = np.unique(c, return_inverse=True)
    if len(labels) < 2:
        return None
    sizes = np.bincount(c)
    shared = df.sparkSession.sparkContext.broadcast((x, c, labels, sizes))

    def score(batches):
        x, c, labels, sizes = shared.value
        member = np.eye(len(labels))[c]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                mine = np.array(part.column("x").to_pylist(), np.float64)
                own = np.searchsorted(labels, part.column("c").to_numpy())
                far = np.sqrt(np.square(mine[:, None, :] - x[None, :, :]).sum(axis=2)) @ member     # row, cluster
                at = np.arange(len(own))
                inner = far[at, own] / np.maximum(sizes[own] - 1, 1)
                outer = far / sizes
                outer[at, own] = np.inf
                outer = outer.min(axis=1)
                s = np.divide(outer - inner, np.maximum(inner, outer), out=np.zeros(len(own)), where=np.maximum(inner, outer) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(sizes[own] > 1, s, 0.0))], ["s"])

    return rows.mapInArrow(score, "s double").agg(F.avg("s")).first()[0]


def kmeans_k_search(df: DataFrame, k_values=(2, 3, 4, 5, 6, 7), features: list[str] | None = None,
                    seed: int = config.RANDOM_STATE) -> DataFrame:
    """Inertia (training cost) and Euclidean silhouette (over a sample of at most
    ``config.SILHOUETTE_SAMPLE`` rows) for each k.  The scaled matrix is built once and persisted."""
    from pyspark.ml.clustering import KMeans
    from ..session import keep
    x = keep(kmeans_matrix(df, features).select("_km_x"))
    rows = []
    for k in k_values:
        m = KMeans(k=k, seed=seed, featuresCol="_km_x", predictionCol="_c").fit(x)
        rows.append((int(k), float(m.summary.trainingCost), silhouette(m.transform(x), "_km_x", "_c", seed=seed)))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
