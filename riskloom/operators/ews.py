"""Early-warning system: rules, zones, priority, summary, recommendations, top lists
(E1-E7, R1-R2, L1-L2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import clip
from ..functions.rules import rule_column


def formula_score(df: DataFrame, out_col: str = "risk_score") -> DataFrame:
    """Deterministic stand-in for a model score, used wherever an exact SQL oracle is wanted:
    round(least(1, coalesce(dpd, 0)/300 + (credit_id % 100)/250), 4)."""
    dpd = F.coalesce(F.col("dpd").cast("double"), F.lit(0.0))
    raw = F.least(F.lit(1.0), dpd / 300.0 + (F.col("credit_id") % 100).cast("double") / 250.0)
    return df.withColumn(out_col, F.round(raw, 4))


def apply_rules(df: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """``rule_<name>`` 0/1 per rule, ``rules_weight_sum`` and ``rules_triggered`` (names in
    rule order).  An empty rule list means the default rules."""
    rules = rules or config.EWS_RULES
    hits = [(r["name"], rule_column(df, r["expr"]), float(r.get("weight", 1) if r.get("weight") is not None else 1))
            for r in rules]
    cols = {f"rule_{name}": hit.cast("int") for name, hit, _ in hits}
    weight = F.lit(0.0)
    for _, hit, w in hits:
        weight = weight + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
    cols["rules_weight_sum"] = weight
    cols["rules_triggered"] = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit, _ in hits]))
    return df.withColumns(cols)


def score_zone(score: Column, zones: dict | None = None) -> Column:
    """Green below the first threshold, yellow below the second, else red (missing -> red)."""
    z = zones or config.EWS_ZONES
    return (F.when(score < z["green"]["score_max"], F.lit("green"))
            .when(score < z["yellow"]["score_max"], F.lit("yellow"))
            .otherwise(F.lit("red")))


def escalate_zone(zone: Column, weight_sum: Column) -> Column:
    """Rule weight >= 3 lifts green to yellow; >= 5 forces red."""
    return (F.when(weight_sum >= config.ESCALATE_TO_RED_WEIGHT, F.lit("red"))
            .when((weight_sum >= config.ESCALATE_TO_YELLOW_WEIGHT) & (zone == "green"), F.lit("yellow"))
            .otherwise(zone))


def priority(score: Column, debt: Column) -> Column:
    """E5: score x max(debt, 0); a missing debt stays missing."""
    return score * clip(debt, lower=0.0)


def recommendations(zone: Column, triggered: Column) -> Column:
    """Recommendation texts from zone and fired rules (native array expression, no UDF)."""
    def fired(name: str) -> Column:
        return F.coalesce(F.array_contains(triggered, name), F.lit(False))

    red = F.array(
        F.when(fired("no_recent_payment") | fired("high_dpd") | fired("bankruptcy_trigger"),
               F.lit(config.REC_COLLECTIONS)).otherwise(F.lit(config.REC_RESTRUCTURE)),
        F.lit(config.REC_BLOCK_LIMIT),
    )
    yellow_parts = F.array_compact(F.array(
        F.when(fired("utilization_high"), F.lit(config.REC_LOWER_LIMIT)),
        F.when(fired("pdn_spike"), F.lit(config.REC_REFINANCE)),
        F.when(fired("payments_drop"), F.lit(config.REC_REMINDER)),
    ))
    yellow = F.when(F.size(yellow_parts) > 0, yellow_parts).otherwise(F.array(F.lit(config.REC_WATCHLIST)))
    return (F.when(zone == "red", red)
            .when(zone == "yellow", yellow)
            .otherwise(F.array(F.lit(config.REC_KEEP_TERMS))))


def score_and_zone(df: DataFrame, rules: list[dict] | None = None, zones: dict | None = None,
                   score_col: str = "risk_score") -> DataFrame:
    """E2 + E3 + E4 + E5 + R1 on every row of ``df`` (keeps all input columns)."""
    ruled = apply_rules(df, rules)
    debt = F.col("total_debt") if "total_debt" in df.columns else F.lit(0.0)
    zone = escalate_zone(score_zone(F.col(score_col), zones), F.col("rules_weight_sum"))
    return (ruled.withColumn("zone", zone)
            .withColumn("recommendations", recommendations(F.col("zone"), F.col("rules_triggered")))
            .withColumn("priority", priority(F.col(score_col), debt)))


def ews_scored(df: DataFrame, rules: list[dict] | None = None, zones: dict | None = None,
               score_col: str = "risk_score", sort: bool = False, with_recommendations: bool = False) -> DataFrame:
    """E6 (+ R2): id, borrower, date, score, debt, fired rules, weight sum, zone, priority
    (and recommendations); ``sort`` orders by priority desc with credit_id as tie breaker."""
    present = set(df.columns)
    scored = score_and_zone(df, rules, zones, score_col)
    cols = [
        F.col("credit_id"),
        F.col("borrower_id") if "borrower_id" in present else F.lit(None).cast("bigint").alias("borrower_id"),
        F.col("report_date_as_of") if "report_date_as_of" in present else F.lit(None).cast("timestamp_ntz").alias(
            "report_date_as_of"),
        F.col(score_col).alias("risk_score"),
        F.col("total_debt") if "total_debt" in present else F.lit(0.0).alias("total_debt"),
        F.col("rules_triggered"),
        F.col("rules_weight_sum"),
        F.col("zone"),
        F.col("priority"),
    ]
    if with_recommendations:
        cols.append(F.col("recommendations"))
    out = scored.select(*cols)
    if sort:
        out = out.orderBy(F.desc_nulls_last("priority"), F.col("credit_id"))
    return out


def zone_keys(spark) -> DataFrame:
    """The three zone keys in display order (a fixed three-row table)."""
    return spark.createDataFrame([(z, i) for i, z in enumerate(config.ZONE_ORDER)], "zone string, zone_order int")


def ews_summary(scored: DataFrame) -> DataFrame:
    """E7 (+ J2): per zone distinct contracts, debt sum, mean score, always three rows in the
    order green, yellow, red; a zone without contracts has NULL measures."""
    agg = (scored.filter(F.col("zone").isNotNull())
           .groupBy("zone")
           .agg(F.count_distinct("credit_id").alias("n_contracts"),
                F.coalesce(F.sum("total_debt"), F.lit(0.0)).alias("sum_debt"),
                F.avg("risk_score").alias("avg_score")))
    keys = zone_keys(scored.sparkSession)
    return (F.broadcast(keys).join(agg, "zone", "left")
            .orderBy("zone_order").select("zone", "n_contracts", "sum_debt", "avg_score"))


def zone_counts(scored: DataFrame) -> DataFrame:
    """Contracts per zone with missing zones as 0."""
    agg = scored.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    keys = zone_keys(scored.sparkSession)
    return (F.broadcast(keys).join(agg, "zone", "left")
            .select("zone", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_contracts"), "zone_order")
            .orderBy("zone_order").drop("zone_order"))


def ews_top(scored: DataFrame, zone: str | None = None, limit: int = 100) -> DataFrame:
    """L1 / V2: optional zone filter, highest priority first (credit_id breaks ties), limit
    1..10000.  Planned as one TakeOrderedAndProject: each partition keeps its own top ``limit``."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be in 1..10000")
    if zone is not None and zone not in config.ZONE_ORDER:
        raise ValueError(f"unknown zone {zone!r}")
    out = scored if zone is None else scored.filter(F.col("zone") == zone)
    return out.orderBy(F.desc_nulls_last("priority"), F.col("credit_id")).limit(limit)
