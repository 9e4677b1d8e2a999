import os
import tempfile

from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import rules as R
from riskloom.operators import ews


def test_zone_table(spark):
    scores = [0.1499, 0.15, 0.3999, 0.40, None]
    weights = [0.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(i, s, w) for i, (s, w) in enumerate((s, w) for s in scores for w in weights)]
    df = spark.createDataFrame(rows, "id int, s double, w double")
    out = df.select("id", "s", "w", ews.escalate_zone(ews.score_zone(F.col("s")), F.col("w")).alias("z")).collect()

    def expect(s, w):
        z = "green" if s is not None and s < 0.15 else ("yellow" if s is not None and s < 0.40 else "red")
        if w >= 3 and z == "green":
            z = "yellow"
        if w >= 5:
            z = "red"
        return z
    for r in out:
        assert r.z == expect(r.s, r.w), (r.s, r.w, r.z)


def test_rules_each_alone_and_missing_column(spark):
    df = spark.createDataFrame(
        [(31.0, "1", 0.0, 0.0, 1.0, 0.0, 0), (0.0, "IV", 61.0, 0.0, 1.0, 0.0, 0),
         (None, None, None, None, None, None, None), (0.0, "1", 0.0, 61.0, 0.2, 0.95, 1)],
        "dpd double, quality_category string, pdn_current double, days_since_last_payment double, "
        "payment_ratio_mom double, utilization double, is_bankrupt int")
    out = ews.apply_rules(df).collect()
    assert out[0].rules_triggered == ["high_dpd"] and out[0].rules_weight_sum == 2.0
    assert out[1].rules_triggered == ["bad_quality", "pdn_spike"] and out[1].rules_weight_sum == 2.0
    assert out[2].rules_triggered == [] and out[2].rules_weight_sum == 0.0
    assert out[3].rules_triggered == ["no_recent_payment", "payments_drop", "utilization_high",
                                      "bankruptcy_trigger"]
    assert out[3].rules_weight_sum == 7.0
    # a rule over a missing column is all false; an empty rule list means the defaults
    miss = ews.apply_rules(df.drop("dpd"), [{"name": "x", "expr": "dpd > 1", "weight": 5}]).collect()
    assert all(r.rule_x == 0 and r.rules_weight_sum == 0.0 for r in miss)
    assert ews.apply_rules(df, []).columns == ews.apply_rules(df).columns


def test_rule_files_accept_pandas_isin_and_reject_queries(spark):
    assert R.normalize_expr("quality_category.isin(['III','IV'])") == "quality_category.isin(['III','IV'])"
    df = spark.createDataFrame([("IV",), ("I",)], "quality_category string")
    col = R.rule_column(df, "quality_category.isin(['III','IV'])")
    assert [r[0] for r in df.select(col).collect()] == [True, False]
    try:
        R.rule_column(df, "quality_category IN (SELECT 1)")
        raise AssertionError("query in a rule must be rejected")
    except ValueError:
        pass
    path = os.path.join(tempfile.mkdtemp(), "rules.yaml")
    R.save_rules(config.EWS_RULES, path)
    rules, zones = R.load_rules(path)
    assert [r["name"] for r in rules] == [r["name"] for r in config.EWS_RULES] and zones == config.EWS_ZONES


def test_recommendations(spark):
    cases = [("red", ["high_dpd"], [config.REC_COLLECTIONS, config.REC_BLOCK_LIMIT]),
             ("red", ["pdn_spike"], [config.REC_RESTRUCTURE, config.REC_BLOCK_LIMIT]),
             ("yellow", ["utilization_high", "payments_drop"], [config.REC_LOWER_LIMIT, config.REC_REMINDER]),
             ("yellow", [], [config.REC_WATCHLIST]),
             ("green", ["high_dpd"], [config.REC_KEEP_TERMS])]
    df = spark.createDataFrame([(z, r) for z, r, _ in cases], "zone string, rules_triggered array<string>")
    got = [r[0] for r in df.select(ews.recommendations(F.col("zone"), F.col("rules_triggered"))).collect()]
    assert got == [e for _, _, e in cases]


def test_summary_has_three_zones_and_partitions_contracts(spark):
    df = spark.createDataFrame([(1, 0.1, 10.0, 0.0), (2, 0.5, None, 0.0), (3, 0.2, 5.0, 0.0)],
                               "credit_id long, risk_score double, total_debt double, dpd double")
    scored = ews.ews_scored(df)
    summ = {r.zone: r for r in ews.ews_summary(scored).collect()}
    assert list(summ) == ["green", "yellow", "red"] or set(summ) == {"green", "yellow", "red"}
    assert sum(r.n_contracts or 0 for r in summ.values()) == 3
    assert summ["red"].sum_debt == 0.0  # all-missing debt sums to 0
    counts = {r.zone: r.n_contracts for r in ews.zone_counts(scored).collect()}
    assert counts == {"green": 1, "yellow": 1, "red": 1}
    top = ews.ews_top(scored, limit=2).collect()
    assert [r.credit_id for r in top] == [1, 3]  # equal priority 1.0: credit_id breaks the tie
