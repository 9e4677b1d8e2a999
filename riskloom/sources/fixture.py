"""Driver tables -> raw credit panel (one row per customer and order month).

This only produces rows in the raw panel schema the engine expects (see
FIXTURES.md section 5); no engine operator runs here.  Sums are taken in exact
decimals (here: integer cents) so that every engine that follows the same mapping gets the
same doubles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _per_order(li: DataFrame) -> DataFrame:
    # exact sums in integer cents (price) and cent x percent units (tax, discount): long
    # arithmetic is exact and fast; the doubles derived below are correctly rounded from it
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy("l_orderkey").agg(
        F.sum(cents).alias("gross_c"),
        F.sum(cents * F.round(F.col("l_tax") * 100).cast("long")).alias("tax_u"),
        F.sum(cents * F.round(F.col("l_discount") * 100).cast("long")).alias("disc_u"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint"))).alias("ret"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("dpct"),
        F.count(F.lit(1)).alias("n"),
    )


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_extendedprice", "l_tax", "l_discount", "l_returnflag", "l_quantity"])
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                         "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    per_order = _per_order(li)
    m = (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
        .groupBy(
            F.col("o_custkey").alias("k"),
            F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("ym"),
        )
        .agg(
            F.sum("gross_c").alias("gross_c"),
            F.sum("tax_u").alias("tax_u"),
            F.sum("disc_u").alias("disc_u"),
            F.sum("ret").alias("ret"),
            F.sum("qty").alias("qty"),
            F.sum("dpct").alias("dpct"),
            F.sum("n").alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("lim_c"),
            F.min(F.substring("o_orderpriority", 1, 1)).alias("q"),
            F.max(F.col("o_orderstatus") == "P").alias("pf"),
        )
    )
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = m.join(customer, m.k == customer.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))

    k = F.col("k")
    gross_d = F.col("gross_c").cast("double") / 100
    lim_d = F.col("lim_c").cast("double") / 100
    q_d = F.col("q").cast("double")
    n_d = F.col("n").cast("double")
    return joined.select(
        F.col("ym").alias("report_date_as_of"),
        k.alias("credit_id"),
        F.floor(k / 2).cast("bigint").alias("borrower_id"),
        F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        F.col("c_mktsegment").alias("loan_program"),
        F.col("r_name").alias("region_from_address"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("employer"),
        F.when(F.col("pf") & (k % 20 == 0), F.concat(F.lit("stage"), (k % 3).cast("string"))).alias(
            "bankruptcy_stage"),
        F.col("q").alias("quality_category"),
        (q_d * 0.1).alias("reserve_rate"),
        lim_d.alias("initial_amount"),
        gross_d.alias("total_debt"),
        (lim_d - gross_d / 2).alias("available_limit"),
        (gross_d * q_d / 10).alias("total_debt_reserve"),
        (F.col("ret") % 150).alias("dpd"),
        (F.col("ret") % 40).alias("expired_actual_days_count"),
        ((F.col("qty") * 2).cast("double") / n_d).alias("pdn_current"),
        (k % 50 + 20).alias("pdn_initial"),
        ((F.col("dpct") * 4).cast("double") / n_d).alias("psk_current"),
        (F.col("tax_u").cast("double") / 10000).alias("payment_sum_1m"),
        (F.col("disc_u").cast("double") / 10000).alias("payment_sum_2m"),
        ((F.col("tax_u") + F.col("disc_u")).cast("double") / 10000 / 2).alias("payment_sum_3m"),
        F.coalesce(F.col("n"), F.lit(0)).alias("cnt_all_payments"),
        F.date_sub(F.col("ym"), (F.col("qty") % 120).cast("int")).alias("last_payment_date"),
        F.date_add(F.lit("1992-01-01").cast("date"), (k * 37 % 1000).cast("int")).alias("date_issued"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k * 101 % 15000).cast("int")).alias(
            "date_borrower_birthday"),
        (k % 97 == 0).cast("int").alias("sold_flg"),
        (k % 89 == 0).cast("int").alias("forgiven_flg"),
    )


# The same mapping as DuckDB SQL, used by the independent oracle queries.
RAW_PANEL_SQL = """
li_agg AS (
  SELECT l_orderkey,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS disc,
         SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS ret,
         SUM(CAST(l_quantity AS BIGINT)) AS qty,
         SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS dpct,
         COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey
),
cust_month AS (
  SELECT o.o_custkey AS k, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ym,
         SUM(a.gross) AS gross, SUM(a.tax) AS tax, SUM(a.disc) AS disc, SUM(a.ret) AS ret,
         SUM(a.qty) AS qty, SUM(a.dpct) AS dpct, SUM(a.n) AS n,
         SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS lim,
         MIN(substr(o.o_orderpriority, 1, 1)) AS q,
         MAX(o.o_orderstatus = 'P') AS pf
  FROM orders o LEFT JOIN li_agg a ON o.o_orderkey = a.l_orderkey
  GROUP BY 1, 2
),
raw_panel AS (
  SELECT m.ym AS report_date_as_of,
         m.k AS credit_id,
         CAST(floor(m.k / 2) AS BIGINT) AS borrower_id,
         CASE WHEN m.k % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         c.c_mktsegment AS loan_program,
         r.r_name AS region_from_address,
         CASE WHEN m.k % 10 = 0 THEN NULL ELSE n.n_name END AS employer,
         CASE WHEN m.pf AND m.k % 20 = 0 THEN concat('stage', CAST(m.k % 3 AS VARCHAR)) END AS bankruptcy_stage,
         m.q AS quality_category,
         CAST(m.q AS DOUBLE) * 0.1 AS reserve_rate,
         CAST(m.lim AS DOUBLE) AS initial_amount,
         CAST(m.gross AS DOUBLE) AS total_debt,
         CAST(m.lim AS DOUBLE) - CAST(m.gross AS DOUBLE) / 2 AS available_limit,
         CAST(m.gross AS DOUBLE) * CAST(m.q AS DOUBLE) / 10 AS total_debt_reserve,
         m.ret % 150 AS dpd,
         m.ret % 40 AS expired_actual_days_count,
         CAST(m.qty * 2 AS DOUBLE) / CAST(m.n AS DOUBLE) AS pdn_current,
         m.k % 50 + 20 AS pdn_initial,
         CAST(m.dpct * 4 AS DOUBLE) / CAST(m.n AS DOUBLE) AS psk_current,
         CAST(m.tax AS DOUBLE) AS payment_sum_1m,
         CAST(m.disc AS DOUBLE) AS payment_sum_2m,
         CAST(m.tax + m.disc AS DOUBLE) / 2 AS payment_sum_3m,
         COALESCE(m.n, 0) AS cnt_all_payments,
         m.ym - CAST(m.qty % 120 AS INTEGER) AS last_payment_date,
         DATE '1992-01-01' + CAST(m.k * 37 % 1000 AS INTEGER) AS date_issued,
         DATE '1950-01-01' + CAST(m.k * 101 % 15000 AS INTEGER) AS date_borrower_birthday,
         CAST(m.k % 97 = 0 AS INTEGER) AS sold_flg,
         CAST(m.k % 89 = 0 AS INTEGER) AS forgiven_flg
  FROM cust_month m
  JOIN customer c ON c.c_custkey = m.k
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)
"""
