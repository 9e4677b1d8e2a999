"""Typing, cleaning, portfolio filter, derived fields, last slice."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.columns import clip, days_between, finite_or_null

SAMPLE_CELL = 10_000           # rows of the last cell of a sample that are put in order


def cast_types(df: DataFrame) -> DataFrame:
    """Dates -> timestamp (unparsable -> null), numbers -> double (NaN/inf -> null),
    flags -> int with null -> 0, categories -> string with null -> 'UNKNOWN'.
    Only columns that are present are touched."""
    present = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in config.DATE_COLS:
        if c in present:
            if isinstance(types[c], T.StringType):
                out[c] = F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
            else:
                out[c] = F.col(c).cast("timestamp_ntz")
    for c in config.NUMERIC_COLS:
        if c in present:
            out[c] = finite_or_null(F.expr(f"try_cast(`{c}` AS double)"))
    for c in config.FLAG_COLS:
        if c in present:
            out[c] = F.coalesce(finite_or_null(F.expr(f"try_cast(`{c}` AS double)")).try_cast("int"), F.lit(0))
    for c in config.CATEGORICAL_COLS:
        if c in present:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(config.UNKNOWN))
    return df.withColumns(out) if out else df


def drop_noisy(df: DataFrame) -> DataFrame:
    """Drop the three noisy columns if present."""
    return df.drop(*[c for c in config.DROP_COLS if c in df.columns])


def filter_portfolio(df: DataFrame) -> DataFrame:
    """Keep rows that are neither sold nor forgiven; an absent flag counts as 0."""
    cond = F.lit(True)
    for c in config.FLAG_COLS:
        if c in df.columns:
            cond = cond & (F.col(c) != 1)
    return df.filter(cond)


def derived_fields(df: DataFrame) -> DataFrame:
    """Age, months on book, days since last payment, utilisation, payment ratios, bankrupt flag."""
    present = set(df.columns)
    ref = F.col("report_date_as_of") if "report_date_as_of" in present else F.localtimestamp()
    out = {}
    if "date_borrower_birthday" in present:
        out["age"] = F.bround(days_between(ref, F.col("date_borrower_birthday")) / 365.25, 1)
    if "date_issued" in present:
        out["months_on_book"] = F.bround(days_between(ref, F.col("date_issued")) / 30.44, 1)
    if "last_payment_date" in present:
        out["days_since_last_payment"] = days_between(ref, F.col("last_payment_date"))
    if {"initial_amount", "available_limit"} <= present:
        raw = (F.col("initial_amount") - F.col("available_limit")) / (F.abs(F.col("initial_amount")) + config.EPS)
        out["utilization"] = clip(raw, 0.0, 1.5)
    if {"payment_sum_1m", "total_debt"} <= present:
        out["payment_ratio_1m"] = F.col("payment_sum_1m") / (F.abs(F.col("total_debt")) + config.EPS)
    if {"payment_sum_1m", "payment_sum_2m"} <= present:
        out["payment_ratio_mom"] = F.col("payment_sum_1m") / (F.abs(F.col("payment_sum_2m")) + config.EPS)
    if "bankruptcy_stage" in present:
        bs = F.col("bankruptcy_stage")
        out["is_bankrupt"] = (bs.isNotNull() & (bs.cast("string") != config.UNKNOWN)).cast("int")
    return df.withColumns(out) if out else df


def last_slice(df: DataFrame, key: str = "credit_id", date_col: str = "report_date_as_of") -> DataFrame:
    """P5: one row per contract, the one with the latest report date (a missing date counts as
    the latest, like a pandas sort with NaN last).

    ``row_number() == 1`` over the contract: Spark plans it with a partial WindowGroupLimit that
    keeps one row per contract in every map task before the shuffle, so even a contract holding
    a large share of the rows reaches the exchange as one row per input split.  Rows that repeat
    (key, date) resolve by ``config.TIE_COLS``, a short fixed list, so that a query that needs few
    columns reads few; rows that agree in those as well are taken as the same observation."""
    if key not in df.columns or date_col not in df.columns:
        return df
    ties = [F.col(c).desc_nulls_last() for c in config.TIE_COLS if c in df.columns]
    w = Window.partitionBy(key).orderBy(F.col(date_col).desc_nulls_first(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def prepare_panel(raw: DataFrame, *, last_slice_only: bool = False, filter_sold_forgiven: bool = True) -> DataFrame:
    """P1 -> P2 -> P3 -> P4 -> (P5)."""
    df = raw.transform(cast_types).transform(drop_noisy)
    if filter_sold_forgiven:
        df = df.transform(filter_portfolio)
    df = df.transform(derived_fields)
    if last_slice_only:
        df = last_slice(df)
    return df


def is_leaky(name: str) -> bool:
    """A column is leaky if it equals a leaky prefix or starts with prefix + '_'."""
    return any(name == p or name.startswith(p + "_") for p in config.LEAKY_COL_PREFIXES)


def feature_columns(df: DataFrame, exclude_leaky: bool = True) -> tuple[list[str], list[str]]:
    """(numeric, categorical) model inputs from the schema, minus technical and leaky columns."""
    tech = set(config.TECHNICAL_COLS)
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in tech or (exclude_leaky and is_leaky(f.name)):
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
        elif isinstance(f.dataType, (T.StringType,)):
            cat.append(f.name)
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DateType,
                                         T.TimestampType, T.TimestampNTZType)):
            cat.append(f.name)
    return num, cat


def sample_rows(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = config.RANDOM_STATE) -> DataFrame:
    """Exactly ``n`` rows (all, if there are no more), the same ones however the table is partitioned: those with
    the smallest md5 of the seed and ``key_cols`` (of the whole row without them).

    Counts by the first digits of the hash, at most 4,096 to the driver, tell the cell in which the n-th row lies; a
    large cell is counted by its next digits.  Rows below the cell stay, and of the cell itself the first ones."""
    given = key_cols or df.columns
    parts = [F.col(c).cast("string") for c in given] if key_cols else [F.to_json(F.struct(*given))]
    tagged = df.withColumn("_sample", F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)))
    bound, need, size = "", max(n, 0), None
    while size is None or (size > SAMPLE_CELL and len(bound) < 30):
        digits = F.substring("_sample", len(bound) + 1, 3).alias("cell")
        cells = sorted(tuple(r) for r in tagged.where(F.col("_sample").startswith(bound)).groupBy(digits).count().collect())
        for cell, size in cells:
            if size >= need:
                bound += cell
                break
            need -= size
        else:
            return df                                           # no more than n rows
    inside = tagged.where(F.col("_sample").startswith(bound)).withColumn("_tie", F.xxhash64(*df.columns))
    first = inside.orderBy("_sample", "_tie").limit(need).drop("_tie")
    return tagged.where(F.col("_sample") < bound).unionByName(first).drop("_sample")
