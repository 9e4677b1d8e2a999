"""V1: stateless scoring of incoming panel records, the same function on batch and streaming
DataFrames (``readStream`` -> ``score_records`` -> ``writeStream``).

Per record: typing and derived fields (derived only where the inputs are present and the
derived field itself is missing), row-wise features without rolling history, model probability
(or the formula score when no model is given), rules, zone, recommendations and priority.  No
state is kept, so no watermark is needed; sinks are append-only files.  The checkpoint belongs to
the sink: a second start into the same sink goes on where the first one ended, and each input
file reaches the sink once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import cleaning, ews, features

OUTPUT_COLS = ["credit_id", "report_date_as_of", "risk_score", "zone", "rules_triggered", "recommendations",
               "rules_weight_sum", "priority"]


DERIVED = ["age", "months_on_book", "days_since_last_payment", "utilization", "payment_ratio_1m",
           "payment_ratio_mom", "is_bankrupt"]


def _derive_missing(df: DataFrame) -> DataFrame:
    """Derived fields from their inputs; a value carried by the payload wins when it is not NULL."""
    given = [c for c in DERIVED if c in df.columns]
    d = cleaning.derived_fields(df.withColumnsRenamed({c: f"_given_{c}" for c in given}))
    out = {c: (F.coalesce(F.col(f"_given_{c}"), F.col(c)) if c in d.columns else F.col(f"_given_{c}"))
           for c in given}
    return d.withColumns(out).drop(*[f"_given_{c}" for c in given]) if given else d


def score_records(df: DataFrame, model=None, rules: list[dict] | None = None, zones: dict | None = None) -> DataFrame:
    """Score raw records (batch or streaming)."""
    typed = cleaning.drop_noisy(cleaning.cast_types(df))
    typed = _derive_missing(typed)
    feats = features.feature_set(typed, include_rolling=False)
    if model is not None:
        from ..operators.modeling import predict_proba
        scored = predict_proba(model, feats)
    else:
        scored = ews.formula_score(feats)
    out = ews.score_and_zone(scored, rules, zones)
    return out.select(*[c for c in OUTPUT_COLS if c in out.columns])


def run_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                       checkpoint_dir: str | None = None, model=None, max_files_per_trigger: int = 64) -> None:
    """Run V1 over every file present in ``source_dir`` (``availableNow``) into parquet at
    ``sink_dir``; the checkpoint is the folder named, or ``<sink_dir>.checkpoint``."""
    ckpt = checkpoint_dir or f"{sink_dir.rstrip('/')}.checkpoint"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (score_records(stream, model)
         .writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
