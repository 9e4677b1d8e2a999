"""Default models: preprocessing, class weights, logistic regression, leaf-wise boosted trees
(``boosting``) and MLlib's level-wise ones, time-ordered split, expanding-window CV, importance, scoring, persistence (D1-D9, S7).

Preprocessing (D1): numeric columns are filled with their exact median and scaled by their standard deviation
without centring; categorical columns are mode-imputed, categories below 1 % of the training
rows are pooled into one "infrequent" level.  A category never seen in training counts as
infrequent too, so that no model has to carry the list of rare values; if training had no
infrequent one it encodes to all zeros (StringIndexer keep + OneHotEncoder dropLast).
"""
from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import boosting, metrics, ranks

INFREQUENT = "__infrequent__"
WEIGHT = "_class_weight"


@dataclass
class CategoryMaps:
    """Fitted mode and frequent levels of every categorical column, and whether it has others."""
    mode: dict = field(default_factory=dict)
    frequent: dict = field(default_factory=dict)
    pools: dict = field(default_factory=dict)


def fit_category_maps(df: DataFrame, cat_cols: list[str], min_share: float = config.RARE_CATEGORY_SHARE) -> CategoryMaps:
    """Mode (ties -> smallest value) and frequency split of each categorical column, from one
    grouped count per column (the result has one row per category: bounded by cardinality)."""
    maps = CategoryMaps()
    if not cat_cols:
        return maps
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v"))
                                         for c in cat_cols])).alias("kv")).select("kv.col", "kv.v")
    counts = long.filter(F.col("v").isNotNull()).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["col"]: r for r in long.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known")).collect()}
    # the most frequent value of each column, and the values above the share: 1 / min_share a column at most
    modes = {r["col"]: r["m"]["v"] for r in counts.groupBy("col").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("v"))).alias("m")).collect()}
    limit = F.create_map(*(F.lit(x) for c, r in totals.items() for x in (c, float(min_share * r["n"]))))
    imputed = F.create_map(*(F.lit(x) for c, r in totals.items() for x in (c, r["n"] - r["known"])))
    top = F.create_map(*(F.lit(x) for c in totals for x in (c, modes.get(c))))
    # the imputed mode also counts towards the frequency of that level
    n = F.col("n") + F.when(F.col("v") == top[F.col("col")], imputed[F.col("col")]).otherwise(F.lit(0))
    frequent = counts.where(n >= limit[F.col("col")]).select("col", "v").collect() if totals else []
    for c in cat_cols:
        maps.mode[c] = modes.get(c)
        maps.frequent[c] = sorted(r["v"] for r in frequent if r["col"] == c)
        known = totals[c]["known"] if c in totals else 0
        maps.pools[c] = bool(known) and not counts.where((F.col("col") == c) & ~F.col("v").isin(*maps.frequent[c])).isEmpty()
    return maps


def apply_category_maps(df: DataFrame, maps: CategoryMaps) -> DataFrame:
    """Mode-impute and pool: frequent levels stay, all others become one level if the training rows
    had any, else NULL (encoded as all zeros).  Rare levels are never listed: a column may have
    millions of them."""
    out = {}
    for c, mode in maps.mode.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(mode))
        out[f"{c}__cat"] = F.when(v.isin(*maps.frequent[c]), v).when(v.isNotNull() & F.lit(maps.pools[c]), F.lit(INFREQUENT))
    return df.withColumns(out) if out else df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """D2: "balanced" weights n / (2 n_class) as a column (class counts are a two-row aggregate)."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    n = sum(counts.values())
    expr = F.lit(1.0)
    for cls, cnt in counts.items():
        if cls is not None and cnt:
            expr = F.when(F.col(label).cast("int") == cls, F.lit(n / (len(counts) * cnt))).otherwise(expr)
    return df.withColumn(WEIGHT, expr)


def _classifier(model_type: str, n_rows: int, params: dict | None = None):
    p = dict(params or {})
    if model_type == "logreg":
        return LogisticRegression(featuresCol="features", labelCol="_label", weightCol=WEIGHT,
                                  maxIter=p.get("maxIter", 2000), regParam=p.get("regParam", 1.0 / max(n_rows, 1)),
                                  elasticNetParam=0.0, standardization=False)
    if model_type == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="_label", weightCol=WEIGHT,
                             maxIter=p.get("maxIter", 600), maxDepth=p.get("maxDepth", 6),
                             stepSize=p.get("stepSize", 0.05), minInstancesPerNode=p.get("minInstancesPerNode", 50),
                             subsamplingRate=p.get("subsamplingRate", 1.0), seed=config.RANDOM_STATE)
    if model_type == "leafwise":
        return None                                             # fitted on the assembled features, not by MLlib
    raise ValueError(f"unknown model_type {model_type!r}")


def build_pipeline(num_cols: list[str], cat_cols: list[str], classifier) -> Pipeline:
    """Filled numeric columns, StringIndexer(keep) -> OneHotEncoder -> VectorAssembler ->
    StandardScaler(withMean=False) -> classifier, if it is one of MLlib."""
    stages = []
    imputed = [f"{c}__imp" for c in num_cols]
    idx = [f"{c}__idx" for c in cat_cols]
    ohe = [f"{c}__ohe" for c in cat_cols]
    if cat_cols:
        stages.append(StringIndexer(inputCols=[f"{c}__cat" for c in cat_cols], outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer (keep) already appends an "unknown" level; dropLast removes exactly that level
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=imputed + ohe, outputCol="_raw_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="_raw_features", outputCol="features", withMean=False, withStd=True))
    if classifier is not None:
        stages.append(classifier)
    return Pipeline(stages=stages)


@dataclass
class CreditModel:
    """Fitted pipeline plus everything needed to score and report."""
    pipeline: PipelineModel
    numeric_features: list[str]
    categorical_features: list[str]
    categories: CategoryMaps
    model_type: str = "logreg"
    medians: dict = field(default_factory=dict)
    booster: boosting.Booster | None = None
    metrics_train: dict = field(default_factory=dict)
    metrics_test: dict = field(default_factory=dict)
    cv_metrics: dict = field(default_factory=dict)

    def save(self, path: str) -> str:
        """MLlib pipeline + JSON sidecar (feature lists, category maps, metrics)."""
        self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        meta = {"numeric_features": self.numeric_features, "categorical_features": self.categorical_features,
                "categories": asdict(self.categories), "model_type": self.model_type, "medians": self.medians,
                "booster": self.booster.to_dict() if self.booster else None,
                "metrics_train": self.metrics_train, "metrics_test": self.metrics_test, "cv_metrics": self.cv_metrics}
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "meta"))
        return path

    @staticmethod
    def load(spark, path: str) -> "CreditModel":
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        return CreditModel(pipeline=PipelineModel.load(os.path.join(path, "pipeline")),
                           numeric_features=meta["numeric_features"], categorical_features=meta["categorical_features"],
                           categories=CategoryMaps(**meta["categories"]), model_type=meta["model_type"], medians=meta["medians"],
                           booster=boosting.Booster.from_dict(meta["booster"]) if meta["booster"] else None,
                           metrics_train=meta["metrics_train"], metrics_test=meta["metrics_test"],
                           cv_metrics=meta["cv_metrics"])


def add_missing_columns(df: DataFrame, model: CreditModel) -> DataFrame:
    """Model inputs absent from ``df`` are added as NULL (then imputed)."""
    missing = {c: F.lit(None).cast("double") for c in model.numeric_features if c not in df.columns}
    missing.update({c: F.lit(None).cast("string") for c in model.categorical_features if c not in df.columns})
    return df.withColumns(missing) if missing else df


def encoded(model: CreditModel, df: DataFrame) -> DataFrame:
    """``df`` with the model's inputs filled, encoded and assembled, and the outputs of an MLlib classifier."""
    data = apply_category_maps(add_missing_columns(df, model), model.categories)
    return model.pipeline.transform(ranks.fill_medians(data, model.medians, "__imp"))


def predict_proba(model: CreditModel, df: DataFrame, out_col: str = "risk_score") -> DataFrame:
    """P(default) for every row; missing model columns are filled with NULL first."""
    if WEIGHT not in df.columns:
        df = df.withColumn(WEIGHT, F.lit(1.0))
    if "_label" not in df.columns:
        df = df.withColumn("_label", F.lit(0.0))
    scored = encoded(model, df)
    helper = [c for c in scored.columns if c.endswith(("__imp", "__idx", "__ohe", "__cat"))]
    if model.booster is not None:
        scored = boosting.with_margin(scored.withColumn("_x", vector_to_array("features")), model.booster, "_x", "_margin")
        chance = 1 / (1 + F.exp(-F.col("_margin")))
    else:
        chance = vector_to_array("probability")[1]
    return (scored.withColumn(out_col, chance)
            .drop(*helper, "_raw_features", "features", "_x", "_margin", "rawPrediction", "probability", "prediction", WEIGHT, "_label"))


def time_split(df: DataFrame, time_col: str = "report_date_as_of", key: str = "credit_id",
               test_size: float = config.TEST_SIZE, label: str = "_label") -> tuple[DataFrame, DataFrame]:
    """Order by time (``key``, then a hash of the row, break ties), first (1 - test_size) of the
    rows train, the rest test.  Only the row at the cut is looked for; no row moves (``ranks.cut_at``).
    Without ``time_col`` the split is random, by a hash of the row, and stratified by ``label``."""
    if time_col not in df.columns:
        return _stratified_split(df, label, test_size)
    key_cols = [F.col(time_col), F.col(key), F.xxhash64(*[F.col(c) for c in df.columns])]
    return ranks.cut_at(df, key_cols, test_size)


def _stratified_split(df: DataFrame, label: str, test_size: float) -> tuple[DataFrame, DataFrame]:
    """Of each class the first (1 - test_size) rows in the order of a seeded hash train, the rest test."""
    shuffled = df.withColumn("_rk", F.xxhash64(F.lit(config.RANDOM_STATE), *[F.col(c) for c in df.columns]))
    train = test = None
    for row in df.groupBy(label).count().collect():
        own = ranks.row_positions(shuffled.where(F.col(label).eqNullSafe(F.lit(row[0]))), [("_rk", False)], pos_col="_split_pos").drop("_rk")
        cut = int(row["count"] * (1 - test_size))
        a, b = own.filter(F.col("_split_pos") < cut).drop("_split_pos"), own.filter(F.col("_split_pos") >= cut).drop("_split_pos")
        train, test = (a, b) if train is None else (train.unionByName(a), test.unionByName(b))
    return (train, test) if train is not None else (df, df)


def _report(scored: DataFrame, label: str) -> dict:
    row = metrics.binary_report(scored, label, "risk_score").first()
    return {k: (float(v) if isinstance(v, float) else v) for k, v in row.asDict().items()}


def train_model(df: DataFrame, num_cols: list[str], cat_cols: list[str], label: str = config.TARGET_COL,
                model_type: str = "logreg", params: dict | None = None, n_folds: int = config.N_FOLDS,
                time_col: str = "report_date_as_of", key: str = "credit_id", cv: bool = True, stored: bool = False) -> CreditModel:
    """Time split, expanding-window CV ROC-AUC on the training part (D6), fit, metrics on
    both parts.  The training frame is written once and read by every fit; a ``stored`` one is not written again."""
    from ..session import materialize
    # one materialisation of the (expensive) feature panel; every stage and fit reads it, without its plan
    data = df.withColumn("_label", F.col(label).cast("double"))
    data = data if stored else materialize(data)
    train, test = time_split(data, time_col, key)
    cv_scores = []
    if cv and n_folds > 1 and time_col not in data.columns:
        fold = F.pmod(F.xxhash64(F.lit(config.RANDOM_STATE + 1), *[F.col(c) for c in train.columns]), F.lit(n_folds))
        for i in range(n_folds):
            m = _fit(train.where(fold != i), num_cols, cat_cols, label, model_type, params)
            auc = metrics.curve_stats(predict_proba(m, train.where(fold == i)), label, "risk_score").first()
            if auc is not None and auc["roc_auc"] is not None:
                cv_scores.append(auc["roc_auc"])
    elif cv and n_folds > 1:
        tied = train.withColumn("_tie", F.xxhash64(*[F.col(c) for c in train.columns]))
        pos = materialize(ranks.row_positions(tied, [(time_col, False), (key, False), ("_tie", False)], pos_col="_cv_pos").drop("_tie"))
        n = pos.count()
        fold = n // (n_folds + 1)

        def run_fold(i):
            test_start = n - (n_folds - i) * fold
            tr = pos.filter(F.col("_cv_pos") < test_start).drop("_cv_pos")
            te = pos.filter((F.col("_cv_pos") >= test_start) & (F.col("_cv_pos") < test_start + fold)).drop("_cv_pos")
            m = _fit(tr, num_cols, cat_cols, label, model_type, params)
            return metrics.curve_stats(predict_proba(m, te), label, "risk_score").first()["roc_auc"]

        # folds are independent Spark jobs: submit them concurrently (like CrossValidator parallelism)
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=min(n_folds, config.CV_PARALLELISM)) as pool:
            for auc in pool.map(run_fold, range(n_folds)):
                if auc is not None and not math.isnan(auc):
                    cv_scores.append(auc)
    model = _fit(train, num_cols, cat_cols, label, model_type, params)
    model.metrics_train = _report(predict_proba(model, train), label)
    model.metrics_test = _report(predict_proba(model, test), label)
    if cv_scores:
        mean = sum(cv_scores) / len(cv_scores)
        model.cv_metrics = {"cv_roc_auc_mean": mean,
                            "cv_roc_auc_std": math.sqrt(sum((s - mean) ** 2 for s in cv_scores) / len(cv_scores))}
    return model


def _fit(train: DataFrame, num_cols, cat_cols, label, model_type, params) -> CreditModel:
    from ..session import keep, materialize
    # an input without any value has no median: it is left out of this fit
    known = train.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(c) for c in num_cols]).first() if num_cols else {}
    num_cols = [c for c in num_cols if known[c]]
    maps = fit_category_maps(train, cat_cols)
    prepared = class_weights(apply_category_maps(train, maps), "_label" if "_label" in train.columns else label)
    if "_label" not in prepared.columns:
        prepared = prepared.withColumn("_label", F.col(label).cast("double"))
    medians = ranks.column_medians(prepared, num_cols)
    prepared = ranks.fill_medians(prepared, medians, "__imp")
    # written, so that none of the many short jobs of a fit carries the plan; in few parts, as a pass is quick
    prepared = materialize(prepared.select(*[f"{c}__imp" for c in num_cols], *[f"{c}__cat" for c in cat_cols], "_label", WEIGHT))
    n = prepared.count()
    prepared = keep(prepared.coalesce(max(1, -(-n // boosting.BLOCK_ROWS))))
    pipe = build_pipeline(num_cols, cat_cols, _classifier(model_type, n, params)).fit(prepared)
    model = CreditModel(pipeline=pipe, numeric_features=list(num_cols), categorical_features=list(cat_cols),
                        categories=maps, model_type=model_type, medians=medians)
    if model_type == "leafwise":
        rows = materialize(pipe.transform(prepared).select(vector_to_array("features").alias("_x"), "_label", WEIGHT))
        model.booster = boosting.fit(rows, "_x", "_label", WEIGHT, len(encoded_feature_names(model)), boosting.BoostParams(**(params or {})))
    prepared.unpersist()
    return model


def encoded_feature_names(model: CreditModel) -> list[str]:
    """Names of the assembled vector slots (numeric names, then category levels)."""
    names = list(model.numeric_features)
    stages = model.pipeline.stages
    indexer = next((s for s in stages if s.__class__.__name__ == "StringIndexerModel"), None)
    if indexer is not None:
        for c, labels in zip(model.categorical_features, indexer.labelsArray):
            names += [f"{c}_{v}" for v in labels]  # dropLast removes the "unseen" slot
    return names


def encoded_feature_sources(model: CreditModel) -> list[str]:
    """The input column behind every assembled vector slot."""
    sources = list(model.numeric_features)
    indexer = next((s for s in model.pipeline.stages if s.__class__.__name__ == "StringIndexerModel"), None)
    if indexer is not None:
        for c, labels in zip(model.categorical_features, indexer.labelsArray):
            sources += [c] * len(labels)
    return sources


def feature_importance(model: CreditModel) -> list[tuple[str, float]]:
    """Splits of leaf-wise trees, tree importances or |coefficients| by encoded feature, highest first."""
    clf = model.pipeline.stages[-1]
    names = encoded_feature_names(model)
    vals = (model.booster.split_counts() if model.booster is not None else clf.featureImportances.toArray() if hasattr(clf, "featureImportances")
            else [abs(x) for x in clf.coefficients.toArray()])
    pairs = list(zip(names, [float(v) for v in vals]))
    return sorted(pairs, key=lambda t: (-t[1], t[0]))
