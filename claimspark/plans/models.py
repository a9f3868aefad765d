"""Fraud classifiers with Spark ML.

The feature frame is encoded (label codes in alphabetical order, missing
labels as "Unknown"), restricted to complete rows, split with a per-row hash
(repeatable, no shuffle), and three models are fitted: logistic regression on
standardised features, a random forest and gradient-boosted trees on raw
features.  Scores, AUC, reports and importances are DataFrames computed on
the executors (see ``claimspark.operators.evaluation``).

Differences to scikit-learn / XGBoost that are inherent and documented:
Spark's ``StandardScaler`` uses the sample standard deviation; sklearn's
``C=1`` L2 penalty is expressed as ``regParam = 1 / n_train``; Spark trees
are at most 30 levels deep (sklearn's forest grows until pure); Spark's GBT has no L2
leaf penalty.  Compare these models on ranking quality (AUC), not on
coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.operators.evaluation import auc
from claimspark.operators.ranking import sequential_ids
from claimspark.operators.sampling import hash_sample, hash_split
from claimspark.session import BROADCAST_ROWS, stored

FEATURES = FV.NUMERIC_FEATURES + [enc for _, enc in FV.CATEGORICAL_FEATURES]


def encode(df: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(FV.CATEGORICAL_FEATURES),
           fill: str = FV.UNKNOWN_LABEL) -> DataFrame:
    """Integer codes for categorical columns, codes assigned in sorted label order.

    The distinct labels are found in one aggregating pass (one group for each
    combination of labels) and numbered per column into one stored table of
    codes.  Up to ``BROADCAST_ROWS`` labels each column looks its codes up in a
    broadcast part of that table, beyond that the joins shuffle.
    """
    filled = df.na.fill(fill, subset=[s for s, _ in pairs])
    combinations = filled.select(*[s for s, _ in pairs]).distinct()
    labels = combinations.select(F.explode(F.array(*[
        F.struct(F.lit(out).alias("column"), F.col(src).alias("label")) for src, out in pairs])).alias("c"))
    labels = stored(labels.select("c.column", "c.label").distinct(), "labels")
    few = labels.count() <= BROADCAST_ROWS
    if few:
        order = Window.partitionBy("column").orderBy("label")
        codes = labels.withColumn("code", F.row_number().over(order) - 1)
    else:
        codes = sequential_ids(labels, ["label"], out="code", start=0, partition_by=["column"])
    codes = stored(codes, "label-codes")
    for src, out in pairs:
        own = codes.filter(F.col("column") == out).select(F.col("label").alias(src), F.col("code").cast("int").alias(out))
        filled = filled.join(F.broadcast(own) if few else own, src, "left")
    return filled.select(*df.columns, *[out for _, out in pairs])


def complete_rows(df: DataFrame, cols: Sequence[str] = tuple(FEATURES), label: str = FV.LABEL) -> DataFrame:
    """Rows with no null among the model columns and the label."""
    return df.na.drop(subset=list(cols) + [label])


def assemble(df: DataFrame, cols: Sequence[str] = tuple(FEATURES), out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def prepare(features: DataFrame, id_col: str = "claim_id", label: str = FV.LABEL,
            test_fraction: float = FV.TEST_FRACTION, seed: int = FV.SPLIT_SEED) -> DataFrame:
    """Encoded, complete, assembled rows with ``label`` (double) and ``is_test``."""
    enc = complete_rows(encode(features))
    vec = assemble(enc).withColumn("label", F.col(label).cast("double"))
    return hash_split(vec.select(id_col, "label", "features"), id_col, test_fraction, seed)


def training_sample(train: DataFrame, max_rows: int, id_col: str = "claim_id", seed: int = FV.SAMPLE_SEED) -> DataFrame:
    """About ``max_rows`` of the training rows (all, if there are no more): those
    whose id hashes lowest, so the sample is the same on every run."""
    n = train.count()
    return train if n <= max_rows else hash_sample(train, id_col, max_rows / n, seed)


def fit_scaler(train: DataFrame, col: str = "features", out: str = "scaled") -> Model:
    return StandardScaler(inputCol=col, outputCol=out, withMean=True, withStd=True).fit(train)


def fit_logistic(train: DataFrame, col: str = "scaled", max_iter: int = FV.LOGISTIC_MAX_ITER,
                 n_train: int | None = None) -> Model:
    """L2 logistic regression, ``regParam = 1 / n_train`` (sklearn's C = 1)."""
    n = n_train or train.count()
    lr = LogisticRegression(featuresCol=col, labelCol="label", maxIter=max_iter,
                            regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)
    return lr.fit(train)


def fit_forest(train: DataFrame, trees: int = FV.FOREST_TREES, max_depth: int = FV.FOREST_MAX_DEPTH,
               seed: int = FV.SPLIT_SEED) -> Model:
    """Random forest on unscaled features, grown to Spark's largest depth."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed)
    return rf.fit(train)


def fit_boosted(train: DataFrame, rounds: int = FV.BOOSTED_ROUNDS, max_depth: int = 6,
                step: float = 0.3, seed: int = FV.SPLIT_SEED) -> Model:
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds,
                        maxDepth=max_depth, stepSize=step, seed=seed)
    return gbt.fit(train)


def score(model: Model, df: DataFrame, suffix: str = "") -> DataFrame:
    """``df`` with ``probability{suffix}`` (positive class) and ``prediction{suffix}``."""
    model = (model.copy().setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction"))
    out = model.transform(df)
    return out.withColumns({f"probability{suffix}": vector_to_array("_probability")[1],
                            f"prediction{suffix}": F.col("_prediction").cast("int")}).drop("_raw", "_probability", "_prediction")


def compare(scored: dict[str, DataFrame]) -> DataFrame:
    """``model, auc, n_pos, n_neg`` for each scored test set."""
    parts = [auc(s, "label", "probability").select(F.lit(name).alias("model"), "auc", "n_pos", "n_neg")
             for name, s in scored.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(model: Model, names: Sequence[str] = tuple(FEATURES), top: int = FV.TOP_IMPORTANCES) -> DataFrame:
    """The ``top`` feature importances of a tree model, largest first.

    The importance vector lives in the fitted model (one number per feature),
    so the table is built from it directly.
    """
    vals = model.featureImportances.toArray().tolist()
    session = SparkSession.getActiveSession()
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    df = session.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


MODELS = ("logistic", "forest", "boosted")


class FraudModels:
    """The three classifiers, fitted on at most about ``max_train_rows`` training
    rows (the only bounded part); every test row is scored."""

    def __init__(self, prepared: DataFrame, trees: int = FV.FOREST_TREES,
                 rounds: int = FV.BOOSTED_ROUNDS, max_iter: int = FV.LOGISTIC_MAX_ITER,
                 max_train_rows: int = FV.MAX_TRAIN_ROWS, max_depth: int = FV.FOREST_MAX_DEPTH):
        self.data = stored(prepared, "model-rows")
        self.train = self.data.filter(F.col("is_test") == 0)
        self.test = self.data.filter(F.col("is_test") == 1)
        self.sample = training_sample(self.train, max_train_rows)
        self.trees, self.rounds, self.max_iter, self.max_depth = trees, rounds, max_iter, max_depth
        self.fitted: dict[str, Model] = {}
        self._scored = None

    def scaler(self) -> Model:
        if "scaler" not in self.fitted:
            self.fitted["scaler"] = fit_scaler(self.sample)
        return self.fitted["scaler"]

    def fit_all(self) -> "FraudModels":
        """Fit what is not fitted yet.  The jobs of the fits are submitted
        concurrently, so the many short jobs of one fill the gaps of the others;
        the sample is cached while they run."""
        missing = [m for m in MODELS if m not in self.fitted]
        if missing:
            # bounded rows, read once per iteration or tree level: few tasks of some size
            width = 2 * self.sample.sparkSession.sparkContext.defaultParallelism
            width = min(width, 1 + self.sample.count() // 5_000)
            rows = self.scaler().transform(self.sample).repartition(width).persist()
            fits = {"logistic": lambda: fit_logistic(rows, max_iter=self.max_iter),
                    "forest": lambda: fit_forest(rows, trees=self.trees, max_depth=self.max_depth),
                    "boosted": lambda: fit_boosted(rows, rounds=self.rounds)}
            with ThreadPoolExecutor(max_workers=len(missing)) as pool:
                found = {m: pool.submit(fits[m]) for m in missing}
                self.fitted.update({m: f.result() for m, f in found.items()})
            rows.unpersist()
        return self

    def boosted(self) -> Model:
        return self.fit_all().fitted["boosted"]

    def scores(self) -> DataFrame:
        """Every test row once, with the probability and class of all three models
        (``probability_logistic`` ...): one pass, written to the shared folder."""
        if self._scored is None:
            self.fit_all()
            rows = self.scaler().transform(self.test)
            for m in MODELS:
                rows = score(self.fitted[m], rows, f"_{m}")
            self._scored = stored(rows.select(
                "claim_id", F.col("label").cast("int").alias("label"),
                *[c for m in MODELS for c in (f"probability_{m}", f"prediction_{m}")]), "model-scores")
        return self._scored

    def scored(self, which: str) -> DataFrame:
        """``claim_id, label, probability, prediction`` of one model."""
        return self.scores().select("claim_id", "label", F.col(f"probability_{which}").alias("probability"),
                                    F.col(f"prediction_{which}").alias("prediction"))

    def comparison(self) -> DataFrame:
        return compare({m: self.scored(m) for m in MODELS})
