"""The three fraud classifiers fitted on every training row.

Where ``plans.models`` hands a bounded sample to Spark ML, this module fits on
all rows with aggregates that stay small: whole-table moments for the scaler
(population deviation, as scikit-learn's), Newton steps for the logistic
regression (L2 penalty 1, intercept free: scikit-learn's C = 1), and histogram
trees for the forest and the boosted trees, the latter with second-order gains
and an L2 penalty of 1 on the leaves.  Every test row is scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.operators import logistic, trees
from claimspark.operators.moments import Moments, moments
from claimspark.operators.sampling import hash_split
from claimspark.plans.models import FEATURES, MODELS, compare, complete_rows, encode
from claimspark.session import free_shuffles, scratch, stored

#: Rows of a task of the tree fits: the most, and the least while cores are free.
TASK_ROWS, LEAST_TASK_ROWS = 1_000_000, 10_000


def model_rows(features: DataFrame, id_col: str = "claim_id", label: str = FV.LABEL,
               test_fraction: float = FV.TEST_FRACTION, seed: int = FV.SPLIT_SEED) -> DataFrame:
    """Encoded, complete rows: id, ``label`` (double), the 20 features as doubles, ``is_test``."""
    rows = complete_rows(encode(features)).select(
        id_col, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return hash_split(rows, id_col, test_fraction, seed)


class FullModels:
    """Fits on all training rows of ``rows`` (see ``model_rows``); nothing is sampled."""

    def __init__(self, rows: DataFrame, id_col: str = "claim_id", features: Sequence[str] = tuple(FEATURES),
                 n_trees: int = FV.FOREST_TREES, rounds: int = FV.BOOSTED_ROUNDS, forest_depth: int | None = None,
                 boosted_depth: int = 6, max_steps: int = FV.LOGISTIC_MAX_ITER, seed: int = FV.SPLIT_SEED):
        self.rows, self.id_col, self.features = stored(rows, "model-rows"), id_col, list(features)
        free_shuffles(self.rows.sparkSession)  # the joins' files, several times the rows
        self.train, self.test = (self.rows.filter(F.col("is_test") == part) for part in (0, 1))
        self.n_trees, self.rounds, self.max_steps, self.seed = n_trees, rounds, max_steps, seed
        self.forest_depth, self.boosted_depth = forest_depth, boosted_depth
        self.fitted: dict = {}
        self._moments: Moments | None = None
        self._scores: DataFrame | None = None
        self._own_scores: dict[str, DataFrame] = {}

    def moments(self) -> Moments:
        if self._moments is None:
            self._moments = moments(self.train, self.features)
        return self._moments

    def scaled_test(self) -> DataFrame:
        """The test rows with every feature scaled by the training rows' moments."""
        return self.moments().apply(self.test)

    def _binned(self, keys: bool) -> tuple[DataFrame, trees.Bins]:
        """The binned training rows, dealt evenly to the tasks of the tree fits; with the
        ``keys`` from which the forest draws rows."""
        bins, n = trees.fit_bins(self.train, self.features), self.train.count()
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(1 + n // TASK_ROWS, min(2 * cores, 1 + n // LEAST_TASK_ROWS))
        rows = bins.apply(self.train.withColumn("key", F.xxhash64(self.id_col)), ["key", "label"] if keys else ["label"])
        binned = stored(rows.repartition(tasks), "model-bins")
        free_shuffles(self.rows.sparkSession)
        return binned, bins

    def fit(self, which: Sequence[str]) -> FullModels:
        """Fit those of ``which`` that are not fitted yet.  The fits are many short jobs,
        submitted concurrently so that one fills the gaps of the others."""
        todo = [m for m in which if m not in self.fitted]
        if todo:
            with scratch(self.rows.sparkSession):  # the binned rows serve the fits alone
                fits = {}
                if "logistic" in todo:
                    scaled = self.moments().apply(self.train)
                    fits["logistic"] = lambda: logistic.fit_logistic(scaled, self.features, max_steps=self.max_steps)
                if {"forest", "boosted"} & set(todo):
                    rows, bins = self._binned("forest" in todo)
                    fits["forest"] = lambda: trees.fit_forest(rows, bins, self.n_trees, self.forest_depth, seed=self.seed)
                    fits["boosted"] = lambda: trees.fit_boosted(rows, bins, self.rounds, self.boosted_depth)
                with ThreadPoolExecutor(max_workers=len(todo)) as pool:
                    found = {m: pool.submit(fits[m]) for m in todo}
                    self.fitted |= {m: f.result() for m, f in found.items()}
        return self

    def fit_all(self) -> FullModels:
        return self.fit(MODELS)

    def model(self, which: str):
        return self.fit([which]).fitted[which]

    def _with_scores(self, names: Sequence[str]) -> DataFrame:
        """Every test row once: id, label, ``probability_*`` and ``prediction_*`` of ``names``."""
        self.fit(names)
        rows = self.test.select(self.id_col, "label", *self.features)
        for which in [m for m in names if m != "logistic"]:
            rows = self.fitted[which].score(rows, rows.columns).withColumnsRenamed(
                {c: f"{c}_{which}" for c in ("probability", "prediction")})
        if "logistic" in names:
            rows = self.fitted["logistic"].score(self.moments().apply(rows)).withColumnsRenamed(
                {c: f"{c}_logistic" for c in ("probability", "prediction")})
        return stored(rows.select(self.id_col, F.col("label").cast("int").alias("label"),
                                  *[f"{c}_{m}" for m in names for c in ("probability", "prediction")]), "model-scores")

    def scores(self) -> DataFrame:
        """Every test row once with the probabilities and predictions of the three models."""
        if self._scores is None:
            self._scores = self._with_scores(MODELS)
        return self._scores

    def scored(self, which: str) -> DataFrame:
        """id, label, probability and prediction of one model; the others need not be fitted."""
        if self._scores is None and which not in self._own_scores:
            self._own_scores[which] = self._with_scores([which])
        rows = self._own_scores.get(which, self._scores)
        return rows.select(self.id_col, "label", F.col(f"probability_{which}").alias("probability"),
                                    F.col(f"prediction_{which}").alias("prediction"))

    def comparison(self) -> DataFrame:
        self.scores()  # all three in one pass
        return compare({m: self.scored(m) for m in MODELS})

    def importances(self, which: str = "boosted", top: int = FV.TOP_IMPORTANCES) -> DataFrame:
        """The ``top`` feature importances of a tree model, largest first (as many rows as features at most)."""
        rows = [(name, float(v)) for name, v in self.model(which).importances().items()]
        df = self.rows.sparkSession.createDataFrame(rows, "feature string, importance double")
        return df.orderBy(F.col("importance").desc(), "feature").limit(top)

    def splits(self, which: str = "boosted") -> DataFrame:
        """tree, node, depth, feature, threshold, gain, n_rows of every split (bounded by the model)."""
        return self.rows.sparkSession.createDataFrame(
            self.model(which).splits(), "tree int, node int, depth int, feature string, threshold double, gain double, n_rows bigint")

    def coefficients(self) -> DataFrame:
        """feature, weight of the logistic model on scaled features; '(intercept)' last."""
        fit = self.model("logistic")
        rows = [*zip(fit.names, fit.weights), ("(intercept)", fit.intercept)]
        return self.rows.sparkSession.createDataFrame(rows, "feature string, weight double")
