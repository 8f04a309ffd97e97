"""Classifiers on (transcript_id, features, label) tables, fusion of their scores, and experiment runs.

Training is Spark ML's own distributed optimisation. Only configurations are looped over in the driver; the data of
each fit stay in the cluster.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from conceptspark.functions import small_fits
from conceptspark.operators import forest, grouped_fits
from conceptspark.operators.embeddings import align_modalities
from conceptspark.operators.evaluation import class_report, macro_f1
from conceptspark.operators.experiments import class_weights
from conceptspark.operators.joins import join_counted
from conceptspark.operators.ranking import hash_order, rank_by_hash
from conceptspark.session import cut_lineage


@dataclass
class Fitted:
    """A trained model and its number of classes."""

    model: object
    classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``raw`` (one score per class) and ``yhat``."""
        scored = self.model.transform(rows.withColumn("_v", array_to_vector("features")))
        raw = vector_to_array("rawPrediction") if "rawPrediction" in scored.columns else F.lit(None).cast("array<double>")
        drop = [c for c in ("_v", "rawPrediction", "probability", "prediction") if c in scored.columns]
        proba = (
            vector_to_array("probability")
            if "probability" in scored.columns
            else one_hot(F.col("prediction"), self.classes)
        )
        return scored.withColumns({"raw": raw, "proba": proba, "yhat": F.col("prediction").cast("int")}).drop(*drop)


def one_hot(prediction, classes: int):
    return F.array(*[(prediction == k).cast("double") for k in range(classes)])


def predict_proba(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """(transcript_id, label, proba): class probabilities, or a one-hot where the model has none."""
    return fitted.predict(rows).select("transcript_id", "label", "proba")


def weighted(train: DataFrame, balanced: bool) -> DataFrame:
    """Training rows with vector ``_v`` and weight ``_w``; balanced weights make all classes count the same."""
    rows = train.withColumn("_v", array_to_vector("features"))
    if not balanced:
        return rows.withColumn("_w", F.lit(1.0))
    table = class_weights(train.select(F.lit("all").alias("target"), "label")).select("label", F.col("weight").alias("_w"))
    return join_counted(rows, table, ["label"])


def _n_classes(train: DataFrame) -> int:
    return int(train.agg(F.max("label")).first()[0]) + 1


COLUMNS = {"featuresCol": "_v", "labelCol": "label"}
PARALLEL_CLASSES = 4  # one-against-rest models fitted at the same time
LANDMARKS = 256  # rows that stand for all others in the kernel of the SVM


def fit_logistic(train: DataFrame, balanced: bool = True, c: float = 1.0, max_iter: int = 100) -> Fitted:
    """L2 logistic regression; a penalty 1/C per summed loss is 1/(C·Σw) per mean loss."""
    rows = weighted(train, balanced)
    total = rows.agg(F.sum("_w")).first()[0]
    estimator = LogisticRegression(
        **COLUMNS, weightCol="_w", family="multinomial", regParam=1.0 / (c * total), standardization=False, maxIter=max_iter
    )
    return Fitted(estimator.fit(rows), _n_classes(train))


def fit_random_forest(train: DataFrame, balanced: bool = True, trees: int = 100, seed: int = 42) -> forest.Forest:
    """Trees without a limit of depth, a root of the features tried per node."""
    return forest.train(weighted(train, balanced), _n_classes(train), trees, seed)


def fit_gradient_boost(train: DataFrame, rounds: int = 100, depth: int = 3, step: float = 0.1, seed: int = 42) -> Fitted:
    """Unweighted boosted trees; more than two classes go one against the rest."""
    classes = _n_classes(train)
    estimator = GBTClassifier(**COLUMNS, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    rows = weighted(train, False)
    if classes > 2:
        estimator = OneVsRest(**COLUMNS, classifier=estimator, parallelism=PARALLEL_CLASSES)
    return Fitted(estimator.fit(rows), classes)


def fit_svm(train: DataFrame, balanced: bool = True, max_iter: int = 100, kernel: str = "rbf", landmarks: int = LANDMARKS) -> Fitted | Kernelised:
    """SVM one against the rest, C = 1: with the kernel exp(-gamma |x - y|^2) by default, or ``kernel="linear"``."""
    if kernel == "linear":
        return _linear_svm(train, balanced, max_iter)
    lifter = nystroem(train, landmarks)
    lifted = cut_lineage(lifter.lift(train))  # training passes over its input many times
    return Kernelised(lifter, _linear_svm(lifted, balanced, max_iter))


def _linear_svm(train: DataFrame, balanced: bool, max_iter: int) -> Fitted:
    rows = weighted(train, balanced)
    total = rows.agg(F.sum("_w")).first()[0]
    base = LinearSVC(**COLUMNS, weightCol="_w", regParam=1.0 / total, maxIter=max_iter, standardization=False)
    several = OneVsRest(**COLUMNS, weightCol="_w", classifier=base, parallelism=PARALLEL_CLASSES)
    return Fitted(several.fit(rows), _n_classes(train))


@dataclass
class Nystroem:
    """Features whose dot products approximate an RBF kernel: values against landmark rows times a matrix.

    ``error`` is the mean difference to the true kernel over all pairs of other rows, as many as the landmarks.
    """

    sample: np.ndarray
    matrix: np.ndarray
    gamma: float
    error: float

    def lift(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the features replaced, in Arrow batches."""
        sample, matrix, gamma = self.sample, self.matrix, self.gamma

        @F.pandas_udf(ArrayType(DoubleType()))
        def lifted(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=object)
            return pd.Series(list(small_fits.kernel(np.stack(column.to_numpy()), sample, gamma) @ matrix))

        return rows.withColumn("features", lifted(F.col("features").cast("array<double>")))


@dataclass
class Kernelised:
    """A linear model on lifted features."""

    lifter: Nystroem
    fitted: Fitted

    @property
    def classes(self) -> int:
        return self.fitted.classes

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``raw``, ``proba`` and ``yhat``; the features stay as they came in."""
        kept = rows.withColumn("_given", F.col("features"))
        return self.fitted.predict(self.lifter.lift(kept)).withColumn("features", F.col("_given")).drop("_given")


def nystroem(train: DataFrame, landmarks: int = LANDMARKS) -> Nystroem:
    """Landmarks are the ``landmarks`` distinct rows that come first by hash; gamma is 1 / (features * variance of all values)."""
    value = lambda f: F.aggregate("features", F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    n, total, squares = train.agg(
        F.sum(F.size("features")), F.sum(value(lambda x: x)), F.sum(value(lambda x: x * x))
    ).first()
    dim = train.select(F.size("features")).first()[0]
    spread = dim * (squares / n - (total / n) ** 2)
    gamma = 1.0 / spread if spread > 0 else 1.0
    distinct = train.select(F.col("features").cast("array<double>").alias("features")).distinct()
    picked = distinct.orderBy(F.xxhash64("features"), "features").limit(2 * landmarks).collect()
    rows = np.array([r[0] for r in picked])
    sample, others = rows[:landmarks], rows[landmarks:]
    matrix = small_fits.kernel_lift(sample, gamma)
    error = 0.0
    if len(others):
        z = small_fits.kernel(others, sample, gamma) @ matrix
        error = float(np.abs(z @ z.T - small_fits.kernel(others, others, gamma)).mean())
    return Nystroem(sample, matrix, gamma, error)


def fit_mlp(train: DataFrame, hidden: int = 256, max_iter: int = 100, seed: int = 42) -> Fitted:
    """One hidden layer; with aligned modalities as features this is the stacked fusion."""
    classes = _n_classes(train)
    dim = train.select(F.size("features")).first()[0]
    estimator = MultilayerPerceptronClassifier(**COLUMNS, layers=[dim, hidden, classes], maxIter=max_iter, seed=seed)
    return Fitted(estimator.fit(weighted(train, False)), classes)


# fusion of scores


def long_scores(fitted: dict[str, Fitted], slices: dict[str, DataFrame]) -> DataFrame:
    """(modality, transcript_id, label, class, score) of one model per modality."""
    out = None
    for name in sorted(fitted):
        rows = fitted[name].predict(slices[name]).select(
            F.lit(name).alias("modality"), "transcript_id", "label", F.posexplode("raw").alias("class", "score")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def average_scores(scores: DataFrame) -> DataFrame:
    """Late fusion: mean score per example and class."""
    return scores.groupBy("transcript_id", "class").agg(F.avg("score").alias("score"))


def gate_scores(scores: DataFrame) -> DataFrame:
    """Gated fusion: modality scores weighted by the softmax of each modality's top score for the example."""
    top = scores.groupBy("transcript_id", "modality").agg(F.max("score").alias("_top"))
    high = top.groupBy("transcript_id").agg(F.max("_top").alias("_high"))
    raised = top.join(high, "transcript_id").withColumn("_e", F.exp(F.col("_top") - F.col("_high")))
    total = raised.groupBy("transcript_id").agg(F.sum("_e").alias("_total"))
    gates = raised.join(total, "transcript_id").select(
        "transcript_id", "modality", (F.col("_e") / F.col("_total")).alias("gate")
    )
    return (
        scores.join(gates, ["transcript_id", "modality"])
        .groupBy("transcript_id", "class")
        .agg(F.sum(F.col("gate") * F.col("score")).alias("score"))
    )


def pick_class(scores: DataFrame) -> DataFrame:
    """Class with the highest score per example, ties to the smallest class."""
    order = F.struct(F.round("score", 9).alias("s"), (-F.col("class")).alias("c"))
    return scores.groupBy("transcript_id").agg(F.max_by("class", order).alias("yhat"))


# experiment runs

ESTIMATORS = {
    "logistic": fit_logistic,
    "random_forest": fit_random_forest,
    "gradient_boost": fit_gradient_boost,
    "svm": fit_svm,
    "single": fit_mlp,
    "stacked": fit_mlp,
}


def run_experiment(data: dict[str, DataFrame], splits: DataFrame, config: dict, options: dict | None = None) -> DataFrame:
    """Train one configuration on its train split and answer val and test.

    ``config`` has target, combo, architecture and seed; ``data`` maps modalities to feature tables.
    """
    names = config["combo"].split("-")
    mine = splits.where((F.col("target") == config["target"]) & (F.col("seed") == config["seed"]))
    labelled = mine.select("transcript_id", "split", "label")
    fit_options = (options or {}).get(config["architecture"], {})

    def rows(modalities):
        # training passes over its input many times: join once, then read the written rows
        return cut_lineage(labelled.join(align_modalities(modalities), "transcript_id"))

    if config["architecture"] in ("late", "gated"):
        per_modality = {n: rows({n: data[n]}) for n in names}
        fitted = {n: fit_mlp(r.where("split = 'train'"), **fit_options) for n, r in per_modality.items()}
        scores = long_scores(fitted, {n: r.where("split <> 'train'") for n, r in per_modality.items()})
        fused = average_scores(scores) if config["architecture"] == "late" else gate_scores(scores)
        answers = pick_class(fused).join(labelled.where("split <> 'train'"), "transcript_id")
    else:
        table = rows({n: data[n] for n in names})
        fitted = ESTIMATORS[config["architecture"]](table.where("split = 'train'"), **fit_options)
        answers = fitted.predict(table.where("split <> 'train'"))
    return answers.select(
        *[F.lit(config[k]).alias(k) for k in ("target", "combo", "architecture", "seed")],
        "transcript_id",
        "split",
        F.col("label").cast("int").alias("y"),
        F.col("yhat").cast("int").alias("yhat"),
    )


def run_experiments(
    data: dict[str, DataFrame], splits: DataFrame, configs: list[dict], options: dict | None = None, parallelism: int = 4
) -> tuple[DataFrame | None, list[dict]]:
    """Predictions of all configurations that worked, and one error row per configuration that did not."""

    def attempt(config):
        try:
            # written here, so that a failure while scoring is this configuration's too
            return cut_lineage(run_experiment(data, splits, config, options)), None
        except Exception as error:  # one bad configuration must not end the sweep
            return None, {**config, "error": str(error)}

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        outcomes = list(pool.map(attempt, configs))
    predictions = None
    for table, _ in outcomes:
        if table is not None:
            predictions = table if predictions is None else predictions.unionByName(table)
    return predictions, [error for _, error in outcomes if error]


def run_grid(
    data: dict[str, DataFrame], splits: DataFrame, grid: DataFrame, seeds: list[int], path: str, options: dict | None = None,
    group_cells: int = grouped_fits.GROUP_CELLS, parallelism: int = 4,
) -> DataFrame:
    """The pending part of an experiment grid: small configurations as grouped fits, larger ones as distributed ones."""
    large = lambda configs: run_experiments(data, splits, configs, parallelism=parallelism)
    return grouped_fits.run_grid(data, splits, grid, seeds, path, options, group_cells, distributed=large)


# importance


def permutation_importance(fitted: Fitted, rows: DataFrame, names: list[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance, std): drop of macro-F1 when a feature takes the values of another row.

    Each repeat pairs the rows with a hash-ordered permutation of themselves; every feature is then replaced in
    turn and all copies are scored in one pass.
    """
    seeded = rows.select("transcript_id", "features", "label", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    order = lambda side: hash_order(F.concat_ws("-", F.lit(str(seed)), F.lit(side), F.col("repeat").cast("string")), "transcript_id")
    keyed = seeded.withColumns({"_own": order("own"), "_from": order("from")})
    own = rank_by_hash(keyed, ["repeat"], "_own", "_place", tie="transcript_id")
    donor = rank_by_hash(keyed, ["repeat"], "_from", "_place", tie="transcript_id")
    donor = donor.select("repeat", "_place", F.col("features").alias("_donor"))
    paired = own.join(donor, ["repeat", "_place"]).select("transcript_id", "repeat", "features", "_donor", "label")
    tried = paired.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j"))
    swapped = F.transform("features", lambda x, i: F.when(i == F.col("j"), F.get("_donor", F.col("j"))).otherwise(x))
    scored = fitted.predict(tried.select("repeat", "j", F.col("label").alias("y"), swapped.alias("features")))
    permuted = macro_f1(scored, ["j", "repeat"])
    base = macro_f1(fitted.predict(rows.select("features", F.col("label").alias("y"))).withColumn("_k", F.lit(1)), ["_k"])
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return (
        permuted.withColumn("_k", F.lit(1))
        .join(base.withColumnRenamed("macro_f1", "_base"), "_k")
        .groupBy("j")
        .agg(F.avg(F.col("_base") - F.col("macro_f1")).alias("importance"), F.stddev_pop("macro_f1").alias("std"))
        .select(label.alias("feature"), "importance", "std")
    )


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


# probes on graph arms


def probe(features: DataFrame, splits: DataFrame, target: str, seeds: list[int], parallelism: int = 4) -> DataFrame:
    """Test answers of the balanced logistic probe for every seed: (target, seed, transcript_id, split, y, yhat)."""
    configs = [{"target": target, "combo": "arm", "architecture": "logistic", "seed": s} for s in seeds]
    answers, errors = run_experiments({"arm": features}, splits, configs, parallelism=parallelism)
    if errors:
        raise RuntimeError(f"probe failed: {errors[0]['error']}")
    return answers.where("split = 'test'").drop("combo", "architecture")


def arm_reports(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores per arm and seed, mean F1 per arm and class) of long answers with column ``arm``."""
    keys = ["target", "arm", "seed"]
    per_class = class_report(answers, keys).groupBy("target", "arm", "label").agg(F.avg("f1").alias("f1"))
    return macro_f1(answers, keys), per_class
