"""Training, cross-validating, comparing and applying classifiers.

A classifier is two fitted parts: the interval forest, fitted on the intervals of the
training channels only, and a Spark ML pipeline over the feature columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals import constants as C
from channel_signals.operators import metrics as M
from channel_signals.operators import prep as P
from channel_signals.operators.class_forest import DeepForest
from channel_signals.operators.iforest import IntervalForest, IntervalForestModel
from channel_signals.operators.gradient import KernelSVC, TaskPerceptron
from channel_signals.operators.kernel import RandomFourierFeatures
from channel_signals.operators.scaling import MedianImputer, PopulationScaler
from channel_signals.session import in_parallel, materialize


def _as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def tagged_intervals(intervals: DataFrame, channels: DataFrame, key: str = "channel_id") -> DataFrame:
    """The intervals of the given channels, beside the channel's other columns (its fold, say),
    written once: fits and scores then read their share of this table."""
    named = channels.withColumnRenamed(key, "channel_id") if key != "channel_id" else channels
    return materialize(intervals.select("channel_id", "seq", "days").join(named, "channel_id"))


def random_forest(trees: int = C.RF_TREES, depth: int = C.RF_DEPTH, balanced: bool = True,
                  seed: int = C.SEED) -> RandomForestClassifier:
    rf = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, maxBins=128, featuresCol="features",
        labelCol="label", maxMemoryInMB=512)
    return rf.setWeightCol("weight") if balanced else rf


@dataclass
class _Prepared:
    """What classifiers of the same rows share: columns, interval forest, imputer and scaler, the rows."""

    columns: list[str]
    forest: IntervalForestModel | None
    scaling: list
    rows: DataFrame

    def _fit_stages(self, stages: list | None = None) -> "ChannelClassifier":
        scaled = PipelineModel(self.scaling).transform(self.rows)
        rest = Pipeline(stages=stages or [random_forest()]).fit(scaled)
        return ChannelClassifier(self.columns, self.forest, PipelineModel([*self.scaling, *rest.stages]))


@dataclass
class ChannelClassifier:
    """Anomaly score, imputation, scaling and a random forest, fitted together."""

    columns: list[str]
    forest: IntervalForestModel | None
    model: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], intervals: DataFrame | None = None,
            stages: list | None = None, key: str = "channel_id") -> "ChannelClassifier":
        """`stages` end in a classifier over the vector column `features`. The forest sees the
        intervals of the channels in `df` alone."""
        if C.ANOMALY_COLUMN in columns:
            intervals = tagged_intervals(intervals, df.select(key), key)
        return cls._fit_on(df, columns, intervals, stages)

    @classmethod
    def _fit_on(cls, df: DataFrame, columns: list[str], theirs: DataFrame | None,
                stages: list | None = None) -> "ChannelClassifier":
        """Like `fit`; `theirs` is a stored table of just the intervals of `df`'s channels."""
        return cls._prepared(df, columns, theirs)._fit_stages(stages)

    @classmethod
    def _prepared(cls, df: DataFrame, columns: list[str], theirs: DataFrame | None) -> "_Prepared":
        """All that is fitted before the stages, once for any number of them."""
        forest = None
        if C.ANOMALY_COLUMN in columns:
            forest = IntervalForest().fit(theirs)
            df = forest.score_channels(df, theirs)
        ready = P.with_class_weight(_as_double(P.sentinel_to_null(df), columns))
        # the trees read their input once per level: cut the feature plan off first
        ready = materialize(ready.select("label", "weight", *columns))
        # columns without a value have no median and say nothing
        imputer = MedianImputer(inputCols=columns).fit(ready)
        filled = imputer.transform(ready)
        return _Prepared(list(imputer.rows), forest, [imputer, PopulationScaler(inputCols=imputer.outputs()).fit(filled)], ready)

    def predict(self, df: DataFrame, intervals: DataFrame | None = None, key: str = "channel_id") -> DataFrame:
        """`df` with p1 and prediction (p1 >= 0.5). Only intervals of its channels are scored."""
        if self.forest is not None:
            intervals = intervals.join(df.select(F.col(key).alias("channel_id")), "channel_id", "left_semi")
        return self._predict_on(df, intervals)

    def _predict_on(self, df: DataFrame, theirs: DataFrame | None) -> DataFrame:
        kept = df.columns
        if self.forest is not None:
            df = self.forest.score_channels(df, theirs)
        inputs = _as_double(P.sentinel_to_null(df), self.columns)
        out = self.model.transform(inputs)
        if "probability" in out.columns:
            p1 = vector_to_array("probability")[1]
        else:
            # a margin classifier: its decision, as a score that crosses 0.5 at margin 0
            p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
        scored = out.withColumn("p1", p1).withColumn("prediction", M.hard_decision(F.col("p1")))
        extra = [C.ANOMALY_COLUMN] if self.forest is not None and C.ANOMALY_COLUMN not in kept else []
        return scored.select(*kept, *extra, "p1", "prediction")

    def importances(self) -> DataFrame:
        """(feature, importance), the most important first."""
        rf = self.model.stages[-1]
        spark = SparkSession.active()
        rows = [(c, float(v)) for c, v in zip(self.columns, rf.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        """A folder with the pipeline, the forest and the ordered feature list."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        if self.forest is not None:
            self.forest.write().overwrite().save(f"{path}/forest")
        spark = SparkSession.active()
        spark.createDataFrame(
            [(i, c, self.forest is not None) for i, c in enumerate(self.columns)],
            "i int, feature string, has_forest boolean",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/feature_cols")

    @classmethod
    def load(cls, path: str) -> "ChannelClassifier":
        rows = SparkSession.active().read.parquet(f"{path}/feature_cols").orderBy("i").collect()
        forest = IntervalForestModel.load(f"{path}/forest") if rows[0]["has_forest"] else None
        return cls([r["feature"] for r in rows], forest, PipelineModel.load(f"{path}/pipeline"))


def _dealt(train: DataFrame, intervals: DataFrame | None, columns: list[str], key: str, folds: int,
           others: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The training rows with their fold, and one stored table of their intervals by fold.

    Channels of `others` come without a fold."""
    dealt = materialize(P.stratified_folds(train, key, folds=folds))
    if C.ANOMALY_COLUMN not in columns:
        return dealt, None
    tags = dealt.select(key, "fold")
    if others is not None:
        tags = tags.unionByName(others.select(key, F.lit(None).cast("int").alias("fold")))
    return dealt, tagged_intervals(intervals, tags, key)


def _where(tagged: DataFrame | None, condition: Column) -> DataFrame | None:
    return None if tagged is None else tagged.where(condition).drop("fold")


def _fold_predictions(dealt: DataFrame, tagged: DataFrame | None, columns: list[str], stages: list | None,
                      k: int) -> DataFrame:
    """Predictions of fold k by a classifier that has seen the other folds alone."""
    inside = F.col("fold") == k
    fitted = ChannelClassifier._fit_on(dealt.where(~inside), columns, _where(tagged, ~inside), stages)
    return materialize(fitted._predict_on(dealt.where(inside), _where(tagged, inside)))


def cross_validate(train: DataFrame, columns: list[str], intervals: DataFrame | None = None,
                   stages: list | None = None, key: str = "channel_id", folds: int = C.FOLDS,
                   threads: int = C.FOLDS) -> DataFrame:
    """Out-of-fold predictions with their `fold`. Everything fitted, the interval forest
    included, sees only the other folds. Intervals are written once with the fold of their
    channel, and the folds are fitted at the same time."""
    dealt, tagged = _dealt(train, intervals, columns, key, folds)
    parts = in_parallel(train.sparkSession, [
        partial(_fold_predictions, dealt, tagged, columns, stages, k) for k in range(folds)], threads)
    return reduce(DataFrame.unionByName, parts)


@dataclass
class TrainingResult:
    classifier: ChannelClassifier
    metrics: DataFrame
    test: DataFrame
    cv: DataFrame


def train(df: DataFrame, columns: list[str], intervals: DataFrame | None = None,
          stages: list | None = None, key: str = "channel_id", folds: int = C.FOLDS,
          sparse: list[str] = (C.VELOCITY_RATIO,), sparse_at: float = 0.9, threads: int = C.FOLDS + 1) -> TrainingResult:
    """Split, cross-validate on the training part, refit on it, evaluate on the test part.

    `metrics` is one row: cv_* and test_* and the health flags. Columns of `sparse` that are
    missing in more than `sparse_at` of the genuine rows are left out of the model. All fits
    read one stored table of intervals, tagged with folds.
    """
    columns = P.drop_sparse(df, columns, list(sparse), sparse_at)
    split = materialize(P.stratified_split(df, key))
    train_rows = split.where(~F.col("is_test")).drop("is_test")
    test_rows = split.where("is_test").drop("is_test")
    dealt, tagged = _dealt(train_rows, intervals, columns, key, folds, test_rows)
    trained, tested = (None, None) if tagged is None else (
        tagged.where("fold is not null").drop("fold"), tagged.where("fold is null").drop("fold"))
    fits = [partial(_fold_predictions, dealt, tagged, columns, stages, k) for k in range(folds)]
    fits.append(partial(ChannelClassifier._fit_on, dealt.drop("fold"), columns, trained, stages))
    *parts, fitted = in_parallel(df.sparkSession, fits, threads)
    cv = reduce(DataFrame.unionByName, parts)
    test = materialize(fitted._predict_on(test_rows, tested))
    t = M.binary_metrics(test).select(
        *[F.col(m).alias(f"test_{m}") for m in ("accuracy", "precision", "recall", "f1")],
        *[F.col(m) for m in ("tn", "fp", "fn", "tp")])
    a = M.roc_auc(test).select(F.col("roc_auc").alias("test_roc_auc"))
    row = M.health_flags(M.one_row(t, a, M.cv_summary(cv)))
    return TrainingResult(fitted, row, test, cv)


def comparison_models(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The four models compared, each as pipeline stages after imputing and scaling."""
    n = df.count()
    d = len(columns)
    kernel = RandomFourierFeatures(inputCol="features", outputCol="kernel", numFeatures=256,
                                   gamma=1.0 / d, seed=C.SEED)
    return {
        # a unit penalty on a summed loss is 1/n on a mean loss
        "Logistic Regression": [LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1))],
        "SVM (RBF)": [kernel, KernelSVC(kernel, maxIter=100, regParam=1.0 / max(n, 1))],
        "Random Forest": [DeepForest(numTrees=100, maxDepth=30)],
        "MLP": [TaskPerceptron(layers=[d, 100, 2], maxIter=2000, tol=1e-4, seed=C.SEED)],
    }


def model_predictions(df: DataFrame, columns: list[str] = C.ALL_FEATURES, key: str = "channel_id",
                      models=None, folds: int = C.FOLDS, threads: int = 8) -> DataFrame:
    """Out-of-fold predictions (with `fold`) and test predictions (without) of every model, as
    (Model, key, label, fold, p1, prediction). Rows are dealt once, and the fits of all models
    and folds run at the same time; what they learn before their stages is fitted once a fold."""
    split = materialize(P.stratified_split(df, key))
    train_rows = split.where(~F.col("is_test")).drop("is_test")
    test_rows = split.where("is_test").drop("is_test")
    dealt, _ = _dealt(train_rows, None, columns, key, folds)

    fold = F.col("fold")
    # rows to learn from, rows to judge: every fold, then the test
    rounds = [(dealt.where(fold != k), dealt.where(fold == k)) for k in range(folds)]
    rounds.append((dealt.drop("fold"), test_rows.withColumn("fold", F.lit(None).cast("int"))))
    ready = in_parallel(df.sparkSession, [partial(ChannelClassifier._prepared, inside, columns, None) for inside, _ in rounds], threads)

    def judged(stages: list, prepared: _Prepared, held: DataFrame) -> DataFrame:
        return materialize(prepared._fit_stages(stages)._predict_on(held, None))

    jobs, names = [], []
    for name, stages in (models or comparison_models(train_rows, columns)).items():
        jobs += [partial(judged, stages, prepared, held) for prepared, (_, held) in zip(ready, rounds)]
        names += [name] * len(rounds)
    parts = in_parallel(df.sparkSession, jobs, threads)
    return reduce(DataFrame.unionByName, [
        p.select(F.lit(n).alias("Model"), key, "label", "fold", "p1", "prediction") for n, p in zip(names, parts)])


def comparison(pred: DataFrame) -> DataFrame:
    """(Model, Accuracy, Precision, Recall, F1, CV F1 Mean, CV F1 Std), rounded to four places,
    the best F1 first, from predictions of all models."""
    cv = M.binary_metrics(pred.where("fold is not null"), ["Model", "fold"]).groupBy("Model").agg(
        F.avg("f1").alias("CV F1 Mean"), F.stddev_pop("f1").alias("CV F1 Std"))
    test = M.binary_metrics(pred.where("fold is null"), ["Model"])
    return test.join(cv, "Model", "left").select(
        "Model", *[F.round(c.lower(), 4).alias(c) for c in ("Accuracy", "Precision", "Recall", "F1")],
        *[F.round(c, 4).alias(c) for c in ("CV F1 Mean", "CV F1 Std")]).orderBy(F.desc("F1"), "Model")


def compare_models(df: DataFrame, columns: list[str] = C.ALL_FEATURES,
                   key: str = "channel_id", models=None, folds: int = C.FOLDS) -> DataFrame:
    """The leaderboard of `comparison` for four models, or the given ones."""
    return comparison(model_predictions(df, columns, key, models, folds))


def best_model(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.desc("F1"), "Model").limit(1)


def notebook_forest(df: DataFrame, key: str = "channel_id"):
    """The exploratory forest over every numeric column but the key: (classifier, test predictions)."""
    columns = [c for c in P.numeric_columns(df) if c != key]
    split = materialize(P.stratified_split(df, key))
    fitted = ChannelClassifier.fit(
        split.where(~F.col("is_test")), columns, None, [DeepForest(numTrees=C.NOTEBOOK_TREES, maxDepth=30, weightCol="weight")], key)
    return fitted, fitted.predict(split.where("is_test").drop("is_test"))


def error_frame(pred: DataFrame) -> DataFrame:
    """Predictions with names for both labels and the type of error."""
    return pred.withColumns({
        "true_name": P.decode_label(F.col("label")),
        "pred_name": P.decode_label(F.col("prediction")),
        "error_type": M.error_type(F.col("label"), F.col("prediction")),
    })
