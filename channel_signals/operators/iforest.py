"""Isolation forest over one numeric column (Liu, Ting & Zhou, 2008), as an Estimator.

In one dimension a tree is a step function, and so is the forest. Fitting draws a sample
for every tree, grows the trees in tasks, and adds their steps up to one table of at most
trees x sample breakpoints. Scoring is a binary search in that table, on the JVM.

Every draw is a hash. A row has one digest of the seed and its key, cut into two numbers
(u, v); its rank for tree t is (u + t v) modulo a prime, and a tree takes the rows of lowest
rank. A node cuts at a share of its range that the seed, the tree and the node decide. So a
forest is a pure function of its rows and the seed, whatever their order and partitions.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.constants import (
    FOREST_CONTAMINATION, FOREST_SAMPLE, FOREST_TREES, SEED,
)
from channel_signals.functions.trees import expected_path, fraction, tree_steps
from channel_signals.session import materialize

MIN_RAW_INTERVALS = 10
#: Ranks of rows are numbers below this prime; the digits they come from are just as many.
RANK_PRIME = 281_474_976_710_597


class _ForestParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "numeric or array<double> column",
                     TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "score column", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row",
                    TypeConverters.toListString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    sampleSize = Param(Params._dummy(), "sampleSize", "values per tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share taken as outliers",
                          TypeConverters.toFloat)
    mode = Param(Params._dummy(), "mode", "'decision' or 'raw'", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def _defaults(self):
        self._setDefault(
            inputCol="days", outputCol="if_anomaly_score", keyCols=["channel_id", "seq"],
            numTrees=FOREST_TREES, sampleSize=FOREST_SAMPLE,
            contamination=FOREST_CONTAMINATION, mode="decision", seed=SEED)

    def _get(self, name):
        return self.getOrDefault(getattr(self, name))


class IntervalForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on a long table with one value per row, or on an array column."""

    @keyword_only
    def __init__(self, *, inputCol="days", outputCol="if_anomaly_score",
                 keyCols=("channel_id", "seq"), numTrees=FOREST_TREES,
                 sampleSize=FOREST_SAMPLE, contamination=FOREST_CONTAMINATION,
                 mode="decision", seed=SEED):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _values(self, df: DataFrame) -> DataFrame:
        """(value, row) of either input form; `row` is the text of the row's key."""
        name = self._get("inputCol")
        keys = [F.col(k) for k in self._get("keyCols") if k in df.columns and k != name]
        if not keys:
            raise ValueError(f"the sample needs a column that tells rows apart: {self._get('keyCols')}")
        if dict(df.dtypes)[name].startswith("array"):
            out = df.select(*[k.cast("string") for k in keys], F.posexplode(name).alias("_i", "value"))
            keys = [*keys, F.col("_i")]
        else:
            out = df.withColumn("value", F.col(name))
        row = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
        return out.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
            F.col("value").cast("double").alias("value"), row.alias("row"))

    def _sample(self, values: DataFrame, n: int) -> DataFrame:
        """(tree, value): the sampleSize rows of lowest rank for each tree.

        A row is only explored for the trees whose rank is low enough to be among about
        sampleSize of `n`; where a tree finds too few, the bound is doubled.
        """
        trees, size = self._get("numTrees"), min(self._get("sampleSize"), n)
        digest = F.md5(F.concat_ws(":", F.lit(str(self._get("seed"))), "row"))

        def number(at: int) -> Column:
            return F.conv(F.substring("h", at, 12), 16, 10).cast("long")

        hashed = values.select("value", digest.alias("h")).select("value", "h", number(1).alias("u"), number(13).alias("v"))
        bound = (size + 8 * math.sqrt(size) + 16) / n
        order = Window.partitionBy("tree").orderBy("rank", "h", "value")
        while True:
            below = F.lit(RANK_PRIME if bound >= 1 else int(bound * RANK_PRIME))
            low = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
                t.alias("tree"), ((F.col("u") + t.cast("long") * F.col("v")) % RANK_PRIME).alias("rank")))
            picked = hashed.select("value", "h", F.explode(F.filter(low, lambda r: r.rank < below)).alias("r")).select(
                "value", "h", "r.tree", "r.rank")
            sample = materialize(picked.withColumn("_at", F.row_number().over(order)).where(
                F.col("_at") <= size).select("tree", "value"))
            if bound >= 1 or sample.count() == trees * size:
                return sample
            bound *= 2

    def _fit(self, df: DataFrame) -> "IntervalForestModel":
        """Reads `df` three times, for its size, its samples and its offset: hand over a table."""
        values = self._values(df)
        n = values.count()
        empty = n == 0 or (self._get("mode") == "raw" and n < MIN_RAW_INTERVALS)
        if empty:
            return self._copyValues(IntervalForestModel([-math.inf, math.inf], [0.0], 0.0, True))
        splits, scores = self._grow(self._sample(values, n), min(self._get("sampleSize"), n))
        model = IntervalForestModel(splits, scores, 0.0, False)
        if self._get("mode") == "decision":
            model.offset = self._offset(model._bucketed(values, "value"), scores, n)
        return self._copyValues(model)

    def _grow(self, sample: DataFrame, size: int):
        trees, seed = self._get("numTrees"), self._get("seed")
        limit = math.ceil(math.log2(max(size, 2)))

        def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            values = np.sort(rows["value"].to_numpy())
            edge, delta = tree_steps(values, lambda node: fraction(seed, key[0], node), limit)
            return pd.DataFrame({"edge": edge, "delta": delta})

        # a tree is a group of at most sampleSize rows
        steps = sample.groupBy("tree").applyInPandas(grow, "edge double, delta double")
        # at most trees x sample distinct edges
        path = F.sum("delta").over(Window.partitionBy(F.lit(0)).orderBy("edge").rowsBetween(
            Window.unboundedPreceding, Window.currentRow))
        table = (
            steps.groupBy("edge").agg(F.sum("delta").alias("delta"))
            .select("edge", path.alias("path")).orderBy("edge").collect()
        )
        # sums of floats differ in the last digits with the order of the tasks
        norm = trees * max(expected_path(size), 1e-12)
        scores = [round(2.0 ** (-r["path"] / norm), 12) for r in table]
        return [r["edge"] for r in table] + [math.inf], scores

    def _offset(self, bucketed: DataFrame, scores: list[float], n: int) -> float:
        """The contamination percentile of -score over the training values, exact: equal
        buckets have equal scores, so counts per bucket are enough."""
        counts = bucketed.groupBy("_bucket").count().collect()
        pairs = sorted((-scores[int(r["_bucket"])], r["count"]) for r in counts)
        place = self._get("contamination") * (n - 1)

        def at(i: int) -> float:
            seen = 0
            for score, c in pairs:
                seen += c
                if seen > i:
                    return score
            return pairs[-1][0]

        lo, hi = at(math.floor(place)), at(math.ceil(place))
        return lo + (hi - lo) * (place - math.floor(place))


class IntervalForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Step function of the forest: score i holds from splits[i] up to splits[i+1]."""

    def __init__(self, splits=(), scores=(), offset=0.0, empty=True):
        super().__init__()
        self._defaults()
        self.splits = [float(s) for s in splits]
        self.scores = [float(s) for s in scores]
        self.offset = float(offset)
        self.empty = bool(empty)

    def _bucketed(self, df: DataFrame, col: str) -> DataFrame:
        if len(self.splits) < 3:
            return df.withColumn("_bucket", F.lit(0.0))
        return Bucketizer(
            splits=self.splits, inputCol=col, outputCol="_bucket", handleInvalid="keep",
        ).transform(df)

    @property
    def _shift(self) -> float:
        return self.offset + 0.5 if self._get("mode") == "decision" else 0.0

    @property
    def _without(self) -> float:
        """Score of a channel that has no intervals."""
        return 0.5 if self._get("mode") == "decision" else 0.0

    def _transform(self, df: DataFrame) -> DataFrame:
        """Add the score: per row for a numeric column, the mean for an array column."""
        name, out = self._get("inputCol"), self._get("outputCol")
        if dict(df.dtypes)[name].startswith("array"):
            return df.withColumn(out, self._array_score()(F.col(name)))
        if self.empty:
            return df.withColumn(out, F.lit(self._without))
        # a row per step of the forest: at most trees x sample of them
        table = df.sparkSession.createDataFrame(pd.DataFrame({
            "_bucket": np.arange(len(self.scores), dtype=float),
            out: np.array(self.scores) + self._shift}))
        return self._bucketed(df, name).join(F.broadcast(table), "_bucket", "left").drop("_bucket")

    def _array_score(self):
        splits = np.array(self.splits[1:-1])
        scores = np.array(self.scores) + self._shift
        without, empty = self._without, self.empty

        @F.pandas_udf("double")
        def score(cells: pd.Series) -> pd.Series:
            out = np.full(len(cells), without)
            size = cells.str.len().fillna(0).to_numpy(dtype=np.int64)
            if not empty and size.any():
                flat = scores[np.searchsorted(splits, np.concatenate(
                    cells[size > 0].to_list()).astype(float), side="right")]
                starts = np.concatenate([[0], np.cumsum(size[size > 0])[:-1]])
                out[size > 0] = np.add.reduceat(flat, starts) / size[size > 0]
            return pd.Series(out)

        return score

    def channel_scores(self, intervals: DataFrame) -> DataFrame:
        """(channel_id, score): mean over a channel's intervals."""
        out = self._get("outputCol")
        return self.transform(intervals).groupBy("channel_id").agg(F.avg(out).alias(out))

    def score_channels(self, channels: DataFrame, intervals: DataFrame) -> DataFrame:
        """Add the score to channels; channels without intervals get the neutral score."""
        out = self._get("outputCol")
        return channels.drop(out).join(self.channel_scores(intervals), "channel_id", "left").withColumn(
            out, F.coalesce(out, F.lit(self._without)))

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: IntervalForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        extra = {"offset": m.offset, "empty": m.empty}
        DefaultParamsWriter.saveMetadata(
            m, path, self.sparkSession, extraMetadata={"forest": json.dumps(extra)})
        rows = list(zip(m.splits[:-1], m.splits[1:], m.scores))
        self.sparkSession.createDataFrame(rows, "lo double, hi double, score double").coalesce(
            1).write.parquet(f"{path}/segments")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IntervalForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        extra = json.loads(metadata["forest"])
        rows = self.sparkSession.read.parquet(f"{path}/segments").orderBy("lo").collect()
        model = self.cls(
            [r["lo"] for r in rows] + [rows[-1]["hi"]], [r["score"] for r in rows],
            extra["offset"], extra["empty"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
