"""Exact medians for missing values, and scaling by mean and population deviation.

Both are Estimators with Models of their own. Medians interpolate between the two middle
values and come from counts of equal values over ordered slices, so no column's values meet
in one task; a column without a value has no median and is left out of the output.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.operators.skew import exact_quantiles


def _present(name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "numeric columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column, or suffix of the filled columns",
                      TypeConverters.toString)

    def _get(self, name):
        return self.getOrDefault(getattr(self, name))


class _Fitted(Model, _Columns, MLReadable, MLWritable):
    """A model that is a few numbers for each column, kept as rows."""

    fields: tuple[str, ...] = ()

    def __init__(self, rows: dict[str, tuple[float, ...]] | None = None):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="")
        self.rows = dict(rows or {})

    def fitted(self) -> DataFrame:
        """One row a column: feature and the fitted values."""
        schema = "feature string, " + ", ".join(f"{f} double" for f in self.fields)
        return SparkSession.active().createDataFrame([(c, *v) for c, v in self.rows.items()], schema)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: _Fitted):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted().coalesce(1).write.parquet(f"{path}/values")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _Fitted:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/values").collect()
        model = self.cls({r["feature"]: tuple(r[f] for f in self.cls.fields) for r in rows})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values with the column's median, into columns with the suffix `outputCol`."""

    @keyword_only
    def __init__(self, *, inputCols=(), outputCol="__filled"):
        super().__init__()
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})
        self._setDefault(inputCols=[], outputCol="__filled")

    def _fit(self, df: DataFrame) -> "MedianImputerModel":
        names = self._get("inputCols")
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), _present(c).alias("value")) for c in names])
        long = df.select(F.explode(cells).alias("c")).select("c.feature", "c.value")
        found = {r["feature"]: (r["median"],) for r in exact_quantiles(long, ["feature"], "value", {"median": 0.5}).collect()}
        return self._copyValues(MedianImputerModel({c: found[c] for c in names if c in found}))


class MedianImputerModel(_Fitted):
    fields = ("median",)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"{c}{self._get('outputCol')}": F.coalesce(_present(c), F.lit(m)) for c, (m,) in self.rows.items()})

    def outputs(self) -> list[str]:
        return [f"{c}{self._get('outputCol')}" for c in self.rows]


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation as one vector; a column without spread is only centred."""

    @keyword_only
    def __init__(self, *, inputCols=(), outputCol="features"):
        super().__init__()
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})
        self._setDefault(inputCols=[], outputCol="features")

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        names = self._get("inputCols")
        row = df.agg(*[f(_present(c)).alias(f"{k}_{i}") for i, c in enumerate(names)
                       for k, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
        return self._copyValues(PopulationScalerModel({
            c: (row[f"mean_{i}"], row[f"std_{i}"]) for i, c in enumerate(names) if row[f"mean_{i}"] is not None}))


class PopulationScalerModel(_Fitted):
    fields = ("mean", "std")

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = [(_present(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.rows.items()]
        return df.withColumn(self._get("outputCol"), array_to_vector(F.array(*scaled)))


def fitted_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, mean, std) of the columns: medians of what is present, mean and
    population deviation once the medians stand in for what is missing."""
    imputer = MedianImputer(inputCols=columns).fit(df)
    scaler = PopulationScaler(inputCols=imputer.outputs()).fit(imputer.transform(df))
    suffix = F.length(F.lit(imputer._get("outputCol")))
    plain = F.substring(F.col("feature"), F.lit(1), F.length("feature") - suffix)
    return imputer.fitted().join(scaler.fitted().withColumn("feature", plain), "feature")
