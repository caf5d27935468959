"""Random Fourier features for the RBF kernel (Rahimi & Recht, 2007)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.constants import SEED
from channel_signals.functions.gradients import projection


class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Vector to vector: sqrt(2/D) cos(Wx + b) with W ~ N(0, 2 gamma), b ~ U(0, 2 pi), so
    that inner products approximate exp(-gamma |x - y|^2). The seed alone fixes W and b."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "output size", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel", numFeatures=256, gamma=1.0,
                 seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel", numFeatures=256, gamma=1.0,
                         seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.numFeatures, self.gamma, self.seed))

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()) if len(rows) else np.empty((0, 1))
            w, b = projection(x.shape[1], size, gamma, seed)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(x @ w + b)))

        source = vector_to_array(self.getOrDefault(self.inputCol))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(source)))
