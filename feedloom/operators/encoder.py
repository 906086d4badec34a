"""Text encoders: an offline TF-IDF default, or any model given by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 384


@dataclass
class TextEncoder:
    """A fitted encoder; the same model encodes corpus and questions."""

    model: PipelineModel
    text: str

    def encode(self, df: DataFrame, out: str = "vector") -> DataFrame:
        encoded = self.model.transform(df.withColumn("__text", F.coalesce(self.text, F.lit(""))))
        array = vector_to_array("__unit")
        return encoded.select(*df.columns, array.alias(out))


def fit_encoder(df: DataFrame, text: str = "text", dim: int = DIMENSION) -> TextEncoder:
    """Hashed term frequencies weighted by rarity, scaled to unit length."""
    stages = Pipeline(
        stages=[
            Tokenizer(inputCol="__text", outputCol="__tokens"),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dim),
            IDF(inputCol="__tf", outputCol="__tfidf"),
            Normalizer(inputCol="__tfidf", outputCol="__unit"),
        ]
    )
    return TextEncoder(stages.fit(df.withColumn("__text", F.coalesce(text, F.lit("")))), text)


def encode_with(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    out: str = "vector",
) -> DataFrame:
    """Encode with a user model; ``load`` runs once per task and returns texts -> matrix."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            matrix = np.asarray(model(batch.fillna("").tolist()), dtype=np.float64)
            yield pd.Series(list(matrix))

    return df.withColumn(out, run(F.col(text)))
