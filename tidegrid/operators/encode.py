"""A hook for text encoders that users bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


def encode_texts(df: DataFrame, text: str, out: str, encoder: Callable[[list[str]], Sequence[Sequence[float]]], size: int = 256) -> DataFrame:
    """df with the encoder's vector of each text in column out, `size` texts at a time; null texts have a null vector.

    The encoder is sent to the executors; what it loads, it should load on first use. A column named out gives way.
    """
    kept = [f for f in df.schema.fields if f.name != out]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = [None] * len(part)
            there = [k for k, t in enumerate(part[text]) if isinstance(t, str)]
            for at in range(0, len(there), size):
                some = there[at : at + size]
                for k, v in zip(some, encoder([part[text].iloc[j] for j in some])):
                    vectors[k] = [float(x) for x in v]
            yield part.assign(**{out: pd.Series(vectors, index=part.index, dtype=object)})

    return df.select(*(f.name for f in kept)).mapInPandas(run, StructType([*kept, StructField(out, ArrayType(FloatType()))]))
