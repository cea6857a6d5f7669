"""Text vectors without an external model: hashed word counts, scaled to length 1."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_text(df: DataFrame, text: str, target: str = "embedding", dimensions: int = 256) -> DataFrame:
    """Add a unit vector per text; a text without words gets the zero vector."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+", minTokenLength=1)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)  # leaves a zero vector as it is
    out = unit.transform(counts.transform(words.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))))
    return out.withColumn(target, vector_to_array("_unit")).drop("_text", "_words", "_tf", "_unit")
