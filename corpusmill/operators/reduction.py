"""Standard scaling and principal components, as distributed fits."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_VARIANCE = 0.75


def _fit(vectors: DataFrame, n_components: int):
    data = vectors.withColumn("_x", array_to_vector(F.col("embedding").cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_z").fit(data)
    scaled = scaler.transform(data)
    return scaled, PCA(k=n_components, inputCol="_z", outputCol="_p").fit(scaled)


def explained_variance(vectors: DataFrame, n_components: int) -> DataFrame:
    """(component, ratio, cumulated) of the variance the first components keep."""
    _, model = _fit(vectors, n_components)
    ratios = [float(r) for r in model.explainedVariance]
    rows, total = [], 0.0
    for i, ratio in enumerate(ratios, start=1):
        total += ratio
        rows.append((i, round(ratio, 6), round(total, 6)))
    return vectors.sparkSession.createDataFrame(rows, "component int, ratio double, cumulated double")


def reduce_dimensions(vectors: DataFrame, n_components: int) -> DataFrame:
    """Scaled and projected vectors, or the vectors as they are when too much would be lost."""
    scaled, model = _fit(vectors, n_components)
    if float(sum(model.explainedVariance)) < MIN_VARIANCE:
        return vectors
    kept = [c for c in vectors.columns if c != "embedding"]
    return model.transform(scaled).select(*kept, vector_to_array("_p").alias("embedding"))
