"""Linear models as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import scaled, sigmoid, weighted_sum
from palletry.sources.io import require_columns


@dataclass(frozen=True)
class LinearModel:
    """A linear model over min-max scaled features: (name, low, high, weight) each, and an intercept."""

    features: tuple[tuple[str, float, float, float], ...]
    intercept: float

    @classmethod
    def from_table(cls, model: DataFrame) -> LinearModel:
        """From rows (nth, feature, low, high, weight, intercept): one a feature, so they fit the driver."""
        rows = model.orderBy("nth").collect()
        return cls(tuple((r.feature, r.low, r.high, r.weight) for r in rows), rows[0].intercept if rows else 0.0)

    def decision(self) -> Column:
        return weighted_sum(((w, scaled(F.col(f).cast("double"), F.lit(float(lo)), F.lit(float(hi)))) for f, lo, hi, w in self.features), self.intercept)

    def scored(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        """`df` with decision, prob (rounded where `digits` are given, else exact to the last bit) and pred (prob >= 0.5)."""
        require_columns(df, [f for f, *_ in self.features])
        d = df.withColumn("decision", self.decision())
        prob = sigmoid(F.col("decision"), exact=digits is None)
        return d.withColumn("prob", prob if digits is None else F.round(prob, digits)).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))

    def ranked_coefficients(self, df: DataFrame, k: int) -> DataFrame:
        """(rank, feature, weight) of the k largest absolute weights, ties in model order."""
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(f).alias("feature"), F.lit(float(w)).alias("weight")) for i, (f, _, _, w) in enumerate(self.features)]))
        t = df.sparkSession.range(1).select(rows.alias("x")).select("x.*").orderBy(F.desc(F.abs("weight")), "nth").limit(k)
        return t.select(F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "nth")).alias("rank"), "feature", "weight")


def top_coefficients(model: DataFrame, k: int = 30) -> DataFrame:
    """(rank, feature, weight) of the k largest absolute weights of a model table (nth, feature, weight), ties in its order.

    A sort with a limit picks them; only these k rows are then ranked in one window.
    """
    top = model.select("nth", "feature", "weight").orderBy(F.desc(F.abs("weight")), "nth").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "nth")).alias("rank"), "feature", "weight")
