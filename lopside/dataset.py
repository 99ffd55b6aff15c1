"""A labelled table: feature columns, a target column and a row id."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """``features`` may hold scalar columns or a single array column.

    ``row_id`` must be a unique bigint: every draw, tie-break and fold in this
    package is a function of it, so results do not depend on partitioning.
    """

    df: DataFrame
    features: list[str]
    target: str
    row_id: str
    name: str = field(default="dataset")

    @classmethod
    def last_column(cls, df: DataFrame, row_id: str, name: str = "dataset") -> "Dataset":
        """Every column but the id and the last is a feature; the last is the target."""
        columns = [c for c in df.columns if c != row_id]
        return cls(df, columns[:-1], columns[-1], row_id, name)

    def with_df(self, df: DataFrame) -> "Dataset":
        return replace(self, df=df)

    def vector(self) -> Column:
        """The features of a row as ``array<double>``."""
        types = {f.name: f.dataType for f in self.df.schema.fields}
        if len(self.features) == 1 and isinstance(types[self.features[0]], T.ArrayType):
            return F.col(self.features[0]).cast("array<double>")
        return F.array(*[F.col(c).cast("double") for c in self.features])

    def points(self) -> DataFrame:
        """The table in the shape the distance operators take: id, label, x."""
        return self.df.select(
            F.col(self.row_id).cast("bigint").alias("id"),
            F.col(self.target).cast("string").alias("label"),
            self.vector().alias("x"),
        )
