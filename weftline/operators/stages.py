"""Stages with one form: fit on a table, transform another, and back.

A stage's `fit` returns a stage that knows what it has seen (as small tables, which stay
lazy); `transform` and `inverse` only add to the plan. A chain fits each stage on what the
ones before it make, and goes back in the other order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import features, tracks


@dataclass(frozen=True)
class Stage:
    """A stage that needs no fit and changes nothing; others override what they do."""

    def fit(self, rows: DataFrame) -> Stage:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows

    def inverse(self, rows: DataFrame) -> DataFrame:
        return rows


@dataclass(frozen=True)
class Chain(Stage):
    stages: tuple[Stage, ...] = ()

    def fit(self, rows: DataFrame) -> Chain:
        fitted = []
        for stage in self.stages:
            fitted.append(stage.fit(rows))
            rows = fitted[-1].transform(rows)
        return Chain(tuple(fitted))

    def transform(self, rows: DataFrame) -> DataFrame:
        for stage in self.stages:
            rows = stage.transform(rows)
        return rows

    def inverse(self, rows: DataFrame) -> DataFrame:
        for stage in reversed(self.stages):
            rows = stage.inverse(rows)
        return rows


@dataclass(frozen=True)
class Standardized(Stage):
    """`vec` less its mean, by its deviation."""

    stats: DataFrame | None = None

    def fit(self, rows: DataFrame) -> Standardized:
        return replace(self, stats=features.channel_statistics(rows).select("i", "mean", "std"))

    def transform(self, rows: DataFrame) -> DataFrame:
        return features.standardize(rows, self.stats)

    def inverse(self, rows: DataFrame) -> DataFrame:
        return features.standardize(rows, self.stats, inverse=True)


@dataclass(frozen=True)
class Masked(Stage):
    """The chosen components of `vec`; back with zeros for the others."""

    mask: tuple[int, ...] = ()

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", features.mask_select(F.col("vec"), list(self.mask)))

    def inverse(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", features.mask_scatter(F.col("vec"), list(self.mask)))


@dataclass(frozen=True)
class RootDeltas(Stage):
    """The root's path as steps; back from the start positions of each axis."""

    root: str = "Hips"
    start: tuple[tuple[str, float], ...] = ()

    def transform(self, rows: DataFrame) -> DataFrame:
        return tracks.root_deltas(rows, self.root)

    def inverse(self, rows: DataFrame) -> DataFrame:
        return tracks.root_positions(rows, self.root, dict(self.start))


@dataclass(frozen=True)
class WithoutConstants(Stage):
    """Channels that change; the constant ones of the fitted track come back with their value."""

    track: int = 0
    constants: DataFrame | None = None

    def fit(self, rows: DataFrame) -> WithoutConstants:
        return replace(self, constants=tracks.constant_values(rows, self.track))

    def transform(self, rows: DataFrame) -> DataFrame:
        return tracks.remove_channels(rows, self.constants)

    def inverse(self, rows: DataFrame) -> DataFrame:
        return tracks.restore_channels(rows, self.constants)
