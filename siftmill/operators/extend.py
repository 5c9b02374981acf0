"""Where users plug in: detectors, bundles of them, transforms and aggregations of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame

from siftmill.operators import scan
from siftmill.sources.corpus import excluded_path
from siftmill.sources.rules import Rule

DetectorFn = Callable[[DataFrame, list[Rule]], DataFrame]


@dataclass
class DetectorSet:
    """Detectors by rule type. A detector maps (files, rules) to violations as DataFrames."""

    detectors: dict[str, DetectorFn] = field(default_factory=dict)

    def register(self, rule_type: str, fn: DetectorFn) -> DetectorSet:
        return DetectorSet({**self.detectors, rule_type: fn})

    def run(self, files: DataFrame, rules: list[Rule]) -> DataFrame:
        """All rules that have a detector, in one union."""
        parts = [fn(files, [r for r in rules if r.type == kind]) for kind, fn in self.detectors.items() if any(r.type == kind for r in rules)]
        return reduce(DataFrame.unionByName, parts)


@dataclass
class PlugIn:
    """A bundle: detectors, what to leave out of the corpus, and its rules."""

    detectors: DetectorSet
    rules: list[Rule]
    exclude: Callable = excluded_path

    def scan(self, files: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        return self.detectors.run(files.filter(~self.exclude(F.col("path"))), self.rules)


def standard_detectors() -> DetectorSet:
    def absence(files: DataFrame, rules: list[Rule]) -> DataFrame:
        parts = [scan.absence_anywhere(files, r) if r.scope_mode == "any" else scan.absence_per_file(files, r) for r in rules]
        return reduce(DataFrame.unionByName, parts)

    def cross(files: DataFrame, rules: list[Rule]) -> DataFrame:
        return reduce(DataFrame.unionByName, [scan.cross_check_same_file(files, r) for r in rules])

    return DetectorSet({"presence": scan.scan_presence, "absence": absence, "cross-check": cross, "pattern_presence": scan.scan_must_not_exist})


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User transforms in order."""
    return reduce(lambda out, step: out.transform(step), steps, df)


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's own aggregation over groups of bounded size (clusters, sessions)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
