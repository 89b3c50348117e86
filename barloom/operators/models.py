"""Stored models: versions in a folder, each with its features and their types, committed as a whole."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..streaming.ledger import Folder


class MissingFeatures(ValueError):
    """Rows that a stored model can't score."""


class Stored:
    """A model and what it needs."""

    def __init__(self, version: int, model: PipelineModel, features: dict[str, str], notes: dict):
        self.version, self.model, self.features, self.notes = version, model, features, notes

    def check(self, rows: DataFrame) -> None:
        kinds = dict(rows.dtypes)
        missing = [f for f in self.features if f not in kinds]
        other = [f"{f} is {kinds[f]}, not {t}" for f, t in self.features.items() if f in kinds and kinds[f] != t]
        if missing or other:
            raise MissingFeatures("; ".join([*(f"{f} is missing" for f in missing), *other]))

    def transform(self, rows: DataFrame) -> DataFrame:
        self.check(rows)
        return self.model.transform(rows)


class Models(Folder):
    """version=N holds a model, commits/N its description; a save that dies leaves no version."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)

    def save(self, model: PipelineModel, rows: DataFrame, features: list[str], **notes) -> int:
        """rows: any rows that the model can score, for the features' types. Returns the new version."""
        kinds, n = dict(rows.dtypes), self.last() + 1
        model.write().overwrite().save(f"{self.path}/version={n}")
        self.commit(n, json.dumps({"features": {f: kinds[f] for f in features}, "notes": notes}))
        return n

    def load(self, version: int | None = None) -> Stored:
        n = self.last() if version is None else version
        if n < 0 or n > self.last():
            raise LookupError(f"no version {n} in {self.path}")
        about = json.loads(self.text(n))
        return Stored(n, PipelineModel.load(f"{self.path}/version={n}"), about["features"], about["notes"])
