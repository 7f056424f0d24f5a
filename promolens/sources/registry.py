"""Source registry: name of a source to the function that stages its records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from promolens.functions.records import accepted, build_records
from promolens.vocabulary import Vocabulary

Stage = Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self) -> None:
        self._stages: dict[str, Stage] = {}

    def add(self, name: str, stage: Stage) -> None:
        self._stages[name] = stage

    def names(self) -> list[str]:
        return list(self._stages)

    def collect(self, inputs: dict[str, DataFrame], vocab: Vocabulary) -> DataFrame:
        """Accepted records of all given sources, with the source name."""
        from pyspark.sql import functions as F

        union = None
        for name, raw in inputs.items():
            staged = self._stages[name](raw).withColumn("source", F.lit(name))
            union = staged if union is None else union.unionByName(staged, allowMissingColumns=True)
        return accepted(build_records(union, vocab))
