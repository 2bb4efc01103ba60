"""Named transforms and workflows of them, resumable from what was written.

A step takes the session, its arguments and the results so far and returns a DataFrame; its arguments may refer to
earlier results and to the workflow's input by {{name}}. Every result is written under the workflow's folder, so a run
that stopped goes on at the first step without a result; a step marked to wait stops the run until it is confirmed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from paperloom.functions.chunks import resolve_template

Transform = Callable[..., DataFrame]
_TRANSFORMS: dict[str, Transform] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    """Register a transform under a name that isn't taken."""

    def add(f: Transform) -> Transform:
        if name in _TRANSFORMS:
            raise ValueError(f"{name} is registered already")
        _TRANSFORMS[name] = f
        return f

    return add


def names() -> list[str]:
    """Registered transforms."""
    return sorted(_TRANSFORMS)


@dataclass
class Step:
    """One step of a workflow."""

    name: str
    transform: str
    arguments: dict = field(default_factory=dict)
    waits: bool = False


@dataclass
class Workflow:
    """Steps in order, their results under ``folder``."""

    folder: str
    steps: list[Step]

    def _done(self, spark: SparkSession, step: Step) -> bool:
        jvm = spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{step.name}/_SUCCESS")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

    def run(self, spark: SparkSession, given: dict | None = None, confirmed: set[str] = frozenset()) -> str | None:
        """Run what has no result yet; the name of the step that waits, or None when all are done."""
        results: dict[str, DataFrame] = {}
        for step in self.steps:
            path = f"{self.folder}/{step.name}"
            if not self._done(spark, step):
                if step.waits and step.name not in confirmed:
                    return step.name
                values = {k: resolve_template(v, given or {}) if isinstance(v, str) else v for k, v in step.arguments.items()}
                _TRANSFORMS[step.transform](spark, results, **values).write.mode("overwrite").parquet(path)
            results[step.name] = spark.read.parquet(path)
        return None
