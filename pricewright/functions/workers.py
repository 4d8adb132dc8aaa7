"""Python work on record batches in tasks, where workers may not have this package on their path."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame


def arrow_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by a function that may use this package."""
    root, pickled = str(Path(__file__).resolve().parents[2]), cloudpickle.dumps(function)

    def task(batches):
        import sys

        from pyspark import cloudpickle

        if root not in sys.path:
            sys.path.append(root)
        yield from cloudpickle.loads(pickled)(batches)

    return df.mapInArrow(task, schema)
