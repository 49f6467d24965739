"""Column expressions that are made once for a Spark context.

Columns name what they read and belong to no DataFrame, so one serves all requests; those
with thousands of parts take seconds to put together, one call to the JVM for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")
_MADE: dict[tuple[str, Hashable], object] = {}


def reused(df: DataFrame, key: Hashable, build: Callable[[], T]) -> T:
    """build()'s columns, from an earlier call with this key in the context of df, if there was one."""
    at = (df.sparkSession.sparkContext.applicationId, key)
    if at not in _MADE:
        _MADE[at] = build()
    return _MADE[at]
