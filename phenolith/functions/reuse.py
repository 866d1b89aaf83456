"""Tables that are read several times."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Steps of a plan that take no longer than reading a copy of their result would.
_LIGHT = {"Project", "Filter", "Union", "SubqueryAlias"}


def light(df: DataFrame) -> bool:
    """Whether a table is a scan, filtered and projected."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        below = plan.children()
        if below.size() and plan.nodeName() not in _LIGHT:
            return False
        todo += [below.apply(i) for i in range(below.size())]
    return True


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for several passes: joins, aggregations and the like run once, and their rows stay on the executors' disks meanwhile."""
    if light(df):
        yield df
        return
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()
