"""A table function for SQL: the nearest vectors of each partition of a table argument.

``SELECT * FROM vector_search(TABLE(SELECT vec_id, embedding, shard_id FROM v) PARTITION BY (shard_id), array(...), 10)`` gives
ten rows a shard; an outer ORDER BY ... LIMIT merges them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("distance", T.DoubleType())])


class VectorSearch:
    """Keeps the k nearest of the rows it is shown; ties by vec_id."""

    def __init__(self) -> None:
        self.kept: list[tuple[float, int]] = []

    def eval(self, row: Row, query: list[float], k: int) -> None:
        d = sum((x - float(y)) ** 2 for x, y in zip(row["embedding"], query, strict=True))
        item = (-d, -row["vec_id"])
        if len(self.kept) < k:
            heapq.heappush(self.kept, item)
        elif item > self.kept[0]:
            heapq.heapreplace(self.kept, item)

    def terminate(self) -> Iterator[tuple[int, float]]:
        for d, v in sorted(self.kept, reverse=True):
            yield -v, (-d) ** 0.5


def register_search(spark: SparkSession) -> None:
    """Make ``vector_search`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("vector_search", udtf(VectorSearch, returnType=RESULT))
