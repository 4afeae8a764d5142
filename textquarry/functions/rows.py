"""Row-wise Python steps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def flat_map(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """fn(*columns of a row) gives dictionaries, one a result row; what a dictionary lacks is null."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in fn(*values)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
