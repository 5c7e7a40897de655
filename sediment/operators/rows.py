"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def flat_map_rows(df: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that f makes of each row of df; a batch is worked through at a time."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                rows = [r for row in part.slice(at, 500).to_pylist() for r in f(row)]
                columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)
