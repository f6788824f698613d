"""Running a function over the rows of a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a function at once; their texts are in memory together.
BATCH_ROWS = 1024


def map_rows(rows: DataFrame, schema: str, function: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """One output batch per input batch; `function` gives the output columns by name."""
    spark_schema = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                out = function(batch.slice(begin, BATCH_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, spark_schema)
