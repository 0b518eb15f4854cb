"""Arrow-batch mapping: one Python call per record batch, never one per row in the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``fn`` (columns as lists in, columns as lists out) to every Arrow batch of ``df``."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    names = struct.fieldNames()
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow
            )

    return df.mapInArrow(run, struct)
