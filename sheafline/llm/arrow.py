"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, cols: Sequence[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """`make()` gives, once per task, a function of a batch's columns (lists) that returns the
    output columns (lists, in schema order)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    cols = list(cols)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in it:
            got = f(*[b.column(i).to_pylist() for i in range(len(cols))])
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(got, out)], schema=out)

    return df.select(*cols).mapInArrow(run, schema)
