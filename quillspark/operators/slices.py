"""Arrow batches in slices of bounded size, so that what Python holds does not grow with a batch's texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text, or items of lists, in a slice; a larger row stands alone.
MOST = 1 << 19


def cuts(column: pa.Array, most: int) -> list[int]:
    """First rows of the slices, and the end."""
    nested = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.fill_null(pc.list_value_length(column) if nested else pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n + 1 > most:
            out.append(i)
            held = 0
        held += n + 1
    return [*out, len(sizes)] if len(sizes) else [0]


def map_slices(df: DataFrame, by: str, prepare: Callable, schema: str, most: int | None = None) -> DataFrame:
    """``mapInPandas`` in slices of the column ``by``; ``prepare()`` gives each task's function from frame to frame."""
    limit, out = most or MOST, to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = prepare()
        for b in batches:
            at = cuts(b.column(b.schema.get_field_index(by)), limit)
            for i, j in zip(at[:-1], at[1:]):
                told = each(b.slice(i, j - i).to_pandas(integer_object_nulls=True))
                yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(told[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
