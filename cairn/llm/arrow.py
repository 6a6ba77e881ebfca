"""Running a per-text function over a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Characters of text handled between two result batches: bounds memory whatever the texts' lengths.
CHUNK = 8_000_000


def explode_texts(df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[..., list[tuple]]], fields: list[StructField], also: str | None = None) -> DataFrame:
    """``keys`` and ``fields`` for every tuple that a function returns for the row's text.

    ``make`` builds the function once per task; the value of the column ``also``, if named, is its second argument.  Keys are passed through untouched, nulls and any
    type included; a key may not have the name of a field.
    """
    if clash := {f.name for f in fields} & set(keys):
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    schema = StructType([*(df.schema[k] for k in keys), *fields])
    types = list(to_arrow_schema(StructType(fields)).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(text)
            others = batch.column(also) if also else None
            held: list[list] = [[] for _ in fields]
            index: list[int] = []
            size = 0

            def flush() -> pa.RecordBatch:
                nonlocal size
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(index, pa.int64())) for k in keys), *(pa.array(h, t) for h, t in zip(held, types))], names=schema.names
                )
                index.clear()
                for h in held:
                    h.clear()
                size = 0
                return out

            for i in range(batch.num_rows):
                value = texts[i].as_py()
                for row in function(value, others[i].as_py()) if also else function(value):
                    index.append(i)
                    for h, v in zip(held, row):
                        h.append(v)
                size += len(value or "")
                if size > CHUNK:
                    yield flush()
            yield flush()

    return df.select(*keys, text, *([also] if also else [])).mapInArrow(run, schema)
