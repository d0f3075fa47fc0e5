"""Steps of one's own between the engine's: a function on each row, with tries and leavings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import written

#: Rows that a worker holds at once.
BATCH = 64


def transform_rows(rows: DataFrame, step: Callable[[dict[str, Any]], list[dict[str, Any]] | dict[str, Any] | None], schema: T.StructType, tries: int = 3, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(what `step` makes of the rows, in `schema`; rows that it failed on). step gets a row as a
    dict and returns one, several or no dicts. It is tried again after `wait` seconds, doubled each
    time; rows that fail `tries` times come back with `error` and `tries`, and no row is lost. The
    step runs once for each row that succeeds, also if both results are used: they are written to
    the shared folder as they come, and a task that is lost runs its own rows again. A failure
    to fit the schema is the step's failure, too. Rows of any schema may be given."""
    out = T.StructType([T.StructField("__made", T.ArrayType(schema)), T.StructField("__error", T.StringType()), T.StructField("__tries", T.IntegerType()), T.StructField("__row", rows.schema)])
    arrow = to_arrow_schema(out)
    made = pa.list_(arrow.field("__made").type.value_type)

    def attempt(row: dict) -> tuple[list, str | None, int]:
        for n in range(1, tries + 1):
            try:
                found = step(dict(row))
                found = [] if found is None else found if isinstance(found, list) else [found]
                found = [{f: x.get(f) for f in schema.names} for x in found]
                pa.array([found], made)
                return found, None, n
            except Exception as e:  # whatever a step raises is told with its row
                error = f"{type(e).__name__}: {e}"
                if n < tries:
                    time.sleep(wait * 2 ** (n - 1))
        return [], error, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                given = b.slice(at, BATCH).to_pylist()
                told = [attempt(r) for r in given]
                columns = [*zip(*told, strict=True), [None if error is None else r for r, (_, error, _) in zip(given, told, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], names=out.names)

    done = written(rows.mapInArrow(run, out), "transformed")
    good = done.where("__error is null").select(F.inline("__made"))
    return good, done.where("__error is not null").select("__row.*", F.col("__error").alias("error"), F.col("__tries").alias("tries"))
