"""Columns that tasks add to Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import words as W
from .store import bounded_batches, fresh


def extended(docs: DataFrame, inputs: dict[str, str], fields: list[StructField], start: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.Array]]]) -> DataFrame:
    """`docs` with `fields` added; a column of such a name, in any case of letters, is replaced.

    `inputs` are columns and the types they are read as, the text last. `start` is called once a task and gives what makes
    the new columns of a batch of the inputs, which has about 2 MB of text or one longer text.
    """
    bounded_batches(docs.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    own = fresh(docs, *(f"in{j}" for j in range(len(inputs))))
    read = docs.select(*(F.col(f.name) for f in kept), *(F.col(c).cast(kind).alias(o) for (c, kind), o in zip(inputs.items(), own, strict=True)))
    n, k = len(kept), len(own)
    names = [f.name for f in kept + fields]

    def run(batches):
        make = start()
        for b in W.chunks(batches, own[-1]):
            made = list(make(pa.RecordBatch.from_arrays(b.columns[n:], [f"i{j}" for j in range(k)])))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names)

    return read.mapInArrow(run, StructType(kept + fields))
