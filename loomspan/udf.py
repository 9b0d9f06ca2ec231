"""Arrow functions whose Spark types are resolved when they are first called, not when a module is imported."""

from __future__ import annotations

import functools
import sys
import types

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows, and characters of input, whose results a worker holds as Python objects before it hands them on.
SLICE_ROWS, SLICE_CHARS = 128, 1 << 17


def arrow_udf(schema: str):
    def wrap(run):
        @functools.wraps(run)
        def call(*columns) -> Column:
            return F.pandas_udf(run, schema)(*columns)

        return call

    return wrap


def row_udf(schema: str, setup: bool = False, build=None):
    """An Arrow function from a function of one row's values; with setup, from one that returns that function and is called once a task.

    Results are handed on in small slices, so a worker's memory follows its largest rows, not the rows of an Arrow batch.
    build makes the Arrow array of a slice's results, given them and the Arrow type; without it they are Python values.
    """

    def wrap(run):
        @functools.wraps(run)
        def call(*columns) -> Column:
            from pyspark.sql.pandas.functions import ArrowUDFType
            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import DataType

            kind = to_arrow_type(DataType.fromDDL(schema))
            slices = functools.partial(_in_slices, run, setup, kind, build=build)
            return F.arrow_udf(lambda batches: slices(batches), schema, ArrowUDFType.SCALAR_ITER)(*columns)

        return call

    return wrap


def _in_slices(run, setup: bool, kind, batches, build=None):
    import pyarrow as pa

    build = build or pa.array
    one, out, size = run() if setup else run, [], 0
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for i in range(len(columns[0])):
            values = [c[i].as_py() for c in columns]
            out.append(one(*values))
            size += sum(len(v) if isinstance(v, (str, bytes, list)) else 1 for v in values)
            if len(out) >= SLICE_ROWS or size >= SLICE_CHARS:
                yield build(out, kind)
                out, size = [], 0
        if out:
            yield build(out, kind)
            out, size = [], 0


def worker_cache() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_loomspan_worker", types.ModuleType("_loomspan_worker")).__dict__


def guarded(run, default):
    """run for one value, with a default where it fails."""

    def call(value):
        try:
            return run(value)
        except Exception:
            return default

    return call
