"""Apply transform chains to byte columns in Arrow batches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as t

_TYPE = pa.struct([("status", pa.string()), ("data", pa.binary()), ("truncated", pa.bool_()), ("steps", pa.string())])


def transform(rows: DataFrame, plan: str, data: str = "data", most: int = t.MOST) -> DataFrame:
    """Add `transformed`: status, data, truncated and the steps as JSON; null bytes count as empty."""
    modes = t.parse_plan(plan)

    def run(raw: pa.Array) -> pa.Array:
        out = []
        for b in raw.to_pylist():
            result, steps = t.chain(modes, b or b"", most)
            out.append({"status": result.status, "data": result.data, "truncated": result.truncated, "steps": json.dumps(steps)})
        return pa.array(out, _TYPE)

    return rows.withColumn("transformed", F.arrow_udf(run, "struct<status: string, data: binary, truncated: boolean, steps: string>")(F.col(data)))
