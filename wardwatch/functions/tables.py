"""Small literal tables. They plan as local relations of known size, so the
optimizer broadcasts them by its own size check."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    data = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(data, fields)
