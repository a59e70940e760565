"""Arrow batches of rows, for maps over batches."""

from __future__ import annotations

import pyarrow as pa


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; for the driver, since it needs the session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
