"""Writers: Parquet for versions, CSV and JSON lines for export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline import roles
from plumbline.sources.readers import IngestError


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write df without its row-identity columns; refuses unknown formats."""
    out = df.drop(*roles.ROW_IDENTITY).write.mode(mode)
    if fmt == "parquet":
        out.parquet(path)
    elif fmt == "csv":
        (out.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    elif fmt == "json":
        out.option("ignoreNullFields", False).json(path)
    else:
        raise IngestError(f"unsupported format '{fmt}'")
