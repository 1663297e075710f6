"""Results as CSV: to a stream from one driver, or to files from all executors."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.coerce import of_column, rendered


def as_text(df: DataFrame) -> DataFrame:
    """All columns as the text they have in a file: reals with up to ten decimals, missing values empty."""
    return df.select(
        *(
            F.coalesce(rendered(of_column(F.col(f"`{f.name}`"), f.dataType)), F.lit("")).alias(f.name)
            if not isinstance(f.dataType, (T.BooleanType,))
            else F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name)
            for f in df.schema.fields
        )
    )


def write_stream(df: DataFrame, out: TextIO, header: bool = True) -> int:
    """Rows to a stream, one partition in memory at a time; no header without rows.  Returns the number of rows."""
    rows = 0
    for row in as_text(df).toLocalIterator():
        if not rows and header:
            out.write(",".join(map(quoted, df.columns)) + "\n")
        out.write(",".join(map(quoted, row)) + "\n")
        rows += 1
    return rows


def quoted(field: str) -> str:
    """A field as it stands in a line: in quotes if it holds a comma, a quote or a line break."""
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ',"\n\r') else field


def write_files(df: DataFrame, folder: str, header: bool = True) -> None:
    """Rows to a folder of CSV files, each written by the task that has them."""
    as_text(df).write.option("header", header).option("quote", '"').option("escape", '"').csv(folder)
