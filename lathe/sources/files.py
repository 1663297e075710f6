"""Sources by name: registered tables and DataFrames, Parquet, CSV, TSV, logs, and documents of XML, JSON and logs.

A file's format is told from its beginning, never from its extension: JSON, XML, log, TSV, else CSV.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.plans.spec import SpecError
from lathe.sources.tree import column_names, log_line, read_documents


@dataclass(frozen=True)
class Tabular:
    """Records that are rows; ``order`` names the column (or columns) that order them."""

    df: DataFrame
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Documents:
    """Texts (doc, text) whose rows a matcher finds; kind is one of ``tree.EVENTS``."""

    docs: DataFrame
    kind: str


Source = Tabular | Documents


def sniff(lines: list[str]) -> str:
    """The format of a text that begins with some lines."""
    head = "\n".join(lines).lstrip("\ufeff \t\r\n")
    if head.startswith("<"):
        return "xml"
    if any(log_line(line) for line in lines[:9]):
        return "log"
    if head.startswith("{") or re.match(r"\[\s*(?:$|[\[{\"'\]]|-?[\d.]+\s*[,\]]|\w+\s*[,\]])", head):
        return "json"
    first = next((line for line in lines if line.strip()), "")
    return "tsv" if "\t" in first else "csv"


def open_source(
    spark: SparkSession,
    name: str,
    header: bool = True,
    csv_only: bool = False,
    kind: str | None = None,
    records: bool = True,
) -> Source:
    """The source at a path.

    Delimited records are rows of their own.  With ``records`` false, a file with unequal records goes through the
    matcher instead: a row is then complete when all its columns have had a field, perhaps of several records.
    """
    if name.rstrip("/").endswith(".parquet") and kind in (None, "parquet"):
        return Tabular(spark.read.parquet(name))
    try:
        lines = [r[0] for r in spark.read.text(name).limit(20).collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            raise SpecError(f"Input file could not be opened: {name}") from None
        raise
    kind = kind or sniff(lines)
    if csv_only and kind in ("xml", "json", "log"):
        kind = "csv"
    if kind in ("xml", "json", "log"):
        return Documents(read_documents(spark, name), kind)
    sep = "\t" if kind == "tsv" else ","
    if not records:
        count = F.size(F.split("value", re.escape(sep), -1))
        unquoted = spark.read.text(name).filter(~F.contains("value", F.lit('"')))
        least, most = unquoted.agg(F.min(count), F.max(count)).first()
        if least != most:
            return Documents(read_documents(spark, name), kind if header else f"{kind}-plain")
    return Tabular(read_delimited(spark, name, sep, header), ("_ord",))


def read_delimited(spark: SparkSession, path: str, sep: str, header: bool) -> DataFrame:
    """A delimited file with quoted newlines and ragged rows: short rows are padded with empty text, further fields of
    long rows get numbered columns.  ``_ord`` is the record's place."""
    options = {"sep": sep, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False}
    fields = F.size(F.split("value", re.escape(sep), -1))
    quoted = F.contains("value", F.lit('"'))
    # Separators may stand within quotes, so lines with quotes only bound the width; parsed records then tell it.
    most, plain_most = spark.read.text(path).agg(F.max(fields), F.max(F.when(~quoted, fields))).first()
    most, width = most or 1, plain_most or 1
    schema = lambda n: T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(n)])
    plain = spark.read.schema(schema(most)).options(**options)
    first = plain.csv(path).first()
    if first is None:
        return spark.createDataFrame([], "`1` string, _ord long")
    if most > width:
        filled = [F.max(F.when(F.col(f"c{k}").isNotNull(), k + 1)) for k in range(width, most)]
        width = max([width, *(n or 0 for n in plain.csv(path).agg(*filled).first())])
    plain = spark.read.schema(schema(width)).options(**options)
    first = first[:width]
    given = [v for v in first]
    while given and given[-1] is None:
        given.pop()
    names = column_names(given if header else [], width)
    rows = plain.option("header", header).option("enforceSchema", True).csv(path)
    return rows.select(
        *(F.coalesce(F.col(f"c{k}"), F.lit("")).alias(name) for k, name in enumerate(names)),
        F.monotonically_increasing_id().alias("_ord"),
    )
