"""Registered queries over files: each writes a table as files of a format and queries these by path.

A file is written by the tasks that hold its rows, so every path is a folder of parts.  Parts that are read as whole
documents have at most ``RECORDS`` records, so that a document stays small however many rows a task has.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.query import query
from lathe.sink import write_files


#: Records in a part that is read as a whole.
RECORDS = 50_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that executors share; a temporary one only where the session names none (a local session)."""
    shared = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="lathe-files-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(table: str, columns: list[str], sep: str = ",", header: bool = True):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        made = _table(spark, sf_dir, table).selectExpr(*columns)
        if sep == ",":
            write_files(made, folder, header)
        else:
            made.write.option("sep", sep).option("header", header).csv(folder)

    return write


def _lines(table: str, text: str, line_sep: str = "\n"):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        lines = _table(spark, sf_dir, table).select(F.expr(text).alias("value"))
        lines.write.option("lineSep", line_sep).option("maxRecordsPerFile", RECORDS).text(folder)

    return write


def _json(table: str, columns: list[str]):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        _table(spark, sf_dir, table).selectExpr(*columns).write.option("maxRecordsPerFile", RECORDS).json(folder)

    return write


def _parquet(table: str, columns: list[str]):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        _table(spark, sf_dir, table).selectExpr(*columns).write.parquet(folder + "/rows.parquet")

    return write


#: A text with separators, quotes and a line break within its field.
NOTE = "concat(c_mktsegment, ', \"', c_name, '\"\\n', c_nationkey)"
NOTE_SQL = "c_mktsegment || ', \"' || c_name || '\"' || chr(10) || c_nationkey"
TIME = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"

Write = Callable[[SparkSession, str, str], None]
#: What writes the file, the query's arguments (``FILE`` is its path), and the rows as SQL over the table.
FILES: dict[str, tuple[Write, list[str], str]] = {
    "csv_file": (
        _csv("customer", ["c_custkey AS key", f"{NOTE} AS note"]),
        ["in[FILE]", "id:int[key]", "note", "n:len[note]"],
        f"SELECT CAST(c_custkey AS BIGINT) AS id, {NOTE_SQL} AS note, length({NOTE_SQL})::BIGINT AS n FROM customer",
    ),
    "csv_file_groups": (
        _csv("customer", ["c_mktsegment AS segment", "c_custkey AS key", "c_acctbal AS balance"]),
        ["in[FILE]", "segment", "n:count[key]", "s:round[sum[balance],2]", "where[balance>0]"],
        "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE c_acctbal > 0 GROUP BY ALL",
    ),
    "tsv_file": (
        _csv("supplier", ["s_suppkey AS key", "s_name AS name", "s_nationkey AS nation"], "\t"),
        ["in[FILE]", "name", "k:int[nation]", "where[nation>=10]"],
        "SELECT s_name AS name, CAST(s_nationkey AS BIGINT) AS k FROM supplier WHERE s_nationkey >= 10",
    ),
    "csv_no_header": (
        _csv("nation", ["n_nationkey", "n_name", "n_regionkey"], header=False),
        ["in[FILE]", "inheader[false]", "name:{2}", "r:int[{3}]"],
        "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation",
    ),
    "csv_only": (
        _csv("part", ["p_partkey AS `<k>`", "p_brand AS brand"]),
        ["in[FILE]", "csvonly[true]", "k:int[{<k>}]", "brand"],
        "SELECT CAST(p_partkey AS BIGINT) AS k, p_brand AS brand FROM part",
    ),
    "csv_ragged": (
        _lines("part", "concat(p_partkey, ',', p_brand, if(p_size > 25, concat(',', p_size), ''))"),
        ["in[FILE]", "inheader[false]", "k:int[{1}]", "brand:{2}", "size:{3}"],
        "SELECT CAST(p_partkey AS BIGINT) AS k, p_brand AS brand, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END "
        "AS size FROM part",
    ),
    "csv_carriage_returns": (
        _lines("supplier", "concat(s_suppkey, ',', s_name)", "\r"),
        ["in[FILE]", "inheader[false]", "k:int[{1}]", "name:{2}"],
        "SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name FROM supplier",
    ),
    "join_no_header": (
        _csv("nation", ["n_nationkey", "n_name"], header=False),
        ["in[customer]", "nation:right::{2}", "n:count[c_custkey]", "join[FILE]", "joinheader[false]",
         "where[c_nationkey==int[right::{1}]]"],
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    ),
    "parquet_file": (
        _parquet("orders", ["o_orderkey", "o_orderpriority", "o_totalprice"]),
        ["in[FILE/rows.parquet]", "p:o_orderpriority", "n:count[o_orderkey]", "where[o_totalprice>100000]"],
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY ALL",
    ),
    "json_file": (
        _json("events", ["event_id", "event_type", "named_struct('user', user_id) AS by"]),
        ["in[FILE]", "kind:event_type", "n:count[event_id]", "most:max[int[by.user]]"],
        "SELECT event_type AS kind, count(*) AS n, CAST(max(user_id) AS BIGINT) AS most FROM events GROUP BY ALL",
    ),
    "log_file": (
        _lines("events", f"concat('[', {TIME}, '] [INFO] ', event_type, ' - seen by ', user_id, '\\nand no more')"),
        ["in[FILE]", "time", "kind:category", "msg"],
        "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type AS kind, 'seen by ' || user_id || chr(10) || 'and no more' "
        "AS msg FROM events",
    ),
    "log_trace_scopes": (
        _lines(
            "events",
            f"concat('[', {TIME}, '] [TRACE] START - {{job: ', event_id, '}}\\n[', {TIME}, '] [INFO] user - {{who: ', user_id, "
            f"'}}\\n[', {TIME}, '] [TRACE] END - done')",
        ),
        ["in[FILE]", "j:int[job]", "w:int[who]"],
        "SELECT CAST(event_id AS BIGINT) AS j, CAST(user_id AS BIGINT) AS w FROM events",
    ),
    "xml_attributes": (
        _lines(
            "customer",
            "concat('<group name=\"', c_mktsegment, '\"><item id=\"', c_custkey, '\">', c_name, '</item></group>')",
        ),
        ["in[FILE]", "item", "id:item..id", "segment:item..name"],
        "SELECT c_name AS item, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer",
    ),
    "xml_case": (
        _lines("nation", "concat('<n><Name>', n_name, '</Name></n><n><name>', n_nationkey, '</name></n>')"),
        ["in[FILE]", "case[true]", "Name"],
        'SELECT n_name AS "Name" FROM nation',
    ),
    "xml_any_case": (
        _lines("nation", "concat('<n><Name>', n_name, '</Name></n><n><name>', n_nationkey, '</name></n>')"),
        ["in[FILE]", "name"],
        "SELECT n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation",
    ),
    "arguments_file": (
        _csv("supplier", ["s_suppkey AS key", "s_nationkey AS nation"]),
        ["in[FILE]", "@counted"],
        "SELECT CAST(s_nationkey AS VARCHAR) AS nation, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY ALL",
    ),
}

#: Files of arguments that queries name.
ARGUMENTS = {"counted": "nation n:count[key]  # suppliers by nation\nwhere[nation<20]\n"}


def file_query(name: str, spark: SparkSession, sf_dir: str, tables: Callable) -> DataFrame:
    write, args, _ = FILES[name]
    folder = new_folder(spark, name)
    write(spark, sf_dir, folder)
    with tempfile.TemporaryDirectory() as local:
        # Argument files are read by the driver when the query is made.
        for file, text in ARGUMENTS.items():
            Path(local, file).write_text(text)
        made = [f"@{local}/{a[1:]}" if a.startswith("@") else a.replace("FILE", folder) for a in args]
        return query(spark, made, tables=tables(spark, sf_dir))


def queries(tables: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(file_query, name, tables=tables) for name in FILES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in FILES.items()}
