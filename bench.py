"""Times the headline queries: one warm-up, then the median of three runs, each written to Spark's no-op sink.

Beside them are DuckDB's seconds for the same rows by the query's SQL, on as many threads.  Prints one line of JSON.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import duckdb
from pyspark.sql import SparkSession

from lathe.plans import catalog

HEADLINES = [
    "flagship", "where_and", "arith", "math_fns", "string_fns", "datetime_fns", "agg_all", "agg_group1", "agg_cov_corr",
    "having_top", "distinct2", "sort_top", "first_then_where", "rownum", "join_inner", "join_two_keys", "join_left_outer",
    "join_agg", "pivot_named", "pivot_jagged", "json_path", "unpivot",
]


def timed(run) -> float:
    times = []
    for _ in range(4):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, sql = catalog.queries(), catalog.oracle_sql()
    duck = duckdb.connect(config={"threads": int(cpus)})
    for name in catalog.TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    seconds, beside = {}, {}
    for name in HEADLINES:
        seconds[name] = timed(lambda: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        beside[name] = timed(lambda: duck.execute(sql[name]).fetchall())
    total = round(sum(seconds.values()), 3)
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}
    print(json.dumps(out | {"duckdb": beside, "duckdb_total": round(sum(beside.values()), 3)}))


if __name__ == "__main__":
    main()
