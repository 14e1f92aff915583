"""Run registered queries against their SQL: ``python -m postmatch_checks.compare [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from postmatch_checks import oracle
from postmatch_checks.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postmatch")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, con, name: str, sql: str, sf_dir: str) -> list[str]:
    """What differs between a query and its SQL; nothing when they agree."""
    df = REGISTRY[name](spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = _rows(columns, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    types = dict(df.dtypes)
    plain = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    for column in result.description:
        kind = plain.get(str(column[1]), str(column[1]))
        if types.get(column[0]) != kind:
            found.append(f"type of {column[0]}: {types.get(column[0])} != {kind}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows != {len(theirs)}")
    if ours != theirs:
        left, right = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
        found.append(f"{len(left)} rows only ours, {len(right)} only theirs")
        found += [f"  ours   {str(row)[:400]}" for row in left[:2]]
        found += [f"  theirs {str(row)[:400]}" for row in right[:2]]
    return found


def main(names: list[str]) -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = session(), views(sf_dir), 0
    texts = oracle.all_sql()
    for name in names or list(REGISTRY):
        start = time.time()
        try:
            found = differences(spark, con, name, texts[name], sf_dir) if name in texts else ["no SQL"]
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("   ", line)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
