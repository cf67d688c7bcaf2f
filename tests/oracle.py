"""Run a catalogue query in Spark and its SQL oracle in DuckDB and compare the results."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from docpipe.sources.tables import TABLES, table_path


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(data_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], sorted(columns)


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP",
                 "DateType()": "DATE"}


def type_differences(spark_df, con, sql):
    spark_types = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in spark_df.schema.fields}
    rel = con.sql(sql)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return [(c, t, duck_types.get(c)) for c, t in spark_types.items() if t != duck_types.get(c)]


def compare(spark_df, con, sql):
    types = type_differences(spark_df, con, sql)
    if types:
        return [f"column types differ (name, spark, duck): {types}"]
    s_cols = spark_df.columns
    s_rows, s_names = rows_of(s_cols, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows, d_names = rows_of(d_cols, res.fetchall())
    problems = []
    if s_names != d_names:
        problems.append(f"columns differ: spark={s_names} duck={d_names}")
        return problems
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        problems.append(f"rows differ: spark={len(s_rows)} duck={len(d_rows)} "
                        f"only_spark={only_s!r:.1500} only_duck={only_d!r:.1500}")
    return problems
