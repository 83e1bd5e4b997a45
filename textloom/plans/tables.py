"""Loading of the tables, and what the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, object]:
    """(queries, SQL, decorator): ``@query(sql)`` registers a function under its name."""
    queries: dict = {}
    sqls: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query


#: Lower-case words of ASCII letters and digits, in SQL.
SQL_WORDS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '')"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """Rows of fixed values in SQL; columns: ``name TYPE, ...``."""
    own = [c.strip().split(" ", 1) for c in columns.split(",")]
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST(c{i} AS {kind}) AS {chr(34)}{name}{chr(34)}' for i, (name, kind) in enumerate(own))} FROM (VALUES {listed}) t({', '.join(f'c{i}' for i in range(len(own)))})"
