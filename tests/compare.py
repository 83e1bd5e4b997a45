"""Rows of Spark and of SQL, alike for comparison."""


def rows(df):
    """Rows with columns by name, values rounded, sorted."""
    columns = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def sql_rows(con, sql):
    relation = con.sql(sql)
    at = [relation.columns.index(c) for c in sorted(relation.columns)]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in at)) for r in relation.fetchall()), key=lambda t: tuple((v is None, str(v)) for v in t))
