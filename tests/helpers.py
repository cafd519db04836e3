from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def ts(hours: float = 0, **kw) -> datetime:
    return T0 + timedelta(hours=hours, **kw)


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    """Collected tuples in a stable order."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))
