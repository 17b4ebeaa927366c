import datetime as dt


def ordered(rows):
    """Rows sorted column by column, NULLs last."""
    return sorted(rows, key=lambda row: [(v is None, 0 if v is None else v) for v in row])


def tuples(df, *columns):
    return ordered(tuple(r) for r in df.select(*columns).collect())


def hours(n):
    return dt.timedelta(hours=n)
