from __future__ import annotations


def rows_of(df, *columns):
    """Rows as sorted tuples; None first."""
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(got, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])
