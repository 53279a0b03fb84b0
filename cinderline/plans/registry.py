"""Named queries with their comparison SQL."""

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def rounded(df, digits: int = 6, /, **special):
    """Round every double, so both engines agree on values that differ only in summation order."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return df.select(*[
        F.round(f.name, special.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])
