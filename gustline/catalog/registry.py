"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import configure
from .prelude import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Results are compared to 6 decimals. Means of few short decimals often end in an exact 5 at the
# seventh, where the last bit of the float decides; both sides are moved off such ties first.
OFF_TIES = 3.7e-8


def present(df: DataFrame) -> DataFrame:
    """Comparable form: rounded doubles, timestamps without zone."""
    def shown(f: T.StructField):
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double") + F.lit(OFF_TIES), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(f.name)
        return c
    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the prelude's views, ``doubles`` get rounded."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(configure(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f'round("{c}" + {OFF_TIES}, 6) + 0.0 AS "{c}"' for c in doubles.split("|") if c)
            replace = f" REPLACE ({rounded})" if rounded else ""
            ORACLES[name] = f"WITH {PRELUDE}\nSELECT *{replace} FROM (\n{sql}\n)"
        return fn
    return wrap
