"""Named queries over the driver's tables, each with the DuckDB SQL of the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding on both sides, so that exact halves don't hang on the order of a sum, and -0 is 0.
NUDGE = 1.2345678e-7


def rnd(c, places: int):
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, places)


def rounded(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: rnd(c, places) for c in cols})


def nudged(sql: str) -> str:
    """The SQL with NUDGE added in each round()."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        out += f"{sql[at:i]}round(({nudged(sql[i + 6 : comma])}) + {NUDGE}, {sql[comma + 1 : j - 1].strip()})"
        at = j
    return out + sql[at:]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = nudged(oracle)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
