"""How a query and its SQL are registered and what queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one directory as attributes, and SQL over them."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents embeddings"
        " pages benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """SQL whose ``{table}`` marks stand for the given tables."""
        used = {n: getattr(self, n) for n in self.NAMES if "{" + n + "}" in text}
        return self.spark.sql(text, **used, **more)


def plain(text: str) -> str:
    """The same SQL with bare table names."""
    for n in Tables.NAMES:
        text = text.replace("{" + n + "}", n)
    return text


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and whole numbers as bigint."""

    def shape(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c, 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("bigint").alias(f.name)
        return c

    return df.select(*[shape(f) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = plain(sql)
        return fn

    return register
