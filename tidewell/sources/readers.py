"""Sources by name. Settings are plain dictionaries with the keys ds.name, ds.url, ds.user, ds.password and ds.sql."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Settings = Mapping[str, str]


def jdbc_options(settings: Settings, driver: str) -> dict[str, str]:
    """Options of a JDBC scan: ds.sql (a statement) or ds.table, and partitioning where its four keys are given."""
    if not settings.get("ds.url"):
        raise ValueError("ds.url is missing")
    options = {"driver": driver, "url": settings["ds.url"]}
    if settings.get("ds.table"):
        options["dbtable"] = settings["ds.table"]
    elif settings.get("ds.sql"):
        options["query"] = settings["ds.sql"]
    else:
        raise ValueError("ds.sql is missing")
    for key, option in (("ds.user", "user"), ("ds.password", "password"), ("ds.fetch", "fetchsize")):
        if settings.get(key):
            options[option] = settings[key]
    split = {o: settings.get(k) for k, o in (("ds.column", "partitionColumn"), ("ds.lower", "lowerBound"), ("ds.upper", "upperBound"), ("ds.partitions", "numPartitions"))}
    if any(split.values()):
        if not all(split.values()) or "query" in options:
            raise ValueError("a split scan needs ds.table, ds.column, ds.lower, ds.upper and ds.partitions")
        options |= split
    return options


def predicates(column: str, quantiles: Sequence[int | float]) -> list[str]:
    """Conditions that each known row fulfils exactly one of, and one for rows without a value. They part the values at the
    quantiles; a value that is several of them, as it has so many rows, gets a condition of its own."""
    cuts = []  # (value, 0: before it, 1: behind it)
    for value, times in sorted(Counter(quantiles).items()):
        cuts += [(value, 0), (value, 1)] if times > 1 else [(value, 0)]

    def above(cut: tuple) -> str:
        return f"{column} {'>' if cut[1] else '>='} {cut[0]!r}"

    def below(cut: tuple) -> str:
        return f"{column} {'<=' if cut[1] else '<'} {cut[0]!r}"

    missing = f"{column} IS NULL"
    if not cuts:
        return [f"{column} IS NOT NULL", missing]
    return [below(cuts[0]), *[f"{above(x)} AND {below(y)}" for x, y in zip(cuts, cuts[1:])], above(cuts[-1]), missing]


def balanced_predicates(keys: DataFrame, column: str, parts: int) -> list[str]:
    """Conditions for about equal shares of the rows. keys: the values of the split column, all of them or a sample; whole numbers
    and floats are taken. Bounds of equal width would put a skewed column into few partitions."""
    kind = keys.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)) or parts < 1:
        raise ValueError("a scan is split by a number, into 1 or more parts")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    found = keys.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts))).first()[0] if parts > 1 else None
    return predicates(column, found or [])


def _jdbc(spark: SparkSession, settings: Settings, driver: str) -> DataFrame:
    """With ds.balance (a number of partitions) and ds.column a scan whose partitions have equal shares of the rows, by the values of
    the column as they are: those that ds.keys (a statement) gives, a sample maybe, or else all."""
    parts, column = settings.get("ds.balance"), settings.get("ds.column")
    if not parts:
        return spark.read.format("jdbc").options(**jdbc_options(settings, driver)).load()
    if not column or not settings.get("ds.table"):
        raise ValueError("a balanced scan needs ds.table and ds.column")
    plain = {k: v for k, v in settings.items() if k not in ("ds.column", "ds.table", "ds.sql")}
    keys = plain | {"ds.sql": settings.get("ds.keys") or f"SELECT {column} FROM {settings['ds.table']}"}
    found = balanced_predicates(spark.read.format("jdbc").options(**jdbc_options(keys, driver)).load(), column, int(parts))
    options = jdbc_options(plain | {"ds.table": settings["ds.table"]}, driver)
    return spark.read.jdbc(options.pop("url"), options.pop("dbtable"), predicates=found, properties=options)


def postgres(spark: SparkSession, settings: Settings) -> DataFrame:
    return _jdbc(spark, settings, "org.postgresql.Driver")


def ignite(spark: SparkSession, settings: Settings) -> DataFrame:
    """By the thin JDBC driver, where it is on the class path."""
    driver = settings.get("ds.driver")
    if not driver:
        raise NotImplementedError("name the JDBC driver in ds.driver to read from this source")
    return _jdbc(spark, settings, driver)


def parquet(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.read.parquet(settings["ds.url"])


def table(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.table(settings["ds.table"])


def json_lines(spark: SparkSession, settings: Settings) -> DataFrame:
    """One message a row, in the column `value`; the uplink parsers take it from there."""
    return spark.read.text(settings["ds.url"])


READERS: dict[str, Callable[[SparkSession, Settings], DataFrame]] = {"postgres": postgres, "ignite": ignite, "parquet": parquet, "table": table, "json": json_lines}


def read(spark: SparkSession, settings: Settings) -> DataFrame:
    name = settings.get("ds.name", "postgres")
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(READERS)}")
    return READERS[name](spark, settings)
