"""Reading observation files and payloads, writing result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that stand for a missing number.
MISSING = ("", "NULL", "null", "NaN")
TIME_PARTS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")


def number(text: Column) -> Column:
    """DOUBLE; missing tokens, what isn't a number, and NaN are null."""
    x = F.when(~F.trim(text).isin(*MISSING), text.try_cast("double"))
    return F.when(~F.isnan(x), x)


def timestamp(parts: list[Column]) -> Column:
    """UTC time of six whole numbers; null if they name none."""
    y, mo, d, h, mi = (p.try_cast("int") for p in parts[:5])
    return F.try_make_timestamp(y, mo, d, h, mi, parts[5].try_cast("decimal(8,6)"))


def read_observations(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """An observation CSV (lines that begin with / are comments): `ts` and `columns` as numbers; rows without a time go."""
    names = [*TIME_PARTS, *columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).option("comment", "/").option("header", header).option("enforceSchema", True).csv(path)
    out = raw.select(timestamp([F.col(c) for c in TIME_PARTS]).alias("ts"), *(number(F.col(c)).alias(c) for c in columns))
    return out.filter("ts is not null")


def read_wind(spark: SparkSession, path: str) -> DataFrame:
    """A wind CSV: `ts` and three numbers."""
    columns = ["wind_speed_10m", "wind_direction_10m", "wind_gusts_10m"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["datetime_utc", *columns]])
    raw = spark.read.schema(schema).option("comment", "/").option("header", True).csv(path)
    return raw.select(F.col("datetime_utc").try_cast("timestamp").alias("ts"), *(number(F.col(c)).alias(c) for c in columns)).filter("ts is not null")


def hourly_payload(rows: DataFrame, payload: str, variables: list[str]) -> DataFrame:
    """One row for each hour of a JSON payload {hourly: {time: [...], variable: [...]}}."""
    inner = ", ".join(["time: array<string>", *(f"{v}: array<double>" for v in variables)])
    parsed = rows.withColumn("_p", F.from_json(payload, f"hourly struct<{inner}>")).select(*(c for c in rows.columns if c != payload), "_p.hourly.*")
    zipped = parsed.withColumn("_z", F.explode(F.arrays_zip("time", *variables)))
    return zipped.select(*(c for c in rows.columns if c != payload), F.col("_z.time").try_cast("timestamp").alias("ts"), *(F.col(f"_z.{v}").alias(v) for v in variables))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)


#: Times in CSV keep their microseconds.
CSV_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, path: str, missing: str = "NULL") -> None:
    df.write.options(header=True, nullValue=missing, **CSV_TIMES).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, missing: str = "NULL") -> DataFrame:
    """What write_csv() wrote."""
    return spark.read.schema(schema).options(header=True, nullValue=missing, **CSV_TIMES).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read something there, in whatever store it lies."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_each(spark: SparkSession, paths: dict[str, str], schema: str, name: str = "variable") -> DataFrame:
    """The CSVs of several variables as one table, each with its name; files that aren't there are left out."""
    out = spark.createDataFrame([], f"{schema}, {name} string")
    for key, path in sorted(paths.items()):
        if exists(spark, path):
            out = out.unionByName(spark.read.schema(schema).option("header", True).option("nullValue", "NULL").csv(path).withColumn(name, F.lit(key)))
    return out


def markdown(df: DataFrame, most: int = 200) -> str:
    """The first rows of a result as a Markdown table, and a line that says so where there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"\nFirst {most} rows; there are more."] if len(rows) > most else []))
