"""Event logs as JSON lines, results, and gates on what a run must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_utc(time: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second; the session's time zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def append_events(rows: DataFrame, path: str, kind: str | Column, time: Column | None = None) -> None:
    """Appends the rows to a log as JSON lines, with their kind, one for all or a column, and time."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows.select(iso_utc(F.current_timestamp() if time is None else time).alias("at"), kind.alias("kind"), F.to_json(F.struct(*rows.columns)).alias("detail")).write.mode("append").json(path)


def read_events(spark, path: str) -> DataFrame:
    return spark.read.schema("at string, kind string, detail string").json(path)


def gate(facts: DataFrame) -> DataFrame:
    """(name, expected, found), if all are as expected; an error that names the first one that isn't, otherwise."""
    wrong = F.concat(F.lit("not as expected: "), F.col("name"), F.lit(", found "), F.col("found").cast("string"))
    return facts.select("name", "expected", F.when(F.col("expected").eqNullSafe(F.col("found")), F.col("found")).otherwise(F.raise_error(wrong)).alias("found"))


def readiness(spark: SparkSession, paths: dict[str, str], settings: tuple[str, ...] = ()) -> DataFrame:
    """(item, ready): before a run, which of the named inputs are there and which settings have a value. Reads no data."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    rows = [(name, there(path)) for name, path in paths.items()] + [(s, bool(spark.conf.get(s, None))) for s in settings]
    return spark.createDataFrame(rows, "item string, ready boolean")


def rendered(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): each row as text of fixed widths, numbers to the right, null as a dash."""
    numbers = {c for c, t in rows.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    cells = [(F.lpad if c in numbers else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]
    return rows.select(F.concat_ws(" | ", *cells).alias("line"))


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines below the folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
