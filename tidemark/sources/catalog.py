"""What is known of a series, its readers beyond files of points, and where results go."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import workspace
from tidemark.sources import series as src

#: The driver of the database that comes with Spark.
DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


@dataclass(frozen=True)
class Metadata:
    """A series' sorted measures, its range [first, last) in milliseconds and its usual step, 0 if there is none."""

    header: tuple[str, ...]
    first: int
    last: int
    sampling: int

    def measure(self, index: int) -> str:
        """The measure that a workload calls by its place in the header."""
        return self.header[index]


def sampling(series: DataFrame) -> DataFrame:
    """(id, sampling): the gap between the first two points of different time of each measure; null without them.

    By two aggregates, the smallest time and the smallest one after it, instead
    of a sort of all points.
    """
    first = series.groupBy("id").agg(F.min("ts_ms").alias("first"))
    after = series.join(F.broadcast(first), "id").where(F.col("ts_ms") > F.col("first")).groupBy("id").agg(F.min("ts_ms").alias("second"))
    return first.join(after, "id", "left").select("id", (F.col("second") - F.col("first")).alias("sampling"))


def describe(series: DataFrame, step: int | None = None) -> Metadata:
    """The metadata of a series; step: its sampling interval, where the gap of the first two points of the first measure isn't it."""
    rows = sorted(src.metadata(series).collect(), key=lambda r: r["id"])  # one row for each measure
    if not rows:
        return Metadata((), 0, 0, step or 0)
    if step is None:
        found = sampling(series.where(F.col("id") == rows[0]["id"])).first()["sampling"]
        step = found or 0
    return Metadata(tuple(r["id"] for r in rows), min(r["first_ms"] for r in rows), max(r["last_ms"] for r in rows) + 1, step)


class MetadataStore:
    """Metadata by name of the series, in a JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _all(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def has(self, name: str) -> bool:
        return name in self._all()

    def get(self, name: str) -> Metadata:
        found = self._all()[name]
        return Metadata(**(found | {"header": tuple(found["header"])}))

    def save(self, name: str, metadata: Metadata) -> None:
        """Replaces the file as a whole, so that a reader never sees half of it."""
        kept = self._all() | {name: asdict(metadata)}
        fresh = self.path.with_suffix(".new")
        fresh.write_text(json.dumps(kept, indent=1, sort_keys=True))
        fresh.replace(self.path)

    def describe(self, name: str, series: DataFrame, step: int | None = None) -> Metadata:
        """The stored metadata, made and stored if it isn't there."""
        if not self.has(name):
            self.save(name, describe(series, step))
        return self.get(name)


def from_jdbc(
    spark: SparkSession, url: str, table: str, ts: str = "timestamp", measure: str = "id", value: str = "value", parts: int = 1, low: str | None = None, high: str | None = None, **options: str
) -> DataFrame:
    """A long table of a database as a series; with low and high it is read in `parts` ranges of its time column.

    Filters on ts and id reach the database.  options: user, password, driver
    and whatever else the reader takes.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if parts > 1 and low and high:
        reader = reader.option("partitionColumn", ts).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return src.from_long(reader.load(), ts, measure, value)


def to_jdbc(series: DataFrame, url: str, table: str, mode: str = "error", **options: str) -> None:
    """Writes (timestamp, id, value) to a table of a database."""
    rows = series.select(F.col("ts").alias("timestamp"), "id", "value")
    rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def to_derby(series: DataFrame, table: str, **options: str) -> str:
    """Writes (timestamp, id, value) to a table of a new embedded database; returns a URL under which all executors may read it at once.

    One process only may open such a database for writing, and Spark's writer
    opens it from the driver and from executors.  So executors write text to the
    shared folder, which the driver's Derby loads file by file.  Then the database
    becomes an archive there, which any number of processes may read.  The folder
    has to be mounted, as Derby reads files only.
    """
    spark = series.sparkSession
    place = urlparse(workspace.fresh(spark, "database"))
    if place.scheme not in ("", "file"):
        raise RuntimeError(f"an embedded database can't be in a folder of {place.scheme}: use to_jdbc() and a database with a server")
    path, jvm = unquote(place.path), spark._jvm
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    to_jdbc(series.limit(0), f"jdbc:derby:{path};create=true", table, driver=DERBY, **options)
    # Readers of databases take times to be of the process's zone.
    zone = jvm.java.util.TimeZone.getDefault().getID()
    at = F.date_format(F.convert_timezone(None, F.lit(zone), F.col("ts").cast("timestamp").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = workspace.fresh(spark, "rows")
    series.select(at.alias("timestamp"), "id", "value").write.option("escape", '"').csv(text)
    db = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{path}")
    load = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
    for part in sorted(Path(unquote(urlparse(text).path)).glob("part-*")):
        load.setString(1, table.upper())
        load.setString(2, str(part))
        load.execute()
    db.close()
    try:
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{path};shutdown=true")
    except Py4JJavaError as e:  # what Derby always answers
        if e.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(f"{path}.jar", "w", zipfile.ZIP_STORED) as archive:
        for p in sorted(Path(path).rglob("*")):
            archive.write(p, f"db/{p.relative_to(path)}")
    shutil.rmtree(path)
    shutil.rmtree(unquote(urlparse(text).path))
    return f"jdbc:derby:jar:({path}.jar)db"


def wide(points: DataFrame, header: Sequence[str]) -> DataFrame:
    """(timestamp, a column for each measure of the header) of points (ts_ms, id, value); the smallest value where a time has several."""
    return points.groupBy(F.col("ts_ms").alias("timestamp")).pivot("id", list(header)).agg(F.min("value"))


def wide_rows(points: DataFrame, header: Sequence[str]) -> DataFrame:
    """wide() of all points: a time has as many rows as its commonest measure has points, and the smallest of each measure share the first."""
    nth = F.row_number().over(Window.partitionBy("ts_ms", "id").orderBy("value"))
    return points.withColumn("nth", nth).groupBy(F.col("ts_ms").alias("timestamp"), "nth").pivot("id", list(header)).agg(F.first("value")).drop("nth")


def to_csv(points: DataFrame, header: Sequence[str], path: str) -> None:
    """Points of all measures as one wide CSV table, in the order of time."""
    wide(points, header).orderBy("timestamp").write.option("header", True).mode("overwrite").csv(path)


def to_csv_by_measure(points: DataFrame, path: str) -> None:
    """A folder of CSV files for each measure."""
    rows = points.select(F.col("ts_ms").alias("timestamp"), "value", "id").repartition("id").sortWithinPartitions("id", "timestamp")
    rows.write.partitionBy("id").option("header", True).mode("overwrite").csv(path)


def match_lines(found: DataFrame, unit: int, origin: int = 0) -> DataFrame:
    """(id, b, line) of matches (id, b, to, lens): a text for each, with the range of every segment in milliseconds."""
    lens = F.transform(F.split("lens", "-"), lambda x: x.cast("bigint"))
    at = F.transform(lens, lambda x, i: F.aggregate(F.slice(lens, F.lit(1), i), F.col("b"), lambda a, k: a + k))
    ms = lambda x: (x * unit + origin).cast("string")
    each = F.zip_with(at, lens, lambda a, k: F.concat(ms(a), F.lit(".."), ms(a + k)))
    return found.select("id", "b", F.concat_ws(" ", "id", F.concat(ms(F.col("b")), F.lit(".."), ms(F.col("to"))), F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))).alias("line"))


def to_match_log(found: DataFrame, unit: int, path: str, origin: int = 0) -> None:
    """Matches as lines of text, by measure and start."""
    match_lines(found, unit, origin).orderBy("id", "b").select("line").write.mode("overwrite").text(path)


#: Columns of to_metrics_csv(), in order: query and its view, what it took, and how its refinement went.
METRICS = (
    "dataset", "query", "width", "height", "low", "high", "query_type", "init_seconds", "seconds", "fetched_bytes", "hit_ratio", "cache_bytes",
    "accuracy", "initial_factor", "final_factor", "refined", "fallback", "error_before", "error_after", "ambiguous_after",
)


def metrics_frame(spark: SparkSession, rows: Iterable[dict], **fixed) -> DataFrame:
    """METRICS of queries, from engine.metrics_rows(); fixed: values that are the same in all rows."""
    texts, flags = {"dataset", "query_type"}, {"refined", "fallback"}
    real = {"init_seconds", "seconds", "hit_ratio", "accuracy", "error_before", "error_after"}
    kind = lambda c: "string" if c in texts else "boolean" if c in flags else "double" if c in real else "bigint"
    cast = {"string": str, "boolean": bool, "double": float, "bigint": int}
    value = lambda r, c: None if (x := (fixed | r).get(c)) is None else cast[kind(c)](x)
    return spark.createDataFrame([tuple(value(r, c) for c in METRICS) for r in rows], ", ".join(f"{c} {kind(c)}" for c in METRICS))


def to_metrics_csv(spark: SparkSession, rows: Iterable[dict], path: str, **fixed) -> None:
    metrics_frame(spark, rows, **fixed).orderBy("query").write.option("header", True).mode("overwrite").csv(path)


def bound_rows(bounds: DataFrame, query: int, factor: int, unit: int, length: int, origin: int = 0) -> DataFrame:
    """Bounds (id, b, lo, hi, defined) as a table of their widths, a row for each window."""
    low = F.col("b") * unit + origin
    return bounds.select(
        F.lit(query).alias("query"), F.lit(factor).alias("factor"), "id", "b", low.alias("low"), (low + length * unit).alias("high"),
        F.col("lo").alias("min_angle"), F.col("hi").alias("max_angle"), (F.col("hi") - F.col("lo")).alias("width"), (~F.col("defined")).alias("undefined"),
    )


def to_bounds_csv(bounds: DataFrame, path: str, query: int, factor: int, unit: int, length: int, origin: int = 0) -> None:
    bound_rows(bounds, query, factor, unit, length, origin).write.option("header", True).mode("append").csv(path)
