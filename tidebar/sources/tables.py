"""The stored tables: schemas, creation, append, upsert, clearing, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidebar import settings
from tidebar.operators.versions import upsert
from tidebar.session import staged


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _schema(text: str) -> T.StructType:
    """``"name type, name type"``; unlike the DDL parser it needs no session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_PER_HORIZON = ", ".join(
    f"{name}_{h} double"
    for name in ("predicted_price", "error", "percent_error")
    for h in settings.HORIZONS
)

SCHEMAS: dict[str, T.StructType] = {
    "bars": _schema("asset string, datetime timestamp_ntz, price double, market_cap double, volume double"),
    "markets": _schema(
        "datetime timestamp_ntz, symbol string, Open double, High double, Low double, Close double, Volume double"
    ),
    "economic": _schema("datetime timestamp_ntz, indicator string, value double"),
    "predictions": _schema(
        "prediction_id string, asset string, horizon string, predicted_price double, confidence double, "
        "target_timestamp timestamp_ntz, created_at timestamp_ntz, actual_price double"
    ),
    "evaluations": _schema(
        "prediction_id string, asset string, horizon string, predicted_price double, actual_price double, "
        "absolute_error double, percent_error double, squared_error double, direction_predicted int, "
        "direction_actual int, direction_correct int, prediction_timestamp timestamp_ntz, "
        "evaluation_timestamp timestamp_ntz, target_timestamp timestamp_ntz, confidence double"
    ),
    "actual_prices": _schema(
        "asset string, target_timestamp timestamp_ntz, actual_price double, collected_at timestamp_ntz"
    ),
    "accuracy_summary": _schema(
        "asset string, horizon string, period_start timestamp_ntz, period_end timestamp_ntz, "
        "total_predictions long, mean_absolute_error double, mean_percent_error double, "
        "root_mean_squared_error double, direction_accuracy double, median_absolute_error double, "
        "std_percent_error double"
    ),
    "models": _schema(
        "asset string, horizon string, version long, state string, trained_at timestamp_ntz, training_window string, "
        "training_days int, training_samples long, expected_error double, train_mse double, train_mae double, "
        "train_accuracy double, cv_mse_mean double, cv_mse_std double, cv_accuracy_mean double, cv_accuracy_std double, "
        "minority_share double, features array<string>, chosen array<string>, weights array<double>, intercept double, "
        "up_weights array<double>, up_intercept double, majority int"
    ),
    "timeseries": _schema(f"asset string, timestamp timestamp_ntz, actual_price double, {_PER_HORIZON}"),
    # One row per series, kept up to date by what is appended and tracked.
    "newest_prices": _schema("asset string, datetime timestamp_ntz, price double"),
    "tracked_series": _schema("asset string, tracked_since timestamp_ntz"),
}
KEYS = {"actual_prices": ("asset", "target_timestamp"), "timeseries": ("asset", "timestamp")}
# Tables in folders by day, and the time that the day is taken from.
DAYS = {
    "bars": "datetime", "predictions": "created_at", "evaluations": "evaluation_timestamp",
    "actual_prices": "target_timestamp", "timeseries": "timestamp",
}
PREDICTION_TABLES = ("predictions", "evaluations", "actual_prices", "accuracy_summary", "timeseries")
MARKET_TABLES = ("bars", "markets", "economic")


class Store:
    """Parquet tables below one root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _write(self, table: str, rows: DataFrame, mode: str, only_days: bool = False) -> None:
        if table not in DAYS:
            rows.write.mode(mode).parquet(self.path(table))
            return
        # Rows of a day go together, so that a day is few files; adaptive execution splits a large day.
        rows = rows.withColumn("_day", F.to_date(DAYS[table])).hint("rebalance", "_day")
        writer = rows.write.mode(mode).partitionBy("_day")
        writer.option("partitionOverwriteMode", "dynamic" if only_days else "static").parquet(self.path(table))

    def ensure(self) -> "Store":
        """Create the folders of tables that do not exist yet; a folder without files is an
        empty table."""
        for table in SCHEMAS:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return self

    def _stored(self, table: str) -> DataFrame:
        schema = SCHEMAS[table]
        if table in DAYS:
            schema = T.StructType([*schema.fields, T.StructField("_day", T.DateType())])
        return self.spark.read.schema(schema).parquet(self.path(table))

    def read(self, table: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """The table, or its rows from ``since`` to ``until`` (both included): only the
        folders of those days are read. Rows without a time are in no such range."""
        rows = self._stored(table)
        if since is not None:
            rows = rows.where((F.col("_day") >= F.to_date(since)) & (F.col(DAYS[table]) >= since))
        if until is not None:
            rows = rows.where((F.col("_day") <= F.to_date(until)) & (F.col(DAYS[table]) <= until))
        return rows.select(*SCHEMAS[table].fieldNames())

    def lookback(self, table: str, as_of: Column, days: int) -> DataFrame:
        """The rows of the last days before ``as_of``."""
        return self.read(table, as_of - F.expr(f"INTERVAL '{days}' DAY"), as_of)

    def _conformed(self, table: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SCHEMAS[table]
            ]
        )

    def append(self, table: str, rows: DataFrame) -> None:
        rows = self._conformed(table, rows)
        if table == "bars":
            rows = staged(rows, "new-bars")  # read twice
        self._write(table, rows, "append")
        if table == "bars":
            self._keep_newest(rows)

    def _keep_newest(self, bars: DataFrame) -> None:
        """The newest price of each series; equally new ones: the one that was there."""
        own = self.read("newest_prices").withColumn("_old", F.lit(1))
        new = bars.where("asset is not null and datetime is not null").select("asset", "datetime", "price", F.lit(0).alias("_old"))
        best = F.max_by(F.struct("datetime", "price"), F.struct("datetime", "_old", "price"))
        kept = own.unionByName(new).groupBy("asset").agg(best.alias("_r")).select("asset", "_r.*")
        self._write("newest_prices", staged(kept, "newest-prices"), "overwrite")

    def keep_tracked(self, observed: DataFrame) -> DataFrame:
        """When each series was first tracked, with (asset, timestamp) rows added."""
        new = observed.select("asset", F.col("timestamp").alias("tracked_since"))
        kept = self.read("tracked_series").unionByName(new).groupBy("asset").agg(F.min("tracked_since").alias("tracked_since"))
        kept = staged(kept, "tracked-series")
        self._write("tracked_series", kept, "overwrite")
        return kept

    def reindex(self) -> None:
        """Make the two tables of one row per series anew from the whole tables, as after a
        write that was broken off."""
        for table in ("newest_prices", "tracked_series"):
            self._write(table, self.spark.createDataFrame([], SCHEMAS[table]), "overwrite")
        self._keep_newest(self.read("bars"))
        self.keep_tracked(self.read("timeseries"))

    def prices_at(self, as_of: Column, days: int = 7) -> DataFrame:
        """The newest price of every series at ``as_of``: asset, price, datetime.

        From the table of newest prices; series that have later bars (a replay) are looked
        up among the bars of the last days, and what then is left among all earlier ones.
        """
        newest = self.read("newest_prices")
        now = newest.where(F.col("datetime") <= as_of)
        left = newest.where(F.col("datetime") > as_of).select("asset")
        start = as_of - F.expr(f"INTERVAL '{days}' DAY")
        for since, until in ((start, as_of), (None, start)):
            if left.isEmpty():
                break
            bars = self.read("bars", since, until).where("datetime is not null").join(left, "asset", "left_semi")
            found = bars.groupBy("asset").agg(F.max("datetime").alias("datetime"), F.max_by("price", F.struct("datetime", "price")).alias("price"))
            found = staged(found, "replayed-prices")
            now, left = now.unionByName(found), left.join(found, "asset", "left_anti")
        return now.select("asset", "price", "datetime")

    def upsert(self, table: str, rows: DataFrame, version: Sequence[str] = ()) -> None:
        """Insert or replace by the table's key; the last of equal versions wins.

        Keyed tables are partitioned by the day of their key, and only the days that
        occur in ``rows`` are read and rewritten.
        """
        changes = staged(self._conformed(table, rows), f"changes-{table}")
        # One entry per day: small, however many rows there are.
        days = [r[0] for r in changes.select(F.to_date(DAYS[table])).distinct().collect()]
        touched = self._stored(table).where(F.col("_day").isin(days)).drop("_day")
        # The result reads files that it replaces, so it is written elsewhere first.
        merged = staged(upsert(touched, changes, KEYS[table], list(version)), f"new-{table}")
        self._write(table, merged, "overwrite", only_days=True)

    def counts(self, tables: Sequence[str] = PREDICTION_TABLES + MARKET_TABLES) -> DataFrame:
        out = None
        for table in tables:
            one = self.read(table).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table_name"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def clear_predictions(self, confirm: bool = False) -> DataFrame:
        """Empty the prediction tables, keep the market tables; give the counts before
        and after."""
        if not confirm:
            raise ValueError("clearing predictions needs confirm=True")
        before = staged(self.counts().withColumnRenamed("rows", "rows_before"), "counts")
        for table in (*PREDICTION_TABLES, "tracked_series"):
            self._write(table, self.spark.createDataFrame([], SCHEMAS[table]), "overwrite")
        return before.join(self.counts().withColumnRenamed("rows", "rows_after"), "table_name")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(report: DataFrame, path: str, order: Sequence[str] = ("asset", "position")) -> None:
    """A report as text, one line per row and in order. Reports are small tables."""
    report.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)
