"""As-of join: for each event the version of its key that was in force, without a task that holds all of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgate.session import shared_folder

ROWS_PER_RANGE = 1_000_000


def as_of(events: DataFrame, versions: DataFrame, by: str, at: str, columns: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """events with ``columns`` of the latest version of the same key ``by`` that is no later than the event; NULL where there is none.

    Both sides are cut together into ranges of (key, time) of about equal size, so a key with most of
    the rows lies in many ranges. Within a range the last version before an event is a window over the rows of a key;
    what a range needs from those before it is one version for each of its keys, carried over by a window over one row for each key and range.
    Of versions of one key and time the greatest counts. Events without key or time keep their row and get NULL; such versions count for nothing.
    """
    spark = events.sparkSession
    value = F.struct(*columns)
    left = events.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__e"))
    right = versions.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(0).alias("__side"), value.alias("__v"))
    rows = left.unionByName(right, allowMissingColumns=True)
    ranges = max(1, -(-(events.count() + versions.count()) // rows_per_range))
    if ranges > 1:
        rows = rows.repartitionByRange(ranges, "__by", "__at", "__side")
        # written, so that each row stays in its range
        path = shared_folder(spark, "asof")
        rows.withColumn("__range", F.spark_partition_id()).write.parquet(path)
        rows = spark.read.parquet(path)
    else:
        rows = rows.withColumn("__range", F.lit(0))
    before = Window.partitionBy("__range", "__by").orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__found", F.last("__v", ignorenulls=True).over(before)).where("__side = 1")
    if ranges > 1:
        ends = rows.groupBy("__by", "__range").agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__v"))).alias("__end"))
        earlier = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)["__v"]).where("__carried is not null and __by is not null").select("__by", "__range", "__carried")
        local = local.join(carried, ["__by", "__range"], "left").withColumn("__found", F.coalesce("__found", "__carried"))
    return local.select("__e.*", *[F.col(f"__found.{c}").alias(c) for c in columns])
