"""Event tables for the stateful streams, derived from the documents by integer arithmetic, so that any engine makes the same rows.

page_events: what happens on pages with upload forms. broker_events: messages to the one process that
hands out tokens and tracks jobs. job_events: starts, progress and ends of jobs. For each the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of this selection need no preparation.
READY = 2
START_US = 1_700_000_000_000_000
_HASH = "(doc_id * 2654435761) % 4294967296"


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("event_id")).where("event_id is not null")
    return d.withColumn("h", (F.col("event_id") * 2654435761) % 4294967296), F.col("event_id")


def _bits(at: int, among: int) -> Column:
    """A number below ``among`` from the hash."""
    return F.floor(F.col("h") / at).cast("long") % among


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, us, page, form, input, kind, files): 4 inputs a form, 4 forms a page."""
    d, i = _ids(spark, sf_dir)
    r = _bits(128, 20)
    kind = F.when(r < 5, "input").when(r < 10, "change").when(r < 15, "done").when(r < 17, "submit").when(r == 17, "removed").when(r == 18, "submit")
    kind = kind.when(_bits(4096, 4) == 0, "pagehide").otherwise("done")
    files = F.floor(_bits(65536, 5) / 2).cast("long")
    form = F.floor(i / 64).cast("long")
    return d.select("event_id", (F.lit(START_US) + i * 1_000_000).alias("us"), F.floor(i / 256).cast("long").alias("page"), form.alias("form"), (form * 4 + _bits(8, 4)).alias("input"), kind.alias("kind"), files.alias("files"))


PAGE_EVENTS = f"""hashed AS (SELECT doc_id AS event_id, {_HASH} AS h FROM documents WHERE doc_id IS NOT NULL),
  page_events AS (SELECT event_id, {START_US} + event_id * 1000000 AS us, event_id // 256 AS page, event_id // 64 AS form, event_id // 64 * 4 + h // 8 % 4 AS input,
  CASE WHEN h // 128 % 20 < 5 THEN 'input' WHEN h // 128 % 20 < 10 THEN 'change' WHEN h // 128 % 20 < 15 THEN 'done' WHEN h // 128 % 20 IN (15, 16, 18) THEN 'submit'
    WHEN h // 128 % 20 = 17 THEN 'removed' WHEN h // 4096 % 4 = 0 THEN 'pagehide' ELSE 'done' END AS kind, h // 65536 % 5 // 2 AS files FROM hashed)"""


def settings_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, us, host) and changes of a host's settings (event_id, us, host, enabled, ask); there are three hosts."""
    d, i = _ids(spark, sf_dir)
    rows = d.withColumn("us", F.lit(START_US) + i * 1_000_000).withColumn("host", F.floor(i / 256).cast("long") % 3)
    change = _bits(128, 20) == 17
    changes = rows.where(change).select("event_id", "us", "host", (_bits(4096, 3) != 0).alias("enabled"), (_bits(16384, 2) == 0).alias("ask"))
    return rows.where(~change).select("event_id", "us", "host"), changes


SETTINGS_FEED = f"""hashed AS (SELECT doc_id AS event_id, {START_US} + doc_id * 1000000 AS us, doc_id // 256 % 3 AS host, {_HASH} AS h FROM documents WHERE doc_id IS NOT NULL),
  changes AS (SELECT event_id, us, host, h // 4096 % 3 <> 0 AS enabled, h // 16384 % 2 = 0 AS ask FROM hashed WHERE h // 128 % 20 = 17),
  visits AS (SELECT event_id, us, host FROM hashed WHERE h // 128 % 20 <> 17)"""


def broker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, us, profile, kind, subject, frame): every other profile asks for many tokens."""
    d, i = _ids(spark, sf_dir)
    r, profile = _bits(128, 20), F.floor(i / 256).cast("long")
    busy = F.when(r < 18, "token").otherwise("verify")
    mixed = F.when(r < 4, "token").when(r < 8, "verify").when(r < 14, "prepare").when(r < 17, "finish").otherwise("cancel")
    kind = F.when(profile % 2 == 0, busy).otherwise(mixed)
    subject = F.when(kind == "token", i).when(kind == "verify", i - 1 - _bits(65536, 40)).otherwise(_bits(65536, 12))
    return d.select("event_id", (F.lit(START_US) + i * 400_000).alias("us"), profile.alias("profile"), kind.alias("kind"), subject.alias("subject"), _bits(4096, 3).alias("frame"))


BROKER_EVENTS = f"""hashed AS (SELECT doc_id AS event_id, {_HASH} AS h FROM documents WHERE doc_id IS NOT NULL),
  kinds AS (SELECT event_id, h, event_id // 256 AS profile, CASE WHEN event_id // 256 % 2 = 0 THEN CASE WHEN h // 128 % 20 < 18 THEN 'token' ELSE 'verify' END
    WHEN h // 128 % 20 < 4 THEN 'token' WHEN h // 128 % 20 < 8 THEN 'verify' WHEN h // 128 % 20 < 14 THEN 'prepare' WHEN h // 128 % 20 < 17 THEN 'finish' ELSE 'cancel' END AS kind FROM hashed),
  broker_events AS (SELECT event_id, {START_US} + event_id * 400000 AS us, profile, kind,
    CASE kind WHEN 'token' THEN event_id WHEN 'verify' THEN event_id - 1 - h // 65536 % 40 ELSE h // 65536 % 12 END AS subject, h // 4096 % 3 AS frame FROM kinds)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, us, job, kind, fraction): 64 events a job, some of them 2 and most of them 40 milliseconds apart; fraction in thousandths."""
    d, i = _ids(spark, sf_dir)
    job, at = F.floor(i / 64).cast("long"), i % 64
    last = 1 + (job * 7919) % 63  # some jobs have ended long before their last event
    kind = F.when(at == 0, "start").when(at == last, "finish").when(at < last, "progress").otherwise("after")
    us = F.lit(START_US) + job * 3_000_000 + at * F.when(job % 4 == 0, 2_000).otherwise(40_000)
    return d.select("event_id", us.alias("us"), job.alias("job"), kind.alias("kind"), (at * 16 + _bits(128, 15)).alias("fraction"))


JOB_EVENTS = f"""hashed AS (SELECT doc_id AS event_id, {_HASH} AS h, doc_id // 64 AS job, doc_id % 64 AS k, 1 + (doc_id // 64 * 7919) % 63 AS last FROM documents WHERE doc_id IS NOT NULL),
  job_events AS (SELECT event_id, {START_US} + job * 3000000 + k * CASE WHEN job % 4 = 0 THEN 2000 ELSE 40000 END AS us, job,
    CASE WHEN k = 0 THEN 'start' WHEN k = last THEN 'finish' WHEN k < last THEN 'progress' ELSE 'after' END AS kind, k * 16 + h // 128 % 15 AS fraction FROM hashed)"""
