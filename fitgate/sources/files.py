"""Files as rows: whole files, their first bytes, and the check of a file by its header alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.functions import decide as dec
from fitgate.functions import prepared as prep
from fitgate.functions import registry as reg
from fitgate.operators import coded_headers, headers

# Bytes that a header check reads first, and the largest file that it reads whole.
HEAD_BYTES, WHOLE_BYTES = 256 * 1024, 16 * 1024**2


def read_files(spark: SparkSession, path: str, most: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, name, bytes, modified, content) of all files below a folder. A limit on the size is pushed into the scan, so
    the content of larger files is never read; nor is any content where the column is not used. Empty files give no rows:
    Spark's scans pass them over."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (scan.option("pathGlobFilter", pattern) if pattern else scan).load(path)
    if most is not None:
        files = files.where(F.col("length") <= most)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def with_headers(files: DataFrame, most: int = HEAD_BYTES) -> DataFrame:
    """``files`` with format, width, height (as seen), animated, file_dpi and header_error from the first ``most`` bytes of content."""
    head = files.withColumn("__head", F.substring("content", 1, most)).withColumn("__h", headers.header_facts(F.col("__head")))
    coded = coded_headers.coded_facts(F.col("__h.format"), F.col("__head"))
    both = head.withColumn("__c", coded)
    size = prep.display_size(F.coalesce("__c.width", "__h.width"), F.coalesce("__c.height", "__h.height"), F.col("__h.orientation"))
    known = F.col("__c.width").isNotNull()
    return both.select(
        *[f"`{c}`" for c in files.columns], F.col("__h.format").alias("format"), size["width"].alias("width"), size["height"].alias("height"),
        F.coalesce("__c.animated", "__h.animated").alias("animated"), F.col("__h.dpi").alias("file_dpi"), F.when(~known, F.col("__h.error")).alias("header_error"),
    )


def compatible_by_header(r: Callable[[str], Column]) -> Column:
    """Whether a row of with_headers(), with its ``mime``, fits the rules of a field for certain. False where only decoding can tell:
    files that are no images by name, headers that go on, and formats whose size the decoder settles if a size is asked for."""
    i = lambda n: F.col("file_dpi" if n == "dpi" else n)
    image = reg.is_image(reg.guess_format(F.col("name"), F.col("mime")))
    late = F.col("format").isin(*prep.SETTLED_BY_DECODER) & dec.has_dimension_rules(r)
    read = F.col("width").isNotNull() & F.col("header_error").isNull() & (F.col("bytes") > 0)
    return F.coalesce(image & read & ~late & (F.size(dec.issues(i, r)) == 0), F.lit(False))
