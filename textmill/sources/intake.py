"""Files handed in: which are taken, to which job they belong, and what a job may be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored_name(job_id: Column, name: Column) -> Column:
    """The name that a file is kept under: its job and the last part of what it was called."""
    return F.concat(job_id, F.lit("_"), F.element_at(F.split(name, r"[/\\]"), -1))


def taken(files: DataFrame, folder: str) -> DataFrame:
    """(path, length) -> the same with job_id, name and reason, which is null for files that are taken.

    Taken are non-empty PDF files of the folder itself or below it, without ``..`` in their path, whose name begins with
    a job of 12 hexadecimal digits.
    """
    root = folder.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"\A(?:file|dbfs|hdfs|viewfs|s3a?):(?://[^/]*)?", "")
    last = F.element_at(F.split(plain, "/"), -1)
    named = F.regexp_extract(last, r"\A([0-9a-f]{12})_(.+)\z", 1)
    reason = (
        F.when(~F.startswith(plain, F.lit(root)) | plain.rlike(r"(\A|/)\.\.(/|\z)"), "outside")
        .when(~F.lower(last).endswith(".pdf"), "not_a_pdf")
        .when(F.coalesce("length", F.lit(0)) <= 0, "empty")
        .when(named == "", "no_job")
    )
    return files.withColumn("job_id", F.nullif(named, F.lit(""))).withColumn("name", F.when(named != "", F.regexp_extract(last, r"\A[0-9a-f]{12}_(.+)\z", 1)).otherwise(last)).withColumn("reason", reason)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that arrive in a folder and are taken: path, length, job_id, name, content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return taken(files, folder).where("reason IS NULL").select("path", "length", "job_id", "name", "content")


def job_runs(asked: DataFrame) -> DataFrame:
    """(job, seq, event) -> the same with answer and state, by the order of each job's events.

    A job is started once; a second start is a conflict.  It runs until the first of ``done``, ``error`` and ``cancel`` after its
    start; what comes before the start is missing, what comes after its end is ignored.
    """
    whole = Window.partitionBy("job")
    started = F.min(F.when(F.col("event") == "start", F.col("seq"))).over(whole)
    rows = asked.withColumn("__start", started)
    over = F.col("event").isin("done", "error", "cancel") & (F.col("seq") > F.col("__start"))
    rows = rows.withColumn("__end", F.min(F.when(over, F.struct("seq", "event"))).over(whole))
    before, first = F.col("__start").isNull() | (F.col("seq") < F.col("__start")), F.col("seq") == F.col("__start")
    ended = F.col("seq") >= F.col("__end.seq")
    answer = F.when(before, "missing").when(first, "accepted").when(F.col("event") == "start", "conflict").when(F.col("seq") == F.col("__end.seq"), "accepted").when(ended, "ignored").otherwise("accepted")
    last = F.when(F.col("__end.event") == "cancel", "cancelled").otherwise(F.col("__end.event"))
    state = F.when(before, "idle").when(ended, last).otherwise("running")
    return rows.withColumn("answer", answer).withColumn("state", state).drop("__start", "__end")
