"""Upload events as a stream: each micro-batch resolves its events against all jobs of earlier ones; another works jobs off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.jobs.uploads import claim_batch, finish_jobs, new_job_rows, resolve_uploads, upsert_jobs
from veilframe.sources.store import JOB_SCHEMA, kept, scratch


def submit_batch(events: DataFrame, batch_id: int, jobs_path: str, log_path: str) -> None:
    """Resolve one batch: its new jobs go to jobs_path/batch=<id>, what each event got to log_path/batch=<id>.

    A batch sees the jobs of batches before it and overwrites only its own folders, so a replay changes nothing. What it
    keeps between its steps is deleted at its end.
    """
    spark = events.sparkSession
    with scratch(spark):
        events = kept(events)
        empty = spark.createDataFrame([], JOB_SCHEMA + ", batch long").write
        empty.mode("append").partitionBy("batch").parquet(jobs_path)
        jobs = spark.read.schema(JOB_SCHEMA + ", batch long").parquet(jobs_path).filter(F.col("batch") < batch_id).drop("batch")
        resolved = kept(resolve_uploads(events, jobs))
        made = events.join(resolved.filter("action = 'create'").select("event_seq"), "event_seq", "left_semi")
        new_job_rows(made, resolved, F.current_timestamp()).write.mode("overwrite").parquet(f"{jobs_path}/batch={batch_id}")
        resolved.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")


def submit_stream(events: DataFrame, jobs_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Run submit_batch on a stream of events (event_seq, upload_id, content_fp, config_hash, input_path) until it is used up."""
    writer = events.writeStream.foreachBatch(lambda df, batch_id: submit_batch(df, batch_id, jobs_path, log_path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_batch(jobs: DataFrame, n: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The job table after the n oldest queued jobs are claimed, run and finished.

    run takes the claimed jobs and returns them with metrics_json or, where a job failed, error: both as finish_jobs
    reads them. A claimed job that run leaves out stays in processing.
    """
    now = F.current_timestamp()
    claimed = kept(claim_batch(jobs, n).withColumn("updated_at", now))
    done = finish_jobs(run(claimed)).withColumn("updated_at", now)
    return upsert_jobs(upsert_jobs(jobs, claimed), done)


def work_stream(ticks: DataFrame, jobs_path: str, n: int, run: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of ticks, work n jobs of the table at jobs_path/batch=<last> off; the table after it is batch=<id + 1>.

    Table 0 is the caller's. A replayed batch starts from the same table again, and overwrites its own.
    """

    def work(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        with scratch(spark):
            jobs = spark.read.schema(JOB_SCHEMA).parquet(f"{jobs_path}/batch={batch_id}")
            work_batch(jobs, n, run).write.mode("overwrite").parquet(f"{jobs_path}/batch={batch_id + 1}")

    return ticks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
