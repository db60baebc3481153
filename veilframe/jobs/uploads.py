"""Upload events and jobs: which events reuse a job, which create one, and how job rows change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.components import components
from veilframe.sources.store import dealt_by, kept

LIVE = ("queued", "processing", "completed", "needs_review")
#: Rounds of in-batch decisions before the ordered pass, and most events of a configuration that go through one as they are.
ROUNDS, MOST_IN_ORDER = 6, 1_000_000


def content_fingerprint(df: DataFrame, content: str = "content", size: str | None = None, chunk: int = 1 << 20) -> Column:
    """SHA-256 of a file's size in digits and its first chunk, and of a middle and the last chunk if it has over two."""
    body = F.col(content)
    n = F.length(body) if size is None else F.col(size)

    def part(at: Column) -> Column:
        return F.substring(body, (at + 1).cast("int"), F.lit(chunk))

    head = F.concat(n.cast("string").cast("binary"), part(F.lit(0)))
    long_ = F.concat(head, part(F.floor(n / 2)), part(F.greatest(F.lit(0), n - chunk)))
    return F.sha2(F.when(n > 2 * chunk, long_).otherwise(head), 256)


def upload_name() -> Column:
    """An event's upload_id; where it is null or empty, a name from its content."""
    return F.coalesce(F.nullif("upload_id", F.lit("")), F.concat(F.lit("upload-"), F.substring("content_fp", 1, 16)))


def latest_by_fingerprint(jobs: DataFrame) -> DataFrame:
    """Of each (content_fp, config_hash), the newest job that has not failed; ties by job_id."""
    order = Window.partitionBy("content_fp", "config_hash").orderBy(F.desc("created_at"), "job_id")
    live = jobs.filter(F.col("status").isin(*LIVE))
    return live.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def _in_order(events: DataFrame) -> DataFrame:
    """event_seq of the creators among events (cell, event_seq, upload_id, content_fp), which share keys within a cell alone.

    A cell's events stream through a task by event_seq; what it holds are the keys that are taken, not the events.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, uploads, contents = None, set(), set()
        for batch in batches:
            out = []
            for own, seq, upload, content in batch[["cell", "event_seq", "upload_id", "content_fp"]].itertuples(index=False, name=None):
                if own != cell:
                    cell, uploads, contents = own, set(), set()
                if upload not in uploads and content not in contents:
                    uploads.add(upload)
                    contents.add(content)
                    out.append(seq)
            yield pd.DataFrame({"event_seq": pd.Series(out, dtype="int64")})

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_by(events, "cell", parts=n).sortWithinPartitions("cell", "event_seq").mapInPandas(take, "event_seq long")


def creators(events: DataFrame, rounds: int = ROUNDS, most: int = MOST_IN_ORDER) -> DataFrame:
    """event_seq of the events that create a job, as if taken in order: no earlier creator has the upload or the content.

    In a round, an undecided event that comes first of its upload and first of its content creates; all others that
    share a key with it are reuse. Repeats of both keys are left out beforehand, so no hot pair meets in one task.
    A few rounds decide nearly all. Long alternating chains, which would take a round for every two events, are left to
    one ordered pass over each configuration's rest, or over each connected component of its keys where that rest has
    more than `most` events.
    """
    keys = ["event_seq", "upload_id", "content_fp", "config_hash"]
    left = kept(events.groupBy("upload_id", "content_fp", "config_hash").agg(F.min("event_seq").alias("event_seq")))
    found = None
    for _ in range(rounds):
        by_upload, by_content = Window.partitionBy("upload_id", "config_hash"), Window.partitionBy("content_fp", "config_hash")
        marked = left.withColumn("u", F.min("event_seq").over(by_upload)).withColumn("c", F.min("event_seq").over(by_content))
        new = kept(marked.withColumn("makes", (F.col("event_seq") == F.col("u")) & (F.col("event_seq") == F.col("c"))).drop("u", "c"))
        made = new.filter("makes").select(*keys)
        found = made if found is None else found.unionByName(made)
        rest = new.filter("not makes").drop("makes")
        for key in ("upload_id", "content_fp"):
            rest = rest.join(made.select(key, "config_hash"), [key, "config_hash"], "left_anti")
        left = kept(rest.select(*keys))
        if left.isEmpty():
            return found.select("event_seq")
    many = kept(left.groupBy("config_hash").count().filter(F.col("count") > most).select("config_hash"))
    cells = left.join(many, "config_hash", "left_anti").withColumn("cell", F.col("config_hash"))
    if not many.isEmpty():
        large = left.join(many, "config_hash")
        nodes = [F.sha2(F.concat_ws("|", F.lit(k), "config_hash", k), 256).alias(side) for k, side in (("upload_id", "a"), ("content_fp", "b"))]
        roots = components(large.select(*nodes))
        of_upload = large.withColumn("node", F.sha2(F.concat_ws("|", F.lit("upload_id"), "config_hash", "upload_id"), 256))
        whole = of_upload.join(roots, "node", "left").withColumn("cell", F.coalesce("root", "node")).select(*keys, "cell")
        cells = cells.unionByName(whole)
    rest = kept(_in_order(cells))
    return rest if found is None else found.select("event_seq").unionByName(rest)


def resolve_uploads(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """event_seq, action (reuse_upload, reuse_content or create) and job_id for each event, as if taken in order.

    An event reuses the job of its upload_id and configuration whatever its status, else the newest job of its content
    and configuration that has not failed, and else creates one. Reuse by content does not register the upload_id.
    """
    key = ["config_hash"]
    events = events.select("event_seq", upload_name().alias("upload_id"), "content_fp", "config_hash")
    same_upload = jobs.select("upload_id", "config_hash", F.col("job_id").alias("job_u"))
    same_content = latest_by_fingerprint(jobs).select("content_fp", "config_hash", F.col("job_id").alias("job_c"))
    known = kept(events.join(same_upload, ["upload_id", *key], "left").join(same_content, ["content_fp", *key], "left"))
    done = known.filter("job_u is not null").select("event_seq", F.lit("reuse_upload").alias("action"), F.col("job_u").alias("job_id"))
    open_ = known.filter("job_u is null").drop("job_u")
    fresh = kept(open_.filter("job_c is null").drop("job_c"))
    made = kept(fresh.join(creators(fresh), "event_seq").withColumn("job_id", F.substring(F.sha2(F.concat_ws("|", "upload_id", "config_hash", "event_seq"), 256), 1, 32)))
    ups = made.select("upload_id", "config_hash", F.col("event_seq").alias("seq_u"), F.col("job_id").alias("new_u"))
    contents = made.select("content_fp", "config_hash", F.col("job_id").alias("new_c"))
    # content of a job that was there before has no creator among the events, so at most one of job_c and new_c is set
    both = open_.join(ups, ["upload_id", *key], "left").join(contents, ["content_fp", *key], "left")
    mine, earlier = F.col("seq_u") == F.col("event_seq"), F.col("seq_u") < F.col("event_seq")
    action = F.when(mine, "create").when(earlier, "reuse_upload").otherwise("reuse_content")
    job = F.when(mine | earlier, F.col("new_u")).otherwise(F.coalesce("job_c", "new_c"))
    return done.unionByName(both.select("event_seq", action.alias("action"), job.alias("job_id")))


def new_job_rows(events: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Rows of the job table for the events that create one."""
    made = events.join(resolved.filter("action = 'create'").select("event_seq", "job_id"), "event_seq")
    upload = upload_name()
    text = F.lit(None).cast("string")
    return made.select(
        "job_id", upload.alias("upload_id"), "content_fp", "config_hash", "input_path", F.concat(F.lit("outputs/"), "job_id", F.lit("/redacted.mp4")).alias("output_path"),
        F.lit("queued").alias("status"), text.alias("qc_status"), text.alias("error"), now.alias("created_at"), now.alias("updated_at"), text.alias("metrics_json"),
    )


def apply_status_updates(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """jobs with partial updates (job_id, seq, status, qc_status, error, metrics_json, clear_error): the last value of each column wins.

    A null changes nothing; clear_error sets error to null. updated_at becomes now where anything was sent.
    """
    columns = ["status", "qc_status", "metrics_json"]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in columns]
    touched = F.when(F.col("error").isNotNull() | F.col("clear_error"), F.col("seq"))
    error = F.max_by(F.struct(F.when(~F.coalesce("clear_error", F.lit(False)), F.col("error")).alias("value")), touched).alias("new_error")
    changes = updates.groupBy("job_id").agg(*last, error)
    rows = jobs.join(changes.withColumn("sent", F.lit(True)), "job_id", "left")
    out = {c: F.coalesce(f"new_{c}", c) for c in columns if c in jobs.columns}
    out["error"] = F.when(F.col("new_error").isNotNull(), F.col("new_error.value")).otherwise(F.col("error"))
    out["updated_at"] = F.when(F.col("sent"), now).otherwise(F.col("updated_at"))
    return rows.withColumns(out).select(*jobs.columns)


def claim_batch(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest queued jobs, now processing: a top-k, not a sort of the table."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "job_id").limit(n).withColumn("status", F.lit("processing"))


def finish_jobs(jobs: DataFrame) -> DataFrame:
    """jobs with their end status from error and metrics_json: failed, needs_review or completed."""
    qc = F.get_json_object("metrics_json", "$.qc.status")
    status = F.when(F.col("error").isNotNull(), "failed").when(qc == "needs_review", "needs_review").otherwise("completed")
    return jobs.withColumn("qc_status", F.when(F.col("error").isNull(), qc)).withColumn("status", status)


def job_status(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked-for job (job_id): whether it is known, its status, and its leak count and throughput from the metrics."""
    rows = ids.select("job_id").distinct().join(jobs, "job_id", "left")
    metrics = F.from_json("metrics_json", "throughput double, qc struct<status:string,leak_count:bigint>")
    return rows.select("job_id", F.col("status").isNotNull().alias("known"), "status", metrics["qc"]["leak_count"].alias("leak_count"), metrics["throughput"].alias("throughput"))


def job_backlog(jobs: DataFrame) -> DataFrame:
    """Jobs by status and configuration, with totals (null)."""
    return jobs.cube("status", "config_hash").agg(F.count(F.lit(1)).alias("jobs"))


def upsert_jobs(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """jobs with rows put in by job_id: a job of that id is replaced, other rows are added; the last updated_at wins among rows.

    A row whose upload_id and config_hash belong to another job is left out, as that pair names one job.
    """
    newest = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("updated_at"), "status"))).filter("_nth = 1").drop("_nth")
    taken = jobs.select("upload_id", "config_hash", F.col("job_id").alias("_owner"))
    mine = newest.join(taken, ["upload_id", "config_hash"], "left").filter("_owner is null or _owner = job_id").select(*jobs.columns)
    first = mine.withColumn("_nth", F.row_number().over(Window.partitionBy("upload_id", "config_hash").orderBy("created_at", "job_id"))).filter("_nth = 1").drop("_nth")
    return jobs.join(first.select("job_id"), "job_id", "left_anti").unionByName(first)
