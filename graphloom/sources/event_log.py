"""Spark's event log as tables: what each task did, and in which round of a run.

``superstep.run`` names the round whose jobs it starts in a local property, which
the log keeps with each job; stages and tasks follow from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.superstep import ROUND_PROPERTY

_TASK = """struct<Event:string,`Stage ID`:int,`Stage Attempt ID`:int,
    `Task Info`:struct<`Task ID`:bigint,`Executor ID`:string,`Host`:string,`Launch Time`:bigint,`Finish Time`:bigint,Failed:boolean,Killed:boolean>,
    `Task Metrics`:struct<`Executor Run Time`:bigint,`Executor CPU Time`:bigint,`JVM GC Time`:bigint,`Disk Bytes Spilled`:bigint,
        `Input Metrics`:struct<`Bytes Read`:bigint,`Records Read`:bigint>,`Output Metrics`:struct<`Bytes Written`:bigint,`Records Written`:bigint>,
        `Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint,`Total Records Read`:bigint>,
        `Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint,`Shuffle Records Written`:bigint>>>"""  # fixed value: the log's fields


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ended task: round (null outside a run), job, stage, attempt, task, executor, host, began and ended
    (milliseconds), failed, and its counters. A stage that several jobs name belongs to the first."""
    lines = spark.read.text(path)
    event = F.get_json_object("value", "$.Event")
    ended = lines.where(event == "SparkListenerTaskEnd").select(F.from_json("value", _TASK).alias("e"))
    jobs = lines.where(event == "SparkListenerJobStart").select(
        F.get_json_object("value", "$['Job ID']").cast("int").alias("job"),
        F.get_json_object("value", f"$.Properties['{ROUND_PROPERTY}']").alias("round"),
        F.explode(F.from_json(F.get_json_object("value", "$['Stage IDs']"), "array<int>")).alias("_stage"),
    )
    first = jobs.groupBy("_stage").agg(F.min_by("round", "job").alias("round"), F.min("job").alias("job"))
    info, metrics = "e.`Task Info`", "e.`Task Metrics`"
    counters = {
        "run_ms": "`Executor Run Time`",
        "cpu_ns": "`Executor CPU Time`",
        "gc_ms": "`JVM GC Time`",
        "spilled_bytes": "`Disk Bytes Spilled`",
        "read_bytes": "`Input Metrics`.`Bytes Read`",
        "read_rows": "`Input Metrics`.`Records Read`",
        "written_bytes": "`Output Metrics`.`Bytes Written`",
        "written_rows": "`Output Metrics`.`Records Written`",
        "shuffled_in_rows": "`Shuffle Read Metrics`.`Total Records Read`",
        "shuffled_out_bytes": "`Shuffle Write Metrics`.`Shuffle Bytes Written`",
        "shuffled_out_rows": "`Shuffle Write Metrics`.`Shuffle Records Written`",
    }
    rows = ended.select(
        F.col("e.`Stage ID`").alias("stage"),
        F.col("e.`Stage Attempt ID`").alias("attempt"),
        F.col(f"{info}.`Task ID`").alias("task"),
        F.col(f"{info}.`Executor ID`").alias("executor"),
        F.col(f"{info}.Host").alias("host"),
        F.col(f"{info}.`Launch Time`").alias("began"),
        F.col(f"{info}.`Finish Time`").alias("ended"),
        (F.col(f"{info}.Failed") | F.col(f"{info}.Killed")).alias("failed"),
        *[F.coalesce(F.col(f"{metrics}.{field}"), F.lit(0)).alias(name) for name, field in counters.items()],
    )
    return rows.join(first, rows["stage"] == first["_stage"], "left").select("round", "job", *rows.columns)


def counters(done: DataFrame) -> DataFrame:
    """(round, jobs, tasks, failed, and the sums of the counters) of ``tasks``, a row a round."""
    sums = [c for c in done.columns if c.endswith(("_ms", "_ns", "_bytes", "_rows"))]
    return done.groupBy("round").agg(F.countDistinct("job").alias("jobs"), F.count("*").alias("tasks"), F.count_if("failed").alias("failed"), *[F.sum(c).alias(c) for c in sums])


def trace(done: DataFrame) -> DataFrame:
    """(value): a begin and an end event of each task as JSON in the common trace format; write as text, one event a line.

    An executor is a process and a task a thread of it; times are microseconds.
    """
    name = F.concat_ws(" ", F.coalesce("round", F.lit("other")), F.concat(F.lit("stage "), "stage"), F.concat(F.lit("task "), "task"))
    shared = [name.alias("name"), F.lit("task").alias("cat"), F.col("executor").alias("pid"), F.col("task").alias("tid")]
    ends = F.explode(F.array(F.struct(F.lit("B").alias("ph"), (F.col("began") * 1000).alias("ts")), F.struct(F.lit("E").alias("ph"), (F.col("ended") * 1000).alias("ts")))).alias("z")
    events = done.select(*shared, ends).select("name", "cat", "pid", "tid", "z.ph", "z.ts")
    return events.select(F.to_json(F.struct("name", "cat", "ph", "ts", "pid", "tid")).alias("value"))
