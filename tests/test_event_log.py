"""A run of known counts in a session of its own, whose log is read back."""

import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from graphloom.sources import event_log

RUN = """
import sys
from pyspark.sql import SparkSession
from graphloom.graph import Graph
from graphloom.operators import programs
at = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"file://{at}/shared")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{at}/log").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate())
graph = Graph(spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, tgt long"), 5)
programs.bfs(graph, 0)
spark.range(10).write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_a_run_in_the_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], check=True, cwd=root, env={**__import__("os").environ, "PYTHONPATH": root}, capture_output=True, timeout=240)
    done = event_log.tasks(spark, f"file://{tmp_path}/log")
    by_round = {r["round"]: r for r in event_log.counters(done).collect()}
    assert set(by_round) == {None, *[f"bfs-{k}" for k in range(5)]}
    assert all(r.failed == 0 for r in by_round.values())
    # each round writes the one vertex that it reaches, the last one none
    assert [by_round[f"bfs-{k}"].written_rows for k in range(1, 5)] == [1, 1, 1, 0]
    assert by_round["bfs-0"].written_rows == 4 + 5 + 1  # the stored edges and state besides
    events = [json.loads(r.value) for r in event_log.trace(done).collect()]
    assert len(events) == 2 * done.count() and {e["ph"] for e in events} == {"B", "E"}
    assert done.where(F.col("ended") < F.col("began")).count() == 0
