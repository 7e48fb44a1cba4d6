"""Rounds that read and write in proportion to their frontier.

A program of which only vertices with messages change (``VertexProgram.quiet``)
needs no new state after each round. Its state is a table in stretches of ids and
a log: each round writes the rows that it changed, and nothing else. Eight tables
of the log are merged into one of the next level, so a lookup reads few of them
and a row is written again once a level at most.

A round broadcasts the frontier, whose size and number of messages the last round
has counted, to the edges, which lie in a table by stretch of the source: dynamic
partition pruning reads the stretches of the frontier alone. The combined
messages are broadcast to the stretches of the state that they address in the
same way. Neither the edges nor the state move.

Edges may also lie in tiles (``TileStore``); then a frontier's tiles are looked up
in the vertex index first, and only the folders that hold these are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from graphloom.plans.storage import place, remove, settings

MERGED = 8  # tables of a level of the log
STRETCH_ROWS, MOST_STRETCHES = 65_536, 1024


def _read(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


class Stretches:
    """Vertex ids cut into stretches of a power of two."""

    def __init__(self, n: int, rows: int):
        stretches = min(MOST_STRETCHES, max(1, rows // STRETCH_ROWS))
        self.bits = max(0, (max(1, n) - 1).bit_length() - (stretches - 1).bit_length())

    def of(self, vertex: Column) -> Column:
        return F.shiftright(vertex, self.bits)


class StretchStore:
    """Edges in a table with a folder for each stretch of sources; ranged by both ends, so a hub's edges are several tasks'."""

    def __init__(self, edges: DataFrame, stretches: Stretches, width: int):
        self.stretches, spark = stretches, edges.sparkSession
        self.path = place(spark, "stretches")
        placed = edges.withColumn("part", stretches.of(F.col("src")).cast("long"))
        dealt = placed.repartitionByRange(width, "src", "tgt") if width > 1 else placed.coalesce(1)
        dealt.sortWithinPartitions("src").write.partitionBy("part").parquet(self.path)
        self.edges = _read(spark, StructType([*edges.schema.fields]).add("part", LongType()), self.path)

    def sent(self, named: DataFrame) -> DataFrame:
        """The edges of ``named`` sources (columns s_<name>) beside their columns."""
        named = named.where("s_id >= 0").withColumn("s_part", self.stretches.of(F.col("s_id")).cast("long"))
        return self.edges.join(F.broadcast(named), (F.col("part") == F.col("s_part")) & (F.col("src") == F.col("s_id")))

    def all_edges(self) -> DataFrame:
        return self.edges.drop("part")

    def close(self) -> None:
        remove(self.edges.sparkSession, self.path)


class TileStore:
    """Tiles and their vertex index as ``tiling.store_tiles`` writes them; nothing is written by a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.tiles, self.index = spark.read.parquet(f"{path}/tiles"), spark.read.parquet(f"{path}/index")
        row = self.index.select("bits").first()
        self.bits = row["bits"] if row else 0

    def active(self, named: DataFrame) -> DataFrame:
        """``named`` sources, once for each tile in which they are one."""
        named = named.where("s_id >= 0").withColumn("s_part", F.shiftright("s_id", self.bits).cast("int"))
        at = self.index.select(F.col("part").alias("i_part"), F.col("src").alias("i_src"), F.col("tile_id").alias("i_tile"), F.col("tile_bucket").alias("i_bucket"))
        return at.join(F.broadcast(named), (F.col("i_part") == F.col("s_part")) & (F.col("i_src") == F.col("s_id")))

    def sent(self, named: DataFrame) -> DataFrame:
        found = self.active(named).where("i_tile >= 0")
        on = (F.col("tile_bucket") == F.col("i_bucket")) & (F.col("tile_id") == F.col("i_tile")) & (F.col("src") == F.col("s_id"))
        return self.tiles.join(F.broadcast(found), on)

    def all_edges(self) -> DataFrame:
        return self.tiles.select("src", "tgt", *(["weight"] if "weight" in self.tiles.columns else []))

    def close(self) -> None:
        """The tiles stay."""


def _latest(rows: DataFrame, order: str = "_round") -> DataFrame:
    """The row of each id that was written last."""
    rest = [c for c in rows.columns if c not in ("id", order)]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_z"), F.max(order).alias(order)).select("id", *[F.col(f"_z.{c}").alias(c) for c in rest], order)


def changed_by(live: Column, new: dict[str, Column]) -> Column:
    """Whether a vertex sends next round or one of its ``new`` values differs from the old."""
    moved = live
    for name, value in new.items():
        moved = moved | ~value.eqNullSafe(F.col(name))
    return moved


class Changes:
    """The state of all vertices as a table and a log of changed rows; ``first`` is the round that comes next."""

    def __init__(self, state: DataFrame, store: StretchStore | TileStore, stretches: Stretches, width: int, first: int = 0):
        self.spark, self.store, self.stretches, self.columns = state.sparkSession, store, stretches, state.columns
        self.begun = self.last = first - 1
        path = place(self.spark, "state")
        placed = state.withColumn("part", stretches.of(F.col("id")).cast("long"))
        placed.repartition(width, "part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(path)
        self.base = _read(self.spark, StructType([*state.schema.fields]).add("part", LongType()), path)
        self.front = self.base.where("active").drop("part").withColumn("_round", F.lit(self.begun))
        self.logs: list[tuple[int, str]] = []  # level, path

    def round(self, step, number: int, parts: int, combine, senders: DataFrame | None = None, count: dict[str, Column] | None = None) -> dict:
        """One round; what it counted: messages sent, rows written, active ones and their out-edges, and ``count`` over the rows written.

        ``senders`` are rows of the state, by default those that the last round left active.
        """
        with settings(self.spark, {"spark.sql.shuffle.partitions": str(parts)}):
            front = self.front if senders is None else senders.withColumn("_round", F.lit(number - 1))
            named = front.select(*[F.col(c).alias(f"s_{c}") for c in [*self.columns, "_round"]])
            messages, seen, heard = step.message(), Observation(f"changes-{number}"), Observation(f"sent-{number}")
            sent = self.store.sent(named).select("tgt", F.col("s__round").alias("m__last"), *[c.alias(f"m_{k}") for k, c in messages.items()])
            sent = sent.observe(heard, F.count("*").alias("sent"))
            met = sent.groupBy("tgt").agg(*[combine[kind](F.col(f"m_{k}")).alias(f"m_{k}") for k, kind in step.combine.items()], F.max("m__last").alias("m__last"))  # no literal, so that rounds share their compiled code
            met = F.broadcast(met.where("tgt >= 0").withColumn("m_part", self.stretches.of(F.col("tgt")).cast("long")))
            names = [c for c in self.columns if c != "active"]
            received = [f"m_{k}" for k in step.combine] + ["m__last"]

            def beside(rows: DataFrame, on: Column, at: Column) -> DataFrame:
                return rows.join(met, on).select(*names, (F.col("active") & (at == F.col("m__last"))).alias("active"), *received, at.alias("_round"))

            old = beside(self.base, (F.col("part") == F.col("m_part")) & (F.col("id") == F.col("tgt")), F.lit(self.begun))
            if self.logs:
                old = _latest(old.union(beside(self._log(), F.col("id") == F.col("tgt"), F.col("_round"))))
            new = step.apply()
            live = new.pop("active") if "active" in new else step.active()
            moved = changed_by(live, new)
            kept = [F.col(c) for c in names if c not in new]
            changed = old.where(moved).select(*kept, *[c.alias(k) for k, c in new.items()], live.alias("active"), (F.col("m__last") + 1).alias("_round")).select(*self.columns, "_round")
            out_edges = F.coalesce(F.sum(F.when(F.col("active"), F.col("out_degree"))), F.lit(0)).alias("messages")
            counts = [F.count("*").alias("written"), F.count_if("active").alias("active"), out_edges, *[c.alias(k) for k, c in (count or {}).items()]]
            path = place(self.spark, "changed")
            changed.observe(seen, *counts).write.parquet(path)
        self.kind = changed.schema
        self.front, self.last = self._log([path]).where("active"), number
        self._keep(0, path)
        return heard.get | seen.get

    def add(self, rows: DataFrame) -> None:
        """Rows of the state as changed by the round before the next."""
        self.kind = StructType([*self.base.drop("part").schema.fields]).add("_round", "integer")
        path = place(self.spark, "changed")
        rows.select(*self.columns, F.lit(self.begun).alias("_round")).write.parquet(path)
        self._keep(0, path)

    def waiting(self, order: Column, sent: float) -> DataFrame:
        """The rows of the log that have not been sent, if the last rounds sent those whose ``order`` was ``sent`` at most."""
        return _latest(self._log()).where((order > sent) | (F.col("_round") == self.last)).select(*self.columns, "_round")

    def _log(self, paths: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(*(paths or [path for _, path in self.logs]))

    def _keep(self, level: int, path: str) -> None:
        """Add a table to the log; a full level but its newest table becomes one of the next."""
        full = [at for k, at in self.logs if k == level]
        self.logs.append((level, path))
        if len(full) < MERGED:
            return
        merged = place(self.spark, "changed")
        _latest(self._log(full)).select(*self.kind.names).write.parquet(merged)
        self.logs = [(k, at) for k, at in self.logs if at not in full]
        for at in full:
            remove(self.spark, at)
        self._keep(level + 1, merged)

    def current(self) -> DataFrame:
        """All vertices as they are now: a plan over the written tables."""
        base = self.base.drop("part")
        if not self.logs:
            return base
        last = _latest(self._log())
        last = last.select(*[F.col(c).alias(f"_{c}") for c in last.columns])
        both, found = base.join(last, F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()
        rest = [F.when(found, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in self.columns if c not in ("id", "active")]
        active = found & F.col("_active") & (F.col("__round") == self.last)
        return both.select("id", *rest, F.coalesce(active, F.lit(False)).alias("active")).select(*self.columns)
