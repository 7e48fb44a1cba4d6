"""A directed multigraph: edges(src, tgt[, weight]) over vertices 0 .. n-1. Repeated edges and loops count; an edge with a null end or one outside is none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.storage import cut


@dataclass
class Graph:
    edges: DataFrame
    n: int

    @staticmethod
    def from_dataframe(edges: DataFrame, n: int | None = None) -> Graph:
        """``n`` defaults to the largest id plus one."""
        if n is None:
            most = edges.agg(F.max(F.greatest("src", "tgt"))).first()[0]
            n = 0 if most is None else most + 1
        return Graph(edges, n)

    @staticmethod
    def from_original_ids(edges: DataFrame, order: str = "pos") -> tuple[Graph, DataFrame]:
        """A graph with dense ids by first appearance, and the dictionary (id, orig_id)."""
        known = encode_ids(edges, order)
        src, tgt = known.select(F.col("id").alias("s"), F.col("orig_id").alias("so")), known.select(F.col("id").alias("t"), F.col("orig_id").alias("to"))
        rest = [c for c in edges.columns if c not in ("src", "tgt")]
        dense = edges.join(src, edges["src"] == src["so"]).join(tgt, F.col("tgt") == tgt["to"])
        return Graph(dense.select(F.col("s").alias("src"), F.col("t").alias("tgt"), *rest), known.count()), known

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of every vertex, isolated ones too; repeated edges count."""
        inside = F.col("src").between(0, self.n - 1) & F.col("tgt").between(0, self.n - 1)
        ends = self.edges.where(inside).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tgt").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        ids = self.edges.sparkSession.range(self.n)
        zero = F.lit(0).cast("long")
        return ids.join(counted, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))

    def vertices(self) -> DataFrame:
        return cut(self.degrees(), "degrees")

    def symmetrized(self) -> Graph:
        """With every edge in both directions; multiplicities stay."""
        rest = [c for c in self.edges.columns if c not in ("src", "tgt")]
        back = self.edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), *rest)
        return Graph(self.edges.select("src", "tgt", *rest).union(back), self.n)

    def checked(self) -> Graph:
        """Edges that raise an error, where they are read, if an end lies outside 0 .. n-1."""
        inside = F.col("src").between(0, self.n - 1) & F.col("tgt").between(0, self.n - 1)
        bad = F.assert_true(inside, F.format_string("edge %s -> %s is out of bounds", F.col("src").cast("string"), F.col("tgt").cast("string")))
        return Graph(self.edges.where(bad.isNull()), self.n)


def encode_ids(edges: DataFrame, order: str = "pos") -> DataFrame:
    """(id, orig_id): dense ids by first appearance, a row's source before its target; ``order`` is the rows' integer position.

    Ranked without a single-partition window: first places are ranged, counted per range, and numbered within it.
    """
    ends = edges.select(F.explode(F.array(F.struct((F.col(order) * 2).alias("at"), F.col("src").alias("orig_id")), F.struct((F.col(order) * 2 + 1).alias("at"), F.col("tgt").alias("orig_id")))).alias("e")).select("e.*")
    first = ends.groupBy("orig_id").agg(F.min("at").alias("at"))
    return dense_rank_by(first, "at", "id").select("id", "orig_id")


def dense_rank_by(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 0 by ``order`` (unique)."""
    from pyspark.sql import Window

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(width, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    bases = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.join(bases, "_part").withColumn(name, (F.col("_base") + within).cast("long")).drop("_part", "_base")


def decode_ids(values: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """``values`` with orig_id instead of ``id_col``."""
    rest = [c for c in values.columns if c != id_col]
    return values.join(known, values[id_col] == known["id"]).select("orig_id", *[values[c] for c in rest])
