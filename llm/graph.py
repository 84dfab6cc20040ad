"""Connected components of an edge table, by contraction: joins and grouping only, and fewer edges each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import checkpoint_root

#: Parts of a hot key in a look-up: rows that point at one centre are spread over so many tasks.
SALTS = 8


def replaced(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with the values of `column` that names (x, up) knows replaced by theirs.

    Only those of the names that rows need travel, SALTS times each, so that a value that a third of the rows
    hold isn't one task's work.
    """
    need = rows.select(F.col(column).alias("_n")).distinct().join(names, F.col("_n") == F.col("x")).select("_n", "up")
    need = need.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("up", "_up")
    salted = rows.withColumn("_r", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    out = salted.join(need, (F.col(column) == F.col("_n")) & (F.col("_r") == F.col("_s")), "left")
    return out.select(*[F.coalesce("_up", column).alias(column) if c == column else F.col(c) for c in rows.columns])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of the edges: label is the smallest node that it reaches.

    Each round hangs every node below its smallest neighbour, follows those pointers to their roots (the way is
    halved each time) and puts roots in the place of nodes. At least half of the nodes are gone after a round, and
    of stars around their smallest node nothing is left. Tables are checkpointed. Edges with a null end are passed over;
    no edges, no rows.
    """
    checkpoint_root(edges.sparkSession)
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    ordered = lambda e: e.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct().checkpoint()
    e, label = ordered(ends), None
    while not e.isEmpty():
        up = e.groupBy("x").agg(F.min("y").alias("up")).checkpoint()
        while not up.select(F.col("up").alias("_n")).join(up.select("x"), F.col("_n") == F.col("x"), "left_semi").isEmpty():
            up = replaced(up, "up", up).checkpoint()
        if label is None:
            tops = e.select("y").distinct().join(up.select("x"), F.col("y") == F.col("x"), "left_anti")
            label = up.select(F.col("x").alias("node"), F.col("up").alias("label")).union(tops.select("y", "y")).checkpoint()
        else:
            label = replaced(label, "label", up).checkpoint()
        moved = e.join(up, "x").select(F.col("up").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        e = ordered(replaced(moved, "b", up).where("a <> b"))
    return e.select(F.col("x").alias("node"), F.col("y").alias("label")) if label is None else label
