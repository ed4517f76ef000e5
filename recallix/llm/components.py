"""Connected components of links between ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage


def name_of(column: str, kind: T.DataType) -> F.Column:
    """The label of an id that has no link: the id itself if it is binary (then a digest, in random order), else the
    128-bit digest of its text, so that unequal ids do not meet."""
    c = F.col(column)
    return c if isinstance(kind, T.BinaryType) else F.unhex(F.md5(c.cast("string").cast("binary")))


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, label) of every id in a link; ids have one label if links connect them. name_of(id) names it otherwise.

    Each round moves every id to its neighbour of the smallest name, if that is smaller than its own, and goes on with
    the links between the places moved to. Names are digests, in random order, so that paths in order of their ids
    shrink by a constant factor too; the links left fall with each round, and so does the work. Each round is written
    to the shared folder. Self-links and null ends are dropped. rows: about how many links there are at most, if known.
    """
    kind = links.schema[a].dataType
    x, y = name_of(a, kind), name_of(b, kind)
    one = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    names = one.select(F.col(a).alias("id")).unionAll(one.select(F.col(b).alias("id"))).distinct()
    edges = cut_lineage(one.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), rows)
    moves = []
    while n := edges.count():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut_lineage(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.least("a", "m").alias("to")), n)
        moves.append(move)
        left, right = move.select(F.col("from").alias("fa"), F.col("to").alias("ta")), move.select(F.col("from").alias("fb"), F.col("to").alias("tb"))
        moved = edges.join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb")).where("ta <> tb")
        edges = cut_lineage(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), n)
    if not moves:
        return names.select("id", name_of("id", kind).alias("label"))
    label = moves[-1]
    for move in reversed(moves[:-1]):
        later = label.select(F.col("from").alias("at"), F.col("to").alias("end"))
        label = move.join(later, F.col("to") == F.col("at"), "left").select("from", F.coalesce("end", "to").alias("to"))
    label = cut_lineage(label, rows)
    return names.join(label, name_of("id", kind) == F.col("from")).select("id", F.col("to").alias("label"))
