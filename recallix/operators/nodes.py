"""Memories of a workflow's nodes: storing, reading and summing up what a namespace and graph hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated

#: Nodes in their order and the sector that each writes to; other nodes write to semantic.
NODE_SECTOR = {"observe": "episodic", "plan": "semantic", "reflect": "reflective", "act": "procedural", "emotion": "emotional"}
LINE, EXCERPT = 160, 480


def sector_of(node: Column) -> Column:
    n = F.lower(node)
    return reduce(lambda c, x: c.when(n == x[0], x[1]), list(NODE_SECTOR.items())[1:], F.when(n == "observe", "episodic")).otherwise("semantic")


def node_tags(tags: Column, node: Column, namespace: Column, graph: Column) -> Column:
    """A memory's tags with its node, namespace and graph, each once."""
    own = F.array(F.concat(F.lit("lgm:node:"), F.lower(node)), F.concat(F.lit("lgm:namespace:"), namespace), F.concat(F.lit("lgm:graph:"), graph))
    return F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.filter(own, lambda x: x.isNotNull())))


def node_meta(node: Column, namespace: Column, graph: Column, now: int) -> Column:
    inner = F.struct(F.lower(node).alias("node"), sector_of(node).alias("sector"), namespace.alias("namespace"), graph.alias("graph_id"), F.lit(now).alias("stored_at"), F.lit("langgraph").alias("mode"))
    return F.to_json(F.struct(inner.alias("lgm")))


def store(rows: DataFrame, now: int, reflective: bool = True) -> DataFrame:
    """(source_id, node, sector, content, tags, meta, reflection): memories of rows (id, node, content, namespace,
    graph_id, tags), and with reflective one reflection for each that is none itself."""
    n, ns, g = F.lower("node"), F.col("namespace"), F.col("graph_id")
    own = rows.select(F.col("id").alias("source_id"), n.alias("node"), sector_of(n).alias("sector"), "content", node_tags(F.col("tags"), n, ns, g).alias("tags"), node_meta(n, ns, g, now).alias("meta"), F.lit(False).alias("reflection"))
    if not reflective:
        return own
    head = F.concat_ws(" | ", F.concat(F.lit('LangGraph reflection for node "'), F.col("node"), F.lit('"')), F.concat(F.lit("namespace="), ns), F.concat(F.lit("graph="), g))
    me = F.lit("reflect")
    marks = F.array(F.lit("lgm:auto:reflection"), F.concat(F.lit("lgm:source:"), F.col("id").cast("string")))
    more = rows.where(n != "reflect").select(F.col("id").alias("source_id"), me.alias("node"), F.lit("reflective").alias("sector"), F.concat(head, F.lit("\n\n"), truncated(F.col("content"), EXCERPT)).alias("content"), node_tags(marks, me, ns, g).alias("tags"), node_meta(me, ns, g, now).alias("meta"), F.lit(True).alias("reflection"))
    return own.unionByName(more)


def in_namespace(meta: Column, namespace: str, graph: str | None = None) -> Column:
    own = F.get_json_object(meta, "$.lgm.namespace") == namespace
    return own if graph is None else own & (F.get_json_object(meta, "$.lgm.graph_id") == graph)


def retrieve(memories: DataFrame, namespace: str, graph: str | None, limit: int) -> DataFrame:
    """(node, place, ...): for each node the newest 4 * limit memories of its sector, of which the first `limit` of the
    namespace stay, last seen first."""
    nodes = F.create_map(*[F.lit(x) for pair in NODE_SECTOR.items() for x in reversed(pair)])
    newest = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("created_at"), "id"))
    some = memories.withColumn("_new", newest).where(F.col("_new") <= 4 * limit).where(in_namespace(F.col("meta"), namespace, graph))
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy("sector").orderBy("_new"))).where(F.col("_n") <= limit)
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("last_seen_at"), "_new")).cast("bigint")
    return first.withColumn("node", F.try_element_at(nodes, F.col("sector"))).withColumn("place", place).drop("_new", "_n")


def _lines(memories: DataFrame, namespace: str, graph: str | None, limit: int) -> DataFrame:
    """The context's lines with their number: each node's share of the limit, nodes in order."""
    share = max(1, limit // len(NODE_SECTOR))
    order = reduce(lambda c, x: c.when(F.col("node") == x[1], x[0]), list(enumerate(NODE_SECTOR))[1:], F.when(F.col("node") == "observe", 0))
    rows = retrieve(memories, namespace, graph, share).select("node", order.alias("o"), "place", truncated(F.col("content"), LINE).alias("line"))
    return rows.where(F.lit(True)).select(F.struct("o", "place", "node", "line").alias("x"))  # at most limit rows


def context(memories: DataFrame, namespace: str, graph: str | None = None, limit: int = 50) -> DataFrame:
    """One row: n lines and the summary."""
    x = F.slice(F.array_sort(F.collect_list("x")), 1, limit)
    line = lambda v: F.concat(F.lit("- ["), v["node"], F.lit("] "), v["line"])
    return _lines(memories, namespace, graph, limit).agg(x.alias("l")).select(F.size("l").cast("bigint").alias("n"), F.array_join(F.transform("l", line), "\n").alias("summary"))


def reflection(memories: DataFrame, namespace: str, graph: str | None = None, limit: int = 50) -> DataFrame:
    """One row: the text of a reflection over the context; none where there is nothing."""
    x = F.slice(F.array_sort(F.collect_list("x")), 1, limit)
    line = lambda v, i: F.concat((i + 1).cast("string"), F.lit(". ["), v["node"], F.lit("] "), v["line"])
    head = f"Reflection synthesized from LangGraph context (namespace={namespace}{f', graph={graph}' if graph else ''})\n\n"
    return _lines(memories, namespace, graph, limit).agg(x.alias("l")).where(F.size("l") > 0).select(F.concat(F.lit(head), F.array_join(F.transform("l", line), "\n")).alias("content"))
