"""Extraction: documents or a graph to counted structures, with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.operators import graph, signature


def oid_seconds(oid) -> Column:
    """Seconds of an ObjectId's first four bytes; 0 for anything else."""
    text = F.col(oid) if isinstance(oid, str) else oid
    hexed = F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{24}$")), F.substring(text, 1, 8))
    return F.coalesce(F.conv(hexed, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def skeleton_counts(docs: DataFrame, seconds: Column | None = None, by: str = "collection") -> DataFrame:
    """The triples of ``docs(collection, signature)``: signature, count, first_ts
    and last_ts. Value erasure comes before the one shuffle, which moves a row
    per distinct structure and task (partial aggregation)."""
    ts = F.lit(0).cast("bigint") if seconds is None else seconds
    pairs = docs.where("signature is not null").select(by, "signature", ts.alias("ts"))
    return pairs.groupBy(by, "signature").agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def triples_of_typed(docs: DataFrame, collection: str, seconds: Column | None = None) -> DataFrame:
    """Triples of typed documents (NULL is absent), by generated expressions only."""
    entity = signature.Namer().capitalize(collection)
    made = docs.select(F.lit(collection).alias("collection"), signature.typed(docs.schema, entity).alias("signature"), (F.lit(0).cast("bigint") if seconds is None else seconds).alias("ts"))
    return skeleton_counts(made, F.col("ts"))


def triples_of_json(docs: DataFrame) -> DataFrame:
    """Triples of ``docs(collection, doc)``, doc a VARIANT or JSON text, dated by
    ``_id.$oid``. Values are erased and equal texts counted first, all in the
    JVM; Python sees the texts that still differ. The second count has a row for
    each of these at most."""
    text = F.to_json("doc") if dict(docs.dtypes)["doc"] == "variant" else F.col("doc")
    ts = oid_seconds(F.get_json_object(text, "$['_id']['$oid']"))
    some = docs.select("collection", signature.erased(text).alias("doc"), ts.alias("ts")).groupBy("collection", "doc")
    counted = some.agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    signed = signature.signatures(counted).where("signature is not null")
    return signed.groupBy("collection", "signature").agg(F.sum("n").alias("count"), F.min("low").alias("first_ts"), F.max("high").alias("last_ts"))


# --- property graphs: nodes(id, label, props) and edges(src, dst, type, props), props MAP<STRING,STRING> of type names ---


def _joined(properties: Column) -> Column:
    return F.array_join(F.transform(properties, lambda x: F.concat(x["name"], F.lit(":"), x["type"])), ",")


def graph_entity_variations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (label, property shape, outgoing relationships): the number of nodes.

    Relationships are a set per node, made before nodes are joined, so that a
    node with many edges is one row; nodes without edges have the empty set."""
    rels = graph.labelled(nodes, edges).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("->", "type", "dst_label"))), ",").alias("relationships"))
    shaped = nodes.select(F.col("id").alias("src"), F.col("label").alias("entity"), _joined(graph.entries(F.col("props"))).alias("properties"))
    joined = shaped.join(rels, "src", "left")
    return joined.groupBy("entity", "properties", F.coalesce("relationships", F.lit("")).alias("relationships")).agg(F.count("*").alias("count"))


def graph_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (relationship type, property shape, source and target label): the
    number of distinct source nodes and the number of edges. Edges are counted
    by source before their sources' labels are joined."""
    sources = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    one = graph.labelled(nodes, edges).join(sources, "src")
    return one.groupBy("type", _joined(F.col("properties")).alias("properties"), "src_label", "dst_label").agg(F.count("*").alias("count"), F.sum("n").alias("n_edges"))
