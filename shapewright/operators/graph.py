"""Property graphs to models: nodes become entity types, edges relationship types.

Two data-sized passes give counted node shapes and counted edge shapes; what
follows is of the schema's size. An entity's variation is a set of typed
properties and a set of outgoing references; a relationship type's variation is
a set of typed properties, counted by its distinct source nodes."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.operators import model
from shapewright.tables import cut, stored


def entries(props) -> Column:
    """A property map as (name, type) pairs in order."""
    return F.array_sort(F.transform(F.map_entries(props), lambda x: F.struct(x.key.alias("name"), x.value.alias("type"))))


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, type, dst_label, properties): what an edge says of its
    source. One join, on the edges' targets; AQE splits a frequent target. The
    many edges of a node to one label are one row before they are shuffled on."""
    ends = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.select("src", "dst", "type", entries(F.col("props")).alias("properties")).join(ends, "dst").groupBy("src", "type", "dst_label", "properties").agg(F.count("*").alias("n"))


def node_shapes(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """(entity, properties, references, count) of nodes; references are (type,
    target, properties) of the edges that leave a node, as a set."""
    own = said.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("type", F.col("dst_label").alias("target"), "properties"))).alias("references"))
    none = F.array().cast(own.schema["references"].dataType)
    shaped = nodes.select(F.col("id").alias("src"), F.col("label").alias("entity"), entries(F.col("props")).alias("properties"))
    return shaped.join(own, "src", "left").groupBy("entity", "properties", F.coalesce("references", none).alias("references")).agg(F.count("*").alias("count"))


def edge_shapes(said: DataFrame) -> DataFrame:
    """(type, properties, count): the distinct source nodes of each edge shape."""
    return said.groupBy("type", "properties", "src").agg(F.count("*").alias("n")).groupBy("type", "properties").agg(F.count("*").alias("count"))


def graph_model(nodes: DataFrame, edges: DataFrame, name: str, intermediate: str | None = None) -> model.Model:
    """The model of ``nodes(id, label, props)`` and ``edges(src, dst, type,
    props)``, props maps of type names.

    Every label is a root entity. A reference is named by its relationship type,
    goes to one target, 1 to 1 however many edges a node has, and is featured by
    the variations of its relationship type that the node's edges have. A
    property that isn't in all variations is optional. With ``intermediate`` the
    counted shapes are written there as JSON."""
    spark = nodes.sparkSession
    said = stored(labelled(nodes, edges), "edges")
    shapes, kinds = cut(node_shapes(nodes, said)), cut(edge_shapes(said))
    if intermediate:
        shapes.write.mode("overwrite").json(f"{intermediate}/nodes")
        kinds.write.mode("overwrite").json(f"{intermediate}/edges")
    pairs = lambda held: [(x["name"], x["type"]) for x in held]
    relationships = defaultdict(list)
    for r in sorted(kinds.collect(), key=lambda r: (r.type, pairs(r.properties))):
        relationships[r.type].append((pairs(r.properties), r["count"]))
    number = {(kind, tuple(props)): i for kind, held in relationships.items() for i, (props, _) in enumerate(held, 1)}
    rel_variations, rel_features = [], []
    for kind, held in relationships.items():
        for i, (props, count) in enumerate(held, 1):
            rel_variations.append((kind, i, count, 0, 0))
            rel_features += [(kind, i, pos, n, t, sum(p == (n, t) for own, _ in held for p in own) < len(held)) for pos, (n, t) in enumerate(props)]
    entities = defaultdict(list)
    for r in sorted(shapes.collect(), key=lambda r: (r.entity, pairs(r.properties), str(r.references))):
        entities[r.entity].append(r)
    variations, features = [], []
    for entity, held in entities.items():
        props = [pairs(r.properties) for r in held]
        for i, r in enumerate(held, 1):
            variations.append((entity, i, r["count"], 0, 0, None))
            own = [dict(kind="Attribute", name=n, data_type=t, optional=sum((n, t) in x for x in props) < len(held)) for n, t in props[i - 1]]
            by = defaultdict(list)
            for x in r.references:
                by[x.type, x.target].append(dict(relationship=x.type, variation_id=number[x.type, tuple(pairs(x.properties))]))
            own += [dict(kind="Reference", name=kind, lower=1, upper=1, refs_to=target, featured_by=featured) for (kind, target), featured in sorted(by.items())]
            features += [dict(entity=entity, variation_id=i, pos=pos, optional=False) | f for pos, f in enumerate(own)]
    make = spark.createDataFrame
    return model.Model(
        name,
        make([(i, e, True) for i, e in enumerate(entities)], model.TYPES),
        make(variations, model.VARIATIONS),
        make(features, model.FEATURES) if features else make([], model.FEATURES),
        make([(kind,) for kind in relationships], model.RELATIONSHIP_TYPES),
        make(rel_variations, model.RELATIONSHIP_VARIATIONS),
        make(rel_features, model.RELATIONSHIP_FEATURES),
    )
