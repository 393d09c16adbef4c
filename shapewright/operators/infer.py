"""Inference: triples to entity types with structural variations.

Every step is a DataFrame operation over the distinct structures, whose number
doesn't grow with the documents. Order matters in places (first seen, ordered
folds, merging), so rows carry ``ord`` - the triple's place - and ``post`` - the
object's place within it, children before parents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.functions import naming
from shapewright.operators import signature, small
from shapewright.tables import KEPT, cut

# Words that make an embedded entity an alias of another one.
HINTS = "has with set list setof listof array arrayof collection collectionof".split()

TRIPLE = "schema, count, firstTimestamp, lastTimestamp"
MESSAGE = "rows must hold an object schema and numeric count, firstTimestamp and lastTimestamp"


def valid_triples(rows: DataFrame) -> DataFrame:
    """One row (valid): whether the first row of ``rows(ord, schema, count,
    first_ts, last_ts)`` - JSON text columns - is a triple. No rows are valid."""
    first = rows.orderBy("ord").limit(1)
    number = lambda c: F.coalesce(signature.classify(F.try_parse_json(c)) == "NUMBER", F.lit(False))
    fine = F.coalesce(signature.classify(F.try_parse_json("schema")) == "OBJECT", F.lit(False)) & number("count") & number("first_ts") & number("last_ts")
    return first.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("valid"))


def read_triples(rows: DataFrame) -> DataFrame:
    """``rows`` with numbers truncated to longs; ValueError if the first isn't a triple."""
    if not valid_triples(rows).first().valid:
        raise ValueError(MESSAGE)
    whole = lambda c: F.expr(f"try_cast(try_cast({c} as double) as bigint)").alias(c)
    return rows.select("ord", "schema", whole("count"), whole("first_ts"), whole("last_ts"))


def objects(triples: DataFrame, rules: naming.Naming = naming.DEFAULT) -> DataFrame:
    """Every object of ``triples(ord, schema, count, first_ts, last_ts)``, schema
    JSON text of a skeleton - or ``signature``, as extraction makes it: (ord, post, entity, is_root, depth, sig, count,
    first_ts, last_ts). Inner objects begin with unknown (zero) metadata."""

    def run(batches):
        import pyarrow as pa

        namer = signature.Namer(rules)
        for batch in batches:
            rows = []
            for o, schema, n, first, last in zip(*(batch.column(i).to_pylist() for i in range(5))):
                out: list = []
                if made:
                    unfold(json.loads(schema), out)
                else:
                    signature.walk(json.loads(schema), "", namer, out, root=True)
                rows += [(o, p, e, r, d, s, *((n, first, last) if r else (0, 0, 0))) for p, (e, r, d, s) in enumerate(out)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    import pyarrow as pa

    made = "signature" in triples.columns
    names = "ord post entity is_root depth sig count first_ts last_ts".split()
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()])))
    return triples.select("ord", "signature" if made else "schema", "count", "first_ts", "last_ts").mapInArrow(run, "ord long, post int, entity string, is_root boolean, depth int, sig string, count long, first_ts long, last_ts long")


def unfold(node, out: list, depth: int = 0) -> None:
    """The objects of a signature, as ``signature.walk`` lists them."""
    if isinstance(node, dict):
        for child in [v for _, v in node["f"]] if "f" in node else node["a"]:
            unfold(child, out, depth + 1)
        if "f" in node:
            out.append((node["e"], bool(node["r"]), depth, signature.dump(node)))


def collapse(nodes: DataFrame, mode: str = "first") -> DataFrame:
    """One row per (entity, sig): the variation. ``first`` keeps the metadata of
    the first seen and drops later ones'; ``sum`` adds counts and spans times."""
    at = F.struct("ord", "post")
    known = F.min(F.when(F.col("first_ts") != 0, F.col("first_ts")))
    meta = {
        "first": [F.min_by(c, at).alias(c) for c in ("count", "first_ts", "last_ts")],
        "sum": [F.sum("count").alias("count"), F.coalesce(known, F.lit(0)).cast("long").alias("first_ts"), F.max("last_ts").alias("last_ts")],
    }[mode]
    return nodes.groupBy("entity", "sig").agg(F.bool_or("is_root").alias("is_root"), F.min("depth").alias("depth"), F.min(at).alias("at"), *meta)


def inner_entities(nodes: DataFrame) -> DataFrame:
    """Entities first registered by an inner object: (entity)."""
    return nodes.groupBy("entity").agg(F.min_by("is_root", F.struct("ord", "post")).alias("r")).where("not r").select("entity")


def aliases(entities: DataFrame, hints=HINTS) -> DataFrame:
    """(alias, entity): inner entities whose name is a hint before or after an
    entity's name, in any case. ``entities(entity, ord, inner)``; the first
    entity in order wins, then the first hint. A join on generated names."""
    words = F.posexplode(F.array(*[F.lit(h) for h in hints])).alias("hint_ord", "hint")
    made = entities.select(F.col("entity").alias("target"), F.col("ord").alias("target_ord"), words)
    made = made.select("target", "target_ord", "hint_ord", F.explode(F.array(F.concat("hint", "target"), F.concat("target", "hint"))).alias("name")).withColumn("name", F.lower("name"))
    inner = entities.where("inner").select(F.col("entity").alias("alias"), F.lower("entity").alias("name"))
    found = inner.join(made, "name").where("alias <> target")
    return found.groupBy("alias").agg(F.min_by("target", F.struct("target_ord", "hint_ord")).alias("entity"))


def renamed_tree(x, mapping: dict[str, str]):
    """A signature's tree with entities renamed."""
    if isinstance(x, dict) and "f" in x:
        return {"e": mapping.get(x["e"], x["e"]), "r": x["r"], "f": [[k, renamed_tree(v, mapping)] for k, v in x["f"]]}
    if isinstance(x, dict):
        return {"a": [renamed_tree(v, mapping) for v in x["a"]]}
    return x


def renamed(nodes: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``nodes`` with entities renamed, in their signatures too (a row per alias
    comes to the driver, never a row per document)."""
    if not mapping:
        return nodes

    def run(batches):
        import pyarrow as pa

        at = None
        for batch in batches:
            at = batch.schema.get_field_index("sig") if at is None else at
            made = [json.loads(s) for s in batch.column(at).to_pylist()]
            made = [renamed_tree(x, mapping) for x in made]
            batch = batch.set_column(at, "sig", pa.array([signature.dump(x) for x in made], pa.string()))
            yield batch.set_column(batch.schema.get_field_index("entity"), "entity", pa.array([x["e"] for x in made], pa.string()))

    return nodes.mapInArrow(run, nodes.schema)


def fields(variations: DataFrame) -> DataFrame:
    """The fields of ``variations(entity, sig)``: (entity, sig, pos, name, kind,
    prims, targets, is_array). targets are signatures of objects in a field."""

    def run(batches):
        import pyarrow as pa

        names = [("entity", pa.string()), ("sig", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("is_array", pa.bool_()), ("prims", pa.list_(pa.string())), ("targets", pa.list_(pa.struct([("entity", pa.string()), ("sig", pa.string())])))]
        for batch in batches:
            rows = []
            for entity, sig in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in signature.fields_of(sig):
                    rows.append(f | dict(entity=entity, sig=sig, targets=[dict(entity=e, sig=t) for e, t in f["targets"]]))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(names))

    return variations.select("entity", "sig").mapInArrow(run, "entity string, sig string, pos int, name string, is_array boolean, prims array<string>, targets array<struct<entity:string,sig:string>>")


def folded(rows: Column) -> Column:
    """Ordered combination of (count, first_ts, last_ts) structs, from unknown.

    A zero on the left takes the right one's time; the right one's time wins if
    it is smaller (larger), so a zero on the right replaces a known first."""
    zero = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("first_ts"), F.lit(0).cast("long").alias("last_ts"))

    def step(a, x):
        first = F.when((a.first_ts == 0) | (x.first_ts < a.first_ts), x.first_ts).otherwise(a.first_ts)
        last = F.when((a.last_ts == 0) | (x.last_ts > a.last_ts), x.last_ts).otherwise(a.last_ts)
        return F.struct((a["count"] + x["count"]).alias("count"), first.alias("first_ts"), last.alias("last_ts"))

    return F.aggregate(rows, zero, step)


def propagate(variations: DataFrame, inner: DataFrame, mode: str = "first") -> DataFrame:
    """Give inner variations the metadata of the variations that directly hold
    them. Outermost entities first, so that each level's containers are final;
    as many rounds as the deepest nesting."""
    depths = variations.join(inner, "entity", "left_semi").groupBy("entity").agg(F.min("depth").alias("level"))
    held = cut(fields(variations).select(F.col("entity").alias("c_entity"), F.col("sig").alias("c_sig"), F.explode("targets").alias("t")).select("c_entity", "c_sig", "t.entity", "t.sig").distinct())
    deepest = depths.agg(F.max("level").alias("m")).first().m or 0
    columns = variations.columns
    for level in range(0, deepest + 1):
        own = variations.join(depths.where(F.col("level") == level).select("entity"), "entity", "left_semi")
        got = held.join(own.select("entity", "sig"), ["entity", "sig"]).join(variations.select(F.col("entity").alias("c_entity"), F.col("sig").alias("c_sig"), F.struct("at", "count", "first_ts", "last_ts").alias("m")), ["c_entity", "c_sig"])
        if mode == "sum":
            known = F.min(F.when(F.col("m.first_ts") != 0, F.col("m.first_ts")))
            new = got.groupBy("entity", "sig").agg(F.struct(F.sum("m.count").alias("count"), F.coalesce(known, F.lit(0)).cast("long").alias("first_ts"), F.max("m.last_ts").alias("last_ts")).alias("new"))
        else:
            new = got.groupBy("entity", "sig").agg(folded(F.array_sort(F.collect_list("m"))).alias("new"))
        first = F.when((F.col("first_ts") == 0) | (F.col("new.first_ts") < F.col("first_ts")) if mode == "first" else (F.col("first_ts") == 0), F.col("new.first_ts")).otherwise(F.col("first_ts"))
        joined = variations.join(new, ["entity", "sig"], "left")
        has = F.col("new").isNotNull()
        variations = cut(joined.select(*[{"count": F.when(has, F.col("count") + F.col("new.count")).otherwise(F.col("count")).alias("count"), "first_ts": F.when(has, first).otherwise(F.col("first_ts")).alias("first_ts"), "last_ts": F.when(has, F.greatest("last_ts", "new.last_ts")).otherwise(F.col("last_ts")).alias("last_ts")}.get(c, F.col(c)) for c in columns]))
    return variations


# --- merging: an ordered fold over the few variations of one entity ---


def loose(a, b) -> bool:
    """Whether two signatures may be one variation: entity names don't count, and
    an empty array agrees with any homogeneous one."""
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    if ("f" in a) != ("f" in b):
        return False
    if "f" in a:
        return len(a["f"]) == len(b["f"]) and all(x[0] == y[0] and loose(x[1], y[1]) for x, y in zip(a["f"], b["f"]))
    one = len(a["a"]) <= 1, len(b["a"]) <= 1
    if one[0] != one[1]:
        return False
    if one[0]:
        return not a["a"] or not b["a"] or a["a"][0] == b["a"][0]
    return len(a["a"]) == len(b["a"]) and all(loose(x, y) for x, y in zip(a["a"], b["a"]))


def filled(a, b):
    """``b`` with its empty arrays filled from ``a``."""
    if isinstance(b, str):
        return b
    if "f" in b:
        return b | {"f": [[y[0], filled(x[1], y[1])] for x, y in zip(a["f"], b["f"])]}
    if len(b["a"]) <= 1:
        return b if b["a"] else {"a": a["a"]}
    return {"a": [filled(x, y) for x, y in zip(a["a"], b["a"])]}


def merge(variations: DataFrame) -> DataFrame:
    """Merge compatible variations of an entity, in order, to a fixpoint: the
    later partner survives and takes the earlier one's metadata. Compatibility
    isn't transitive, so this is a fold over an entity's variations. Adds
    ``was``: the signatures that the survivor stands for."""

    def fold(table):
        import pandas as pd

        rows = [dict(entity=r.entity, sig=r.sig, is_root=r.is_root, depth=r.depth, place=r.place, meta=(r.count_, r.first_ts, r.last_ts)) for r in table.itertuples()]
        return pd.DataFrame([row | dict(zip(("count", "first_ts", "last_ts"), row["meta"])) for row in small.merged(rows)])[list(names)]

    names = "entity sig is_root depth place count first_ts last_ts was".split()
    rows = variations.select("entity", "sig", "is_root", "depth", F.format_string("%020d.%010d", "at.ord", "at.post").alias("place"), F.col("count").alias("count_"), "first_ts", "last_ts")
    return rows.groupBy("entity").applyInPandas(fold, "entity string, sig string, is_root boolean, depth int, place string, count long, first_ts long, last_ts long, was array<string>")


VARIATIONS = "entity string, sig string, is_root boolean, depth int, place string, was array<string>, count long, first_ts long, last_ts long"


def infer(triples: DataFrame, mode: str = "first", join_aliases: bool = True, merging: bool = True, kept: int = KEPT) -> DataFrame:
    """Variations of ``triples(ord, schema, count, first_ts, last_ts)``: entity,
    sig, is_root, depth, place, count, first_ts, last_ts and was. Up to ``kept``
    triples are worked on by the driver (``small``), more by Spark. Raw rows,
    with counts and times as JSON text, are checked and converted first."""
    if "schema" in triples.columns and dict(triples.dtypes)["count"] == "string":
        triples = read_triples(triples)
    few = triples.limit(kept + 1).toArrow() if kept else None
    if few is not None and few.num_rows <= kept:
        rows = small.variations(few.to_pylist(), mode, join_aliases, merging)
        return triples.sparkSession.createDataFrame(rows, VARIATIONS)
    nodes = cut(objects(triples))  # a row per object of a distinct structure
    inner = cut(inner_entities(nodes))
    if join_aliases:
        first = nodes.groupBy("entity").agg(F.min(F.struct("ord", "post")).alias("at"))
        known = first.join(inner.withColumn("inner", F.lit(True)), "entity", "left").select("entity", F.col("at").alias("ord"), F.coalesce("inner", F.lit(False)).alias("inner"))
        mapping = {r.alias: r.entity for r in aliases(known).collect()}
        nodes = cut(renamed(nodes, mapping)) if mapping else nodes
        inner = inner.where(~F.col("entity").isin(list(mapping))) if mapping else inner
    found = propagate(cut(collapse(nodes, mode)), inner, mode)
    if merging:
        return cut(merge(found))
    return cut(found.select("entity", "sig", "is_root", "depth", F.format_string("%020d.%010d", "at.ord", "at.post").alias("place"), "count", "first_ts", "last_ts", F.array("sig").alias("was")))
