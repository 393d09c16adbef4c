"""Model building: variations to the tables of a logical model.

Tables (columns in TYPES, VARIATIONS, FEATURES): entity types, their structural
variations, and these variations' features. Keys and references of documents are
unnamed and follow their attribute, whose name is in ``attribute``; references of
a graph have the relationship type's name and the variations of it that feature
them in ``featured_by``. Types are text: String, PList<Number>, PList<>,
PTuple<...>. A graph's model has tables of relationship types as well."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.functions import naming
from shapewright.operators import infer, signature, small
from shapewright.tables import KEPT, cut

# What may stand beside an entity's name in a reference's name, and a word that rules a reference out.
AFFIXES = "id ptr ref ids refs has".split()
UNLIKELY = "count"


TYPES = "entity_id int, name string, root boolean"
VARIATIONS = "entity string, variation_id int, count long, first_ts long, last_ts long, sig string"
FEATURES = """entity string, variation_id int, pos int, kind string, name string, data_type string, lower int, upper int, optional boolean,
targets array<struct<entity:string,variation_id:int>>, refs_to string, attribute string,
featured_by array<struct<relationship:string,variation_id:int>>, opposite string"""
RELATIONSHIP_TYPES = "name string"
RELATIONSHIP_VARIATIONS = "owner string, variation_id int, count long, first_ts long, last_ts long"
RELATIONSHIP_FEATURES = "owner string, variation_id int, pos int, name string, data_type string, optional boolean"


@dataclass
class Model:
    """A model as tables; relationship tables are those of a graph."""

    name: str
    entity_types: DataFrame
    variations: DataFrame
    features: DataFrame
    relationship_types: DataFrame | None = None
    relationship_variations: DataFrame | None = None
    relationship_features: DataFrame | None = None


def entity_types(variations: DataFrame) -> DataFrame:
    """(entity_id, name, root): roots first, each in order of first sight."""
    made = variations.groupBy("entity").agg(F.bool_or("is_root").alias("root"), F.min("place").alias("place"))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("root"), "place")) - 1  # a row per entity type
    return made.select(at.alias("entity_id"), F.col("entity").alias("name"), "root")


def variation_ids(variations: DataFrame, sort: bool = True) -> DataFrame:
    """``variations(entity, place, count, first_ts, last_ts, n_features)`` with
    ``variation_id`` from 1: by first_ts if any is known, else last_ts, else - if
    any is counted - as they are, else by their number of features."""
    own = Window.partitionBy("entity")
    some = lambda c: F.max(F.abs(c)).over(own) != 0
    key = F.when(some("first_ts"), F.col("first_ts")).when(some("last_ts"), F.col("last_ts")).when(some("count"), F.lit(0)).otherwise(F.col("n_features")) if sort else F.lit(0)
    keyed = variations.withColumn("_key", key)
    return keyed.withColumn("variation_id", F.row_number().over(Window.partitionBy("entity").orderBy("_key", "place"))).drop("_key")


def reference_patterns(entities: DataFrame, rules: naming.Naming = naming.DEFAULT) -> DataFrame:
    """(key_ord, target, pattern): for each root entity in order its name, plural
    and singular, as one regular expression over a field's lower-case name: the
    name first or last, with an affix and a separating character or without.
    Names go into the expression unescaped."""
    a = "|".join(AFFIXES)
    names = F.array_distinct(F.array(F.col("name"), rules.pluralize("name"), rules.singularize("name")))
    keys = entities.where("root").select("entity_id", F.col("name").alias("target"), F.posexplode(names).alias("at", "key"))
    k = F.lower("key")
    pattern = F.concat(F.lit(f"(?s)^(?:(?:.?|(?:{a}).?)"), k, F.lit(".*|.*"), k, F.lit(f"(?:.?|.?(?:{a})))$"))
    return keys.select(F.struct("entity_id", "at").alias("key_ord"), "target", pattern.alias("pattern"))


def references(names: DataFrame, patterns: DataFrame, rules: naming.Naming = naming.DEFAULT) -> DataFrame:
    """(name, refs_to) of ``names(name)``: the first entity in order one of whose
    patterns fits the singular of the name. Distinct names against the patterns
    of a schema's root entities; both are model-sized, never data-sized."""
    field = F.lower(rules.singularize("name"))
    asked = names.select("name").distinct().where(~F.lower("name").contains(UNLIKELY)).withColumn("_field", field)
    fit = asked.join(patterns, F.regexp_like("_field", F.col("pattern")))
    return fit.groupBy("name").agg(F.min_by("target", "key_ord").alias("refs_to"))


def data_type(prims, is_array) -> Column:
    """The type text of a scalar or an array of scalars."""
    names = F.create_map(*[F.lit(x) for pair in signature.KINDS.items() for x in pair])
    named = F.transform(prims, lambda x: F.element_at(names, x))
    many = F.when(F.size(prims) == 0, "PList<>").when(F.size(prims) == 1, F.concat(F.lit("PList<"), F.element_at(named, 1), F.lit(">"))).otherwise(F.concat(F.lit("PTuple<"), F.array_join(named, ","), F.lit(">")))
    return F.when(is_array, many).otherwise(F.element_at(named, 1))


def optional_flags(features: DataFrame, key: Column, variations: DataFrame) -> DataFrame:
    """``features(entity, variation_id, ...)`` with ``optional``: its key isn't in
    every one of its entity's ``variations(entity, variation_id)``."""
    keyed = features.withColumn("_key", key)
    n = keyed.groupBy("entity", "_key").agg(F.countDistinct("variation_id").alias("_n"))
    total = variations.groupBy("entity").agg(F.max("variation_id").alias("_total"))
    return keyed.join(n, ["entity", "_key"]).join(total, "entity").withColumn("optional", F.col("_n") < F.col("_total")).drop("_key", "_n", "_total")


def tagged_optional(components: DataFrame) -> DataFrame:
    """(entity, name, sig) of ``components(entity, variation_id, name, sig)`` that
    aren't in all variations; an entity with a single variation has none."""
    n = components.groupBy("entity", "name", "sig").agg(F.count("*").alias("n"))
    total = components.groupBy("entity").agg(F.countDistinct("variation_id").alias("total"))
    return n.join(total, "entity").where("total > 1 and n <> total").select("entity", "name", "sig")


def build(variations: DataFrame, name: str = "schema", sort: bool = True, rules: naming.Naming = naming.DEFAULT, kept: int = KEPT, tag: bool = True) -> Model:
    """The model of inferred variations (``infer.infer``): of up to ``kept`` by the
    driver (``small``), of more by Spark. Without ``tag`` nothing is optional."""
    few = variations.limit(kept + 1).toArrow() if kept else None
    if few is not None and few.num_rows <= kept:
        made = small.tables(few.to_pylist(), sort, rules, AFFIXES, UNLIKELY)
        for f in made[2]:
            f["optional"] &= tag
        return Model(name, *(variations.sparkSession.createDataFrame(rows, kind) for rows, kind in zip(made, (TYPES, VARIATIONS, FEATURES))))
    entities = cut(entity_types(variations))  # all tables here are of the schema's size
    parts = cut(infer.fields(variations))
    n = parts.groupBy("entity", "sig").agg(F.count("*").alias("n_features"))
    listed = cut(variation_ids(variations.join(n, ["entity", "sig"], "left").fillna(0, ["n_features"]), sort))
    of = listed.select("entity", "variation_id", "sig")
    ids = listed.select(F.col("entity").alias("t_entity"), F.col("variation_id").alias("t_id"), F.explode("was").alias("t_sig"))
    # aggregates: the exact variations they hold, in order
    hits = parts.select("entity", "sig", "pos", F.posexplode("targets").alias("i", "t"))
    hits = hits.join(ids, (F.col("t.entity") == F.col("t_entity")) & (F.col("t.sig") == F.col("t_sig")), "left")
    hits = hits.groupBy("entity", "sig", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("t.entity").alias("entity"), F.col("t_id").alias("variation_id")))), lambda x: F.struct(x.entity.alias("entity"), x.variation_id.alias("variation_id"))).alias("held"))
    parts = parts.join(hits, ["entity", "sig", "pos"], "left").join(of, ["entity", "sig"])
    object_ = F.size("targets") > 0
    refs = references(parts.where(~object_), reference_patterns(entities, rules), rules)
    parts = parts.join(refs, "name", "left")
    none = F.lit(None)
    row = lambda i, kind, **x: F.struct(F.lit(i).alias("i"), kind.alias("kind"), x["name"].alias("name"), x["type"].cast("string").alias("data_type"), x["lower"].cast("int").alias("lower"), x["upper"].cast("int").alias("upper"), x["targets"].alias("targets"), x["refs_to"].cast("string").alias("refs_to"), x["attribute"].cast("string").alias("attribute"))
    no_targets = F.lit(None).cast("array<struct<entity:string,variation_id:int>>")
    low, up = F.when(F.col("is_array"), 0).otherwise(1), F.when(F.col("is_array"), -1).otherwise(1)
    feature = row(0, F.when(object_, "Aggregate").otherwise("Attribute"), name=F.col("name"), type=F.when(~object_, data_type("prims", F.col("is_array"))), lower=F.when(object_, low), upper=F.when(object_, up), targets=F.when(object_, F.col("held")), refs_to=none, attribute=none)
    key = row(1, F.lit("Key"), name=none.cast("string"), type=none, lower=none, upper=none, targets=no_targets, refs_to=none, attribute=F.col("name"))
    ref = row(2, F.lit("Reference"), name=none.cast("string"), type=none, lower=low, upper=up, targets=no_targets, refs_to=F.col("refs_to"), attribute=F.col("name"))
    rows = F.filter(F.array(feature, F.when(~object_ & (F.col("name") == "_id"), key), F.when(~object_ & F.col("refs_to").isNotNull(), ref)), lambda x: x.isNotNull())
    made = cut(parts).select("entity", "variation_id", "pos", F.explode(rows).alias("f")).select("entity", "variation_id", "pos", "f.*")
    at = F.row_number().over(Window.partitionBy("entity", "variation_id").orderBy("pos", "i")) - 1
    made = made.withColumn("pos", at).drop("i")
    structural = F.col("kind").isin("Attribute", "Aggregate")
    shape = F.coalesce(F.concat_ws("|", "data_type", "lower", "upper", F.array_join(F.array_sort(F.transform("targets", lambda x: F.lower(x.entity))), ",")), F.lit(""))
    flagged = optional_flags(made, F.concat_ws("|", "kind", "name", shape), listed)
    flagged = flagged.withColumn("optional", F.when(structural & F.lit(tag), F.col("optional")).otherwise(F.lit(False)))
    unused = F.lit(None).cast("array<struct<relationship:string,variation_id:int>>").alias("featured_by"), F.lit(None).cast("string").alias("opposite")
    columns = ["entity", "variation_id", "pos", "kind", "name", "data_type", "lower", "upper", "optional", "targets", "refs_to", "attribute"]
    return Model(name, entities, listed.select("entity", "variation_id", "count", "first_ts", "last_ts", "sig"), cut(flagged.select(*columns, *unused)))


def infer_model(triples: DataFrame, name: str = "schema", profile: str = "faithful", kept: int = KEPT, tag: bool = True, **options) -> Model:
    """Triples to a model in one call. ``faithful`` keeps the metadata of the
    first of equal variations; ``corrected`` conserves counts."""
    mode = {"faithful": "first", "corrected": "sum"}[profile]
    return build(infer.infer(triples, mode, kept=kept, **options), name, kept=kept, tag=tag)


def conformance(docs: DataFrame, variations: DataFrame) -> DataFrame:
    """One row (unmatched): documents whose structure no root variation has, of
    ``docs(signature)``, or of counted structures ``docs(signature, count)``."""
    known = variations.where("is_root").select(F.explode("was").alias("signature")).distinct()
    n = F.coalesce(F.sum("count"), F.lit(0)) if "count" in docs.columns else F.count("*")
    return docs.join(known, "signature", "left_anti").agg(n.alias("unmatched"))
