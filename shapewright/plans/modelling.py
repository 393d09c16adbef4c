"""Queries of model building and comparison over documents made of the tables."""

from __future__ import annotations

import dataclasses
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.operators import compare, extract, graph, model
from shapewright.operators.model import Model
from shapewright.sources import documents, xmi
from shapewright.sources.documents import table
from shapewright.tables import cut


def _nations_and_customers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    c = table(spark, sf_dir, "customer")
    address = F.struct(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("code"))
    vip = F.when(F.col("c_acctbal") > 5000, True).alias("vip")
    c = c.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance"), vip, address.alias("address"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"))
    return [extract.triples_of_typed(n, "nations"), extract.triples_of_typed(c, "customers")]


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """Triples of several collections, in a fixed order."""
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("collection", "signature")).cast("long")  # a row per distinct structure
    return documents.collections(parts).select(at.alias("ord"), "signature", "count", "first_ts", "last_ts")


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of nations, customers (typed) and orders as documents."""
    return _numbered([*_nations_and_customers(spark, sf_dir), extract.triples_of_typed(documents.orders_docs(spark, sf_dir), "orders")])


def _model(spark, sf_dir, name: str = "shop") -> Model:
    return model.infer_model(_triples(spark, sf_dir), name, "corrected")


def entity_types_root(spark, sf_dir):
    return _model(spark, sf_dir).entity_types.select("name", "root")


def variation_ids(spark, sf_dir):
    """Variations per entity: how many, their largest id and documents."""
    v = _model(spark, sf_dir).variations
    return v.groupBy("entity").agg(F.count("*").alias("n"), F.max("variation_id").alias("last_id"), F.sum("count").alias("count"))


def attributes_typed(spark, sf_dir):
    f = _model(spark, sf_dir).features.where("kind = 'Attribute'")
    return f.select("entity", "name", "data_type").distinct()


def aggregates_bounds(spark, sf_dir):
    f = _model(spark, sf_dir).features.where("kind = 'Aggregate'")
    return f.select("entity", "name", "lower", "upper", F.array_join(F.array_distinct(F.transform("targets", lambda t: t.entity)), ",").alias("target")).distinct()


def plist_types(spark, sf_dir):
    """Orders without items give an empty array: a list without element type, as
    long as it isn't merged with filled ones."""
    f = model.infer_model(_triples(spark, sf_dir), "shop", "corrected", merging=False).features
    return f.where("data_type like 'P%'").select("entity", "name", "data_type").distinct()


def keys(spark, sf_dir):
    f = _model(spark, sf_dir).features.where("kind = 'Key'")
    return f.groupBy("entity", "attribute").agg(F.count("*").alias("n"))


def references_by_name(spark, sf_dir):
    f = _model(spark, sf_dir).features.where("kind = 'Reference'")
    return f.select("entity", "attribute", "refs_to", "lower", "upper").distinct()


def optional_features(spark, sf_dir):
    f = _model(spark, sf_dir).features.where("kind = 'Attribute'")
    return f.select("entity", "name", "data_type", "optional").distinct()


def optional_tagger(spark, sf_dir):
    """Discounts as components of parts' variations, one for each of some orders."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select((F.col("l_partkey") % 50).alias("entity"), (F.col("l_orderkey") % 40).alias("variation_id"), F.round(F.col("l_discount") * 100).cast("int").alias("name"), F.lit("S").alias("sig")).distinct()
    return model.tagged_optional(rows).select("entity", "name")


def sorted_variations(spark, sf_dir):
    """Suppliers as variations of their nation, by their balance as a time."""
    s = table(spark, sf_dir, "supplier")
    known = F.col("s_nationkey") % 2 == 0
    rows = s.select(F.col("s_nationkey").alias("entity"), F.format_string("%020d", "s_suppkey").alias("place"), F.lit(1).cast("long").alias("count"), F.when(known, F.floor("s_acctbal")).otherwise(0).alias("first_ts"), F.lit(0).cast("long").alias("last_ts"), F.lit(1).alias("n_features"), "s_suppkey")
    return model.variation_ids(rows).select("s_suppkey", "entity", "variation_id")


def _shop(spark, sf_dir, name: str = "shop") -> Model:
    """The model of nations and customers alone: no line items are read."""
    return model.infer_model(_numbered(_nations_and_customers(spark, sf_dir)), name, "corrected")


def _mutated(base: Model, **x) -> Model:
    return dataclasses.replace(base, **x)


def _counted(divergences: DataFrame) -> DataFrame:
    return divergences.groupBy("category", "fatal").agg(F.count("*").alias("n"))


def compare_identical(spark, sf_dir):
    """A model with itself is equivalent; variations with equal features all find
    the first of them, so the others are reported, not fatally."""
    m = _shop(spark, sf_dir)
    found = cut(compare.compare(m, m))
    return compare.equivalent(found).crossJoin(found.agg(F.count_if(F.col("category") == "COUNT").alias("n_counts"), F.count_if(F.col("category") == "VARIATION").alias("n_orphans")))  # one row each


def compare_mutations(spark, sf_dir):
    """Each mutation and the divergences it must give."""
    m = _shop(spark, sf_dir)
    keep = lambda df, col: df.where(F.col(col) != "Nations")
    rename = lambda df, col, to: df.withColumn(col, F.when(F.col(col) == "Nations", to).otherwise(F.col(col)))
    named = lambda to: _mutated(m, entity_types=rename(m.entity_types, "name", to), variations=rename(m.variations, "entity", to), features=rename(m.features, "entity", to))
    first = (F.col("entity") == "Customers") & (F.col("variation_id") == 1)
    cases = {
        "schema renamed": _mutated(m, name="other"),
        "entity dropped": _mutated(m, entity_types=keep(m.entity_types, "name"), variations=keep(m.variations, "entity"), features=keep(m.features, "entity")),
        "renamed far": named("Somewhere"),
        "renamed near": named("Nation"),
        "root flipped": _mutated(m, entity_types=m.entity_types.withColumn("root", F.when(F.col("name") == "Nations", ~F.col("root")).otherwise(F.col("root")))),
        "variation dropped": _mutated(m, variations=m.variations.where(~first), features=m.features.where(~first)),
        "count bumped": _mutated(m, variations=m.variations.withColumn("count", F.when(F.col("entity") == "Nations", F.col("count") + 1).otherwise(F.col("count")))),
        "type changed": _mutated(m, features=m.features.withColumn("data_type", F.when(F.col("name") == "balance", "PList<PList<String>>").otherwise(F.col("data_type")))),
    }
    return documents.collections([_counted(compare.compare(m, x)).select(F.lit(k).alias("mutation"), "category", "fatal", "n") for k, x in cases.items()])


def _of_tables(spark, name: str, rows: DataFrame) -> Model:
    """A model of ``rows(entity, place, count, feature)``: a variation for each
    row, with one feature, a struct with columns of model.FEATURES."""
    numbered = rows.withColumn("variation_id", F.row_number().over(Window.partitionBy("entity").orderBy("place")))
    types = rows.groupBy("entity").agg(F.lit(True).alias("root")).select(F.dense_rank().over(Window.partitionBy("root").orderBy("entity")).alias("entity_id"), F.col("entity").alias("name"), "root")
    kinds = dict(spark.createDataFrame([], model.FEATURES).dtypes)
    own = {f.name for f in rows.schema["feature"].dataType.fields}
    columns = [F.col("entity"), "variation_id", F.lit(0).alias("pos")] + [(F.col(f"feature.{c}") if c in own else F.lit(None)).cast(t).alias(c) for c, t in kinds.items() if c not in ("entity", "variation_id", "pos")]
    zero = F.lit(0).cast("long")
    return Model(name, types, numbered.select("entity", "variation_id", "count", zero.alias("first_ts"), zero.alias("last_ts"), F.lit(None).cast("string").alias("sig")), numbered.select(*columns))


def compare_orphans(spark, sf_dir):
    """Suppliers as variations of their nations, with a feature by their key
    modulo three against modulo two: many variations are equal, some have no
    match, and all that nobody finds first are orphans."""
    s = table(spark, sf_dir, "supplier")

    def side(n):
        feature = F.struct(F.lit("Attribute").alias("kind"), F.concat(F.lit("a"), (F.col("s_suppkey") % n).cast("string")).alias("name"), F.lit("Long").alias("data_type"), F.lit(False).alias("optional"))
        return _of_tables(spark, "m", s.select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("_____")).alias("entity"), F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 7).alias("count"), feature.alias("feature")))

    return _counted(compare.compare(side(3), side(2)))


def compare_near_targets(spark, sf_dir):
    """Aggregates and references to nations against ones to the same names with
    letters added or left out: near names are the same."""
    n = table(spark, sf_dir, "nation")
    others = F.array(F.lower("n_name"), F.concat("n_name", F.lit("S")), F.concat("n_name", F.lit("LAND")), F.expr("substr(n_name, 2)"), F.lit("x"))
    rows = n.select("n_nationkey", "n_name", F.posexplode(others).alias("i", "other"))

    def side(target):
        hold = F.array(F.struct(F.col(target).alias("entity"), F.lit(1).alias("variation_id")))
        aggregate = F.struct(F.lit("Aggregate").alias("kind"), F.lit("f").alias("name"), F.lit(True).alias("optional"), F.lit(0).alias("lower"), F.lit(-1).alias("upper"), hold.alias("targets"), F.lit(None).cast("string").alias("refs_to"))
        reference = F.struct(F.lit("Reference").alias("kind"), F.lit("f").alias("name"), F.lit(False).alias("optional"), F.lit(1).alias("lower"), F.lit(1).alias("upper"), F.lit(None).cast(rows.select(hold).schema[0].dataType).alias("targets"), F.col(target).alias("refs_to"))
        entity = F.concat(F.lit("e"), F.col("n_nationkey").cast("string"), F.lit("______"), "i")
        return _of_tables(spark, "m", rows.select(entity.alias("entity"), F.lit(1).alias("place"), F.lit(1).cast("long").alias("count"), F.when(F.col("i") % 2 == 0, aggregate).otherwise(reference).alias("feature")))

    return _counted(compare.compare(side("n_name"), side("other")))


def compare_data_types(spark, sf_dir):
    """Type texts in canonical form: synonyms at any depth, tuples in order."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    kind = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("Long", "integer", "Float", "string", "Date")]), (F.col("p_partkey") % n % 5 + 1).cast("int"))
    text = F.concat(F.lit("PMap<"), kind(7), F.lit(",PList<PTuple<"), kind(11), F.lit(","), kind(13), F.lit(">>>"))
    return compare.canonical_data_types(p.withColumn("type", text), "type", "canonical")


def graph_model(spark, sf_dir):
    """The model of the tables as a graph: variations with their numbers of
    attributes and references, and relationship types' variations."""
    m = graph.graph_model(*documents.graph(spark, sf_dir), "shop")
    n = m.features.groupBy(F.col("entity").alias("owner"), "variation_id").agg(F.count_if(F.col("kind") == "Attribute").alias("n_attributes"), F.count_if(F.col("kind") == "Reference").alias("n_references"), F.count_if("optional").alias("n_optional"))
    own = m.variations.select(F.col("entity").alias("owner"), "variation_id", "count").join(n, ["owner", "variation_id"], "left")
    r = m.relationship_features.groupBy("owner", "variation_id").agg(F.count("*").alias("n_attributes"), F.count_if("optional").alias("n_optional"))
    rels = m.relationship_variations.select("owner", "variation_id", "count").join(r, ["owner", "variation_id"], "left").withColumn("n_references", F.lit(0).cast("long"))
    return own.unionByName(rels).drop("variation_id").fillna(0)


def compare_relationships(spark, sf_dir):
    """Mutations of a graph's relationship types."""
    m = graph.graph_model(*documents.graph(spark, sf_dir), "shop")
    m = _mutated(m, **{k: cut(getattr(m, k)) for k in ("relationship_types", "relationship_variations", "relationship_features")})
    cases = {
        "as it is": m,
        "dropped": _mutated(m, relationship_types=m.relationship_types.where("name <> 'PLACED'")),
        "renamed near": _mutated(m, relationship_types=m.relationship_types.withColumn("name", F.regexp_replace("name", "PLACED", "PLACEDS"))),
        "counts bumped": _mutated(m, relationship_variations=m.relationship_variations.withColumn("count", F.col("count") + 1)),
        "type changed": _mutated(m, relationship_features=m.relationship_features.withColumn("data_type", F.lit("string"))),
    }
    found = documents.collections([_counted(compare.compare(m, x)).select(F.lit(k).alias("mutation"), "category", "fatal", "n") for k, x in cases.items()])
    return found


def compare_names_fuzzy(spark, sf_dir):
    """Nation names against themselves with letters added or left out."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    other = F.explode(F.array(F.lower("n_name"), F.concat("n_name", F.lit("S")), F.concat("n_name", F.lit("LAND")), F.expr("substr(n_name, 2)"), F.lit("x"))).alias("other")
    return n.select("n_nationkey", "n_name", other).withColumn("same", compare.compare_names(F.col("n_name"), F.col("other")))


def compare_primitive_synonyms(spark, sf_dir):
    rows = spark.createDataFrame([("Long", "integer"), ("Number", "LONG"), ("float", "Double"), ("String", "string"), ("Date", "date"), ("String", "Number"), (None, None), ("String", None)], "a string, b string")
    return rows.withColumn("same", compare.same_primitive("a", "b"))


def bag_match(spark, sf_dir):
    """Whether an order's parts, in either order of its lines, are the same bag."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    both = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey).alias("a"))
    return both.select("l_orderkey", compare.bags_equal(F.col("a"), F.reverse("a")).alias("reversed"), compare.bags_equal(F.col("a"), F.array_distinct("a")).alias("once"))


def model_roundtrip(spark, sf_dir):
    """The model written as XMI and read back: all its features, as read."""
    m = _shop(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: it writes and reads the file itself
        xmi.write(m, f"{folder}/model.xmi")
        back = xmi.read(spark, f"{folder}/model.xmi")
    held = F.array_join(F.transform("targets", lambda t: F.concat_ws(".", t.entity, t.variation_id.cast("string"))), ",")
    count = back.variations.select("entity", "variation_id", "count")
    return back.features.join(count, ["entity", "variation_id"]).groupBy("entity", "kind", F.coalesce("name", "attribute").alias("name"), "data_type", "refs_to", "optional", F.coalesce(held, F.lit("")).alias("targets")).agg(F.count("*").alias("n"), F.sum("count").alias("count"))


def user_profiles_model(spark, sf_dir):
    """The model of generated user profiles, as many users as customers: counts
    are conserved, half and half."""
    users, movies = documents.user_profiles(spark, table(spark, sf_dir, "customer").count() // 20 * 20)
    made = documents.collections([extract.triples_of_typed(movies, "movie"), extract.triples_of_typed(users, "user")])
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("collection", "signature")).cast("long")
    m = model.infer_model(made.select(at.alias("ord"), "signature", "count", "first_ts", "last_ts"), "profiles", "corrected")
    return m.variations.groupBy("entity").agg(F.sum("count").alias("count"))


QUERIES = {f.__name__: f for f in (entity_types_root, variation_ids, attributes_typed, aggregates_bounds, plist_types, keys, references_by_name, optional_features, optional_tagger, sorted_variations, compare_identical, compare_mutations, compare_names_fuzzy, compare_primitive_synonyms, compare_data_types, compare_orphans, compare_near_targets, compare_relationships, graph_model, bag_match, model_roundtrip, user_profiles_model)}

_ATTRIBUTES = """(VALUES ('Nations', '_id', 'Number', false), ('Nations', 'name', 'String', false), ('Customers', '_id', 'Number', false),
  ('Customers', 'balance', 'Number', false), ('Customers', 'name', 'String', false), ('Customers', 'nation_id', 'Number', false), ('Customers', 'vip', 'Boolean', true),
  ('Address', 'code', 'Number', true), ('Address', 'segment', 'String', false), ('Orders', '_id', 'Number', false), ('Orders', 'customer_id', 'Number', false),
  ('Orders', 'order_date', 'String', false), ('Orders', 'priority', 'String', true), ('Orders', 'status', 'String', false), ('Orders', 'total_price', 'Number', false),
  ('Detail', 'part_id', 'Number', false), ('Detail', 'quantity', 'Number', false), ('Detail', 'supplier_id', 'Number', false), ('Detail', 'discount', 'Number', true)) t(entity, name, data_type, optional)"""

_ORDERS = """SELECT o_orderkey, o_orderpriority <> '4-NOT SPECIFIED' AS p, coalesce(items, '') AS items FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(d::VARCHAR, ',' ORDER BY place) AS items FROM (
    SELECT l_orderkey, l_discount > 0 AS d, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity}) AS place FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey"""

_SAME = """WITH v AS (SELECT c_custkey % 2 = 0 AS code, c_acctbal > 5000 AS vip, count(*) AS n FROM customer GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY vip ORDER BY code DESC) AS place, first_value(n) OVER (PARTITION BY vip ORDER BY code DESC) AS first_n FROM v),"""

ORACLES = {
    "entity_types_root": "SELECT * FROM (VALUES ('Nations', true), ('Customers', true), ('Orders', true), ('Address', false), ('Detail', false)) t(name, root)",
    "compare_identical": f"""{_SAME}
x AS (SELECT 1)
SELECT true AS equivalent, (SELECT count(*) FROM a WHERE n <> first_n) AS n_counts, (SELECT count(*) FROM a WHERE place > 1) AS n_orphans""",
    "keys": f"SELECT 'Nations' AS entity, '_id' AS attribute, 1::BIGINT AS n UNION ALL SELECT 'Customers', '_id', count(DISTINCT (c_acctbal > 5000, c_custkey % 2)) FROM customer UNION ALL SELECT 'Orders', '_id', count(DISTINCT (p, items)) FROM ({_ORDERS}) WHERE items <> ''",
    "references_by_name": "SELECT * FROM (VALUES ('Customers', 'nation_id', 'Nations', 1, 1), ('Orders', 'customer_id', 'Customers', 1, 1), ('Orders', 'order_date', 'Orders', 1, 1)) t(entity, attribute, refs_to, lower, upper)",
    "variation_ids": f"""
SELECT 'Nations' AS entity, 1::BIGINT AS n, 1::INT AS last_id, count(*)::BIGINT AS count FROM nation
UNION ALL SELECT 'Customers', count(DISTINCT (c_acctbal > 5000, c_custkey % 2)), count(DISTINCT (c_acctbal > 5000, c_custkey % 2)), count(*) FROM customer
UNION ALL SELECT 'Address', 2, 2, count(*) FROM customer
UNION ALL SELECT 'Orders', count(DISTINCT (p, items)) FILTER (WHERE items <> ''), count(DISTINCT (p, items)) FILTER (WHERE items <> ''), count(*) FROM ({_ORDERS})
UNION ALL SELECT 'Detail', 2, 2, count(*) FROM (SELECT DISTINCT l_orderkey, l_discount > 0 FROM lineitem)""",
    "compare_mutations": f"""{_SAME}
m(mutation) AS (VALUES ('schema renamed'), ('entity dropped'), ('renamed far'), ('renamed near'), ('root flipped'), ('count bumped')),
d AS (
  SELECT mutation, 'COUNT' AS category, false AS fatal FROM m, a WHERE n <> first_n
  UNION ALL SELECT mutation, 'VARIATION', false FROM m, a WHERE place > 1
  UNION ALL SELECT * FROM (VALUES ('schema renamed', 'SCHEMA_NAME', true), ('entity dropped', 'ENTITY', true), ('entity dropped', 'ENTITY', true), ('renamed far', 'ENTITY', true),
    ('renamed near', 'ENTITY', false), ('root flipped', 'ROOT', false), ('count bumped', 'COUNT', false), ('variation dropped', 'VARIATION', true))
  -- the first variation is gone: its like without a code comes first now, and the others of that kind find it
  UNION ALL SELECT 'variation dropped', 'VARIATION', true FROM a WHERE place = 1 AND vip AND (SELECT count(*) FROM a WHERE vip) = 1
  UNION ALL SELECT 'variation dropped', 'COUNT', false FROM a WHERE vip AND place = 1 AND n <> (SELECT n FROM a WHERE vip AND place = 2)
  UNION ALL SELECT 'variation dropped', 'COUNT', false FROM a WHERE NOT vip AND n <> first_n
  UNION ALL SELECT 'variation dropped', 'VARIATION', false FROM a WHERE NOT vip AND place > 1
  -- no customer finds its like
  UNION ALL SELECT 'type changed', 'VARIATION', f FROM a, (VALUES (true), (false)) t(f))
SELECT mutation, category, fatal, count(*) AS n FROM d GROUP BY ALL""",
    "model_roundtrip": """
WITH c AS (SELECT c_custkey % 2 = 0 AS code, c_acctbal > 5000 AS vip, count(*) AS n FROM customer GROUP BY 1, 2),
ids AS (SELECT code, row_number() OVER (ORDER BY code DESC) AS id FROM (SELECT DISTINCT code FROM c)),
f AS (
  SELECT 'Customers' AS entity, t.*, n FROM c, (VALUES ('Attribute', '_id', 'Number', NULL), ('Key', '_id', NULL, NULL), ('Attribute', 'balance', 'Number', NULL), ('Attribute', 'name', 'String', NULL),
    ('Attribute', 'nation_id', 'Number', NULL), ('Reference', 'nation_id', NULL, 'Nations')) t(kind, name, data_type, refs_to)
  UNION ALL SELECT 'Customers', 'Attribute', 'vip', 'Boolean', NULL, n FROM c WHERE vip
  UNION ALL SELECT 'Nations', t.*, (SELECT count(*) FROM nation) FROM (VALUES ('Attribute', '_id', 'Number', NULL), ('Key', '_id', NULL, NULL), ('Attribute', 'name', 'String', NULL)) t
  UNION ALL SELECT 'Address', 'Attribute', 'segment', 'String', NULL, sum(n) FROM c GROUP BY code
  UNION ALL SELECT 'Address', 'Attribute', 'code', 'Number', NULL, sum(n) FROM c WHERE code GROUP BY code),
p AS (SELECT *, CASE WHEN name = 'vip' THEN (SELECT count(DISTINCT vip) FROM c) > 1 WHEN name = 'code' THEN (SELECT count(DISTINCT code) FROM c) > 1 ELSE false END AS optional, '' AS targets FROM f
  UNION ALL SELECT 'Customers', 'Aggregate', 'address', NULL, NULL, n, false, 'Address.' || id FROM c JOIN ids USING (code))
SELECT entity, kind, name, data_type, refs_to, optional, targets, count(*) AS n, sum(n)::BIGINT AS count FROM p GROUP BY entity, kind, name, data_type, refs_to, optional, targets""",
    "sorted_variations": "SELECT s_suppkey, s_nationkey AS entity, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN floor(s_acctbal)::BIGINT ELSE 0 END, s_suppkey)::INT AS variation_id FROM supplier",
    "optional_tagger": """
WITH r AS (SELECT DISTINCT l_partkey % 50 AS entity, l_orderkey % 40 AS v, round(l_discount * 100)::INT AS name FROM lineitem),
t AS (SELECT entity, count(DISTINCT v) AS total FROM r GROUP BY 1)
SELECT entity, name FROM r JOIN t USING (entity) GROUP BY entity, name, total HAVING total > 1 AND count(*) <> total""",
    "compare_names_fuzzy": """
SELECT n_nationkey, n_name, other, lower(n_name) = lower(other) OR ((contains(lower(n_name), lower(other)) OR contains(lower(other), lower(n_name))) AND abs(length(n_name) - length(other)) < 3) AS same
FROM (SELECT n_nationkey, n_name, unnest([lower(n_name), n_name || 'S', n_name || 'LAND', substr(n_name, 2), 'x']) AS other FROM nation)""",
    "compare_primitive_synonyms": "SELECT * FROM (VALUES ('Long', 'integer', true), ('Number', 'LONG', true), ('float', 'Double', true), ('String', 'string', true), ('Date', 'date', false), ('String', 'Number', false), (NULL, NULL, true), ('String', NULL, false)) t(a, b, same)",
    "compare_orphans": """
WITH s AS (SELECT s_nationkey AS k, s_suppkey, s_suppkey % 7 AS n, s_suppkey % 3 AS a, s_suppkey % 2 AS b FROM supplier),
first AS (SELECT k, b, arg_min(n, s_suppkey) AS n, min(s_suppkey) AS key FROM s GROUP BY 1, 2),
hit AS (SELECT s.k, s.n AS own, first.n AS n, first.key FROM s LEFT JOIN first ON first.k = s.k AND first.b = s.a),
d AS (SELECT 'VARIATION' AS category, true AS fatal FROM hit WHERE key IS NULL
  UNION ALL SELECT 'COUNT', false FROM hit WHERE own <> n
  UNION ALL SELECT 'VARIATION', false FROM s WHERE s_suppkey NOT IN (SELECT key FROM hit WHERE key IS NOT NULL))
SELECT category, fatal, count(*) AS n FROM d GROUP BY ALL""",
    "compare_near_targets": """
WITH t AS (SELECT lower(n_name) AS a, lower(unnest([lower(n_name), n_name || 'S', n_name || 'LAND', substr(n_name, 2), 'x'])) AS b FROM nation),
far AS (SELECT * FROM t WHERE NOT (a = b OR ((contains(a, b) OR contains(b, a)) AND abs(length(a) - length(b)) < 3)))
SELECT 'VARIATION' AS category, f AS fatal, count(*) AS n FROM far, (VALUES (true), (false)) x(f) GROUP BY f""",
    "compare_data_types": """
WITH k AS (SELECT p_partkey, ['Long', 'integer', 'Float', 'string', 'Date'] AS raw, ['number', 'number', 'double', 'string', 'Date'] AS own, (p_partkey % 7 % 5 + 1)::INT AS a, (p_partkey % 11 % 5 + 1)::INT AS b, (p_partkey % 13 % 5 + 1)::INT AS c FROM part)
SELECT p_partkey, 'PMap<' || raw[a] || ',PList<PTuple<' || raw[b] || ',' || raw[c] || '>>>' AS type,
  'PMap<' || own[a] || ',PList<PTuple<' || least(own[b], own[c]) || ',' || greatest(own[b], own[c]) || '>>>' AS canonical FROM k""",
    "graph_model": f"""
WITH n AS (
  SELECT 'Customer' AS owner, c_acctbal > 5000 AS p, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS r, 2 AS props, 1 AS refs, 1 AS more FROM customer
  UNION ALL SELECT 'Order', o_orderpriority <> '4-NOT SPECIFIED', EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey), 2, 0, 2 FROM orders
  UNION ALL SELECT 'Part', false, false, 2, 0, 0 FROM part UNION ALL SELECT 'Supplier', false, false, 1, 1, 0 FROM supplier UNION ALL SELECT 'Nation', false, false, 1, 0, 0 FROM nation),
v AS (SELECT owner, p, r, props + p::INT AS n_attributes, refs + more * r::INT AS n_references, count(*) AS count FROM n GROUP BY owner, p, r, props, refs, more)
SELECT owner, count, n_attributes::BIGINT AS n_attributes, (p AND EXISTS (SELECT 1 FROM v w WHERE w.owner = v.owner AND NOT w.p))::BIGINT AS n_optional, n_references::BIGINT AS n_references FROM v
UNION ALL SELECT 'PLACED', count(DISTINCT o_custkey), 0, 0, 0 FROM orders
UNION ALL SELECT 'CONTAINS', count(DISTINCT l_orderkey), 1, 0, 0 FROM lineitem
UNION ALL SELECT 'SUPPLIED_BY', count(DISTINCT l_orderkey), 0, 0, 0 FROM lineitem
UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), 0, 0, 0""",
    "compare_relationships": """
WITH n AS (SELECT (SELECT min(1) FROM orders) + (SELECT min(2) FROM lineitem) + (SELECT min(1) FROM customer) AS n)
SELECT 'dropped' AS mutation, 'RELATIONSHIP' AS category, true AS fatal, 2::BIGINT AS n
UNION ALL SELECT 'renamed near', 'RELATIONSHIP', true, 1
UNION ALL SELECT 'counts bumped', 'COUNT', false, n FROM n
UNION ALL SELECT 'type changed', 'VARIATION', f, 1 FROM (VALUES (true), (false)) t(f)""",
    "bag_match": "SELECT l_orderkey, true AS reversed, count(*) = count(DISTINCT l_partkey) AS once FROM lineitem GROUP BY 1",
    "attributes_typed": f"SELECT entity, name, data_type FROM {_ATTRIBUTES}",
    "plist_types": "SELECT 'Orders' AS entity, 'details' AS name, 'PList<>' AS data_type WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))",
    "optional_features": f"SELECT entity, name, data_type, optional FROM {_ATTRIBUTES}",
    "aggregates_bounds": "SELECT * FROM (VALUES ('Customers', 'address', 1, 1, 'Address'), ('Orders', 'details', 0, -1, 'Detail')) t(entity, name, lower, upper, target)",
    "user_profiles_model": "WITH n AS (SELECT count(*) // 20 * 20 AS n FROM customer) SELECT 'User' AS entity, n::BIGINT AS count FROM n UNION ALL SELECT 'Movie', n // 2 FROM n UNION ALL SELECT 'Address', n FROM n UNION ALL SELECT 'Watchedmovie', n - n // 20 * 3 FROM n",
}
