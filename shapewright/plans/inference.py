"""Queries of extraction and inference over documents made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.operators import extract, infer, signature
from shapewright.sources import documents
from shapewright.sources.documents import table
from shapewright.tables import cut


def skeleton_counts_orders(spark, sf_dir):
    """Structural variations of orders with counts; flagship."""
    return extract.triples_of_typed(documents.orders_docs(spark, sf_dir), "orders").drop("collection")


def skeleton_counts_customers(spark, sf_dir):
    """From JSON text, by the Arrow path; object ids give the times."""
    return extract.triples_of_json(documents.customers_docs(spark, sf_dir)).drop("collection")


def skeleton_counts_conversations(spark, sf_dir):
    return extract.triples_of_typed(documents.conversations_docs(spark, sf_dir), "conversations").drop("collection")


def skeleton_counts_events(spark, sf_dir):
    """Arrays that are empty, homogeneous or mixed stay different structures."""
    return extract.triples_of_json(documents.events_docs(spark, sf_dir)).drop("collection")


def classify_kinds(spark, sf_dir):
    """Kinds of the values of event documents, by field."""
    documents.events_docs(spark, sf_dir).select(F.try_parse_json("doc").alias("v")).createOrReplaceTempView("_shapewright_events")
    rows = spark.sql("SELECT key, value FROM _shapewright_events, LATERAL variant_explode(v)")
    return rows.groupBy("key", signature.classify("value").alias("kind")).agg(F.count("*").alias("n"))


def event_props_shapes(spark, sf_dir):
    shape = F.schema_of_variant(F.try_parse_json("props"))
    return table(spark, sf_dir, "events").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def field_order(spark, sf_dir):
    """Keys of customer documents in signature order."""
    key = F.explode(F.json_object_keys("doc")).alias("name")
    names = documents.customers_docs(spark, sf_dir).select(key).distinct()
    return names.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(signature.field_order("name"))).alias("place"))


def oid_timestamps(spark, sf_dir):
    docs = documents.customers_docs(spark, sf_dir)
    return docs.select("c_custkey", extract.oid_seconds(F.get_json_object("doc", "$['_id']['$oid']")).alias("seconds"))


def relational_to_documents(spark, sf_dir):
    docs = documents.orders_docs(spark, sf_dir)
    return docs.select(F.col("_id").alias("order_id"), F.size("details").alias("n_details"), F.array_join(F.transform("details", lambda x: x.part_id.cast("string")), ",").alias("parts"))


def array_element_dedup(spark, sf_dir):
    """Distinct element signatures of each order's items, in order."""
    docs = documents.orders_docs(spark, sf_dir)
    item = F.transform("details", lambda x: F.when(x.discount.isNull(), "plain").otherwise("discounted"))
    return docs.select(F.col("_id").alias("order_id"), F.array_join(F.array_distinct(item), ",").alias("shapes"))


def array_shape(spark, sf_dir):
    """Homogeneity, size and inner kinds of each event's tags, added one by one."""
    tags = F.variant_get(F.try_parse_json("doc"), "$.tags", "array<variant>")
    rows = documents.events_docs(spark, sf_dir).select("event_id", signature.array_shape(tags).alias("s"))
    return rows.select("event_id", "s.homogeneous", "s.size", F.array_join("s.inners", ",").alias("inners"))


def _order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple per order status and priority: many share a structure."""
    o = table(spark, sf_dir, "orders")
    some = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    schema = F.concat(F.lit('{"_type":"orders","_id":0,"status":"s"'), F.when(some, ',"priority":"s"').otherwise(""), F.lit(',"customer":{"id":0'), F.when(F.col("o_orderstatus") == "F", ',"since":"s"').otherwise(""), F.lit("}}"))
    rows = o.groupBy("o_orderstatus", "o_orderpriority", schema.alias("schema")).agg(F.count("*").alias("count"), F.min(F.year("o_orderdate")).cast("long").alias("first_ts"), F.max(F.year("o_orderdate")).cast("long").alias("last_ts"))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o_orderstatus", "o_orderpriority")).cast("long")  # a row per status and priority
    return rows.select(at.alias("ord"), "schema", "count", "first_ts", "last_ts")


_TRIPLES_SQL = """
t AS (SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) AS ord, o_orderpriority <> '4-NOT SPECIFIED' AS has_p, o_orderstatus = 'F' AS since,
  count(*) AS count, min(year(o_orderdate)) AS first_ts, max(year(o_orderdate)) AS last_ts FROM orders GROUP BY o_orderstatus, o_orderpriority)"""


def triples_validate_first_row(spark, sf_dir):
    rows = _order_triples(spark, sf_dir)
    fine = rows.select("ord", "schema", *[F.col(c).cast("string").alias(c) for c in ("count", "first_ts", "last_ts")])
    later = fine.withColumn("count", F.when(F.col("ord") == 2, "true").otherwise(F.col("count")))
    first = fine.withColumn("count", F.when(F.col("ord") == 1, "true").otherwise(F.col("count")))
    cases = [("as it is", fine), ("later row bad", later), ("first row bad", first), ("empty", fine.limit(0))]
    return documents.collections([infer.valid_triples(x).select(F.lit(k).alias("rows"), "valid") for k, x in cases])


def _variations(found: DataFrame) -> DataFrame:
    return found.select("entity", F.array_join(F.transform(F.from_json(F.get_json_object("sig", "$.f"), "array<array<string>>"), lambda f: f[0]), ",").alias("fields"), "count", "first_ts", "last_ts")


def collapse_first_meta(spark, sf_dir):
    return _variations(infer.collapse(infer.objects(_order_triples(spark, sf_dir)), "first").where("is_root"))


def collapse_sum_meta(spark, sf_dir):
    return _variations(infer.collapse(infer.objects(_order_triples(spark, sf_dir)), "sum").where("is_root"))


def entity_names(spark, sf_dir):
    """Entities of order documents: the collection capitalised, elements of
    arrays singular."""
    made = extract.triples_of_typed(documents.orders_docs(spark, sf_dir), "orders").withColumn("ord", F.monotonically_increasing_id())
    return infer.objects(made).groupBy("entity", "is_root").agg(F.countDistinct("sig").alias("n_shapes"))


def inner_entities(spark, sf_dir):
    return infer.inner_entities(infer.objects(_order_triples(spark, sf_dir)))


def inner_count_propagation(spark, sf_dir):
    """Inner variations with the metadata of their containers (counts conserved)."""
    found = infer.infer(_order_triples(spark, sf_dir), "sum", join_aliases=False, merging=False)
    return _variations(found.where("not is_root"))


def alias_join(spark, sf_dir):
    """Names of nations as entities, with every third also under an alias."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("ord"), F.lit(False).alias("inner"))
    more = n.where("ord % 3 = 0").select(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("has"), "entity")).otherwise(F.concat("entity", F.lit("ListOf"))).alias("entity"), (F.col("ord") + 1000).alias("ord"), F.lit(True).alias("inner"))
    return infer.aliases(n.unionByName(more))


def metadata_fold_m1(spark, sf_dir):
    """Ordered combination of the order metadata per customer; every seventh
    order's times are unknown (zero) and replace an earlier first time."""
    o = table(spark, sf_dir, "orders")
    ts = F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.datediff("o_orderdate", F.lit("1970-01-01")) * 86400).cast("long")
    one = F.struct(F.col("o_orderkey").alias("ord"), F.lit(1).cast("long").alias("count"), ts.alias("first_ts"), ts.alias("last_ts"))
    folded = o.groupBy("o_custkey").agg(infer.folded(F.array_sort(F.collect_list(one))).alias("m"))
    return folded.select("o_custkey", "m.count", "m.first_ts", "m.last_ts")


def _supplier_variations(spark, sf_dir, *arrays) -> DataFrame:
    """A structure per supplier, its nation the entity, with arrays of texts that
    are empty where a condition holds, merged."""
    s = table(spark, sf_dir, "supplier")
    fields = [F.concat(F.lit(f',"t{i}":'), F.when(empty, "[]").otherwise('["s"]')) for i, empty in enumerate(arrays)]
    schema = F.concat(F.lit('{"_type":"s'), F.col("s_nationkey").cast("string"), F.lit('"'), *fields, F.lit("}"))
    at = F.when(F.col("s_suppkey") < 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1)  # a time of zero is unknown, a key of zero is not
    made = s.select(F.col("s_suppkey").alias("ord"), schema.alias("schema"), F.lit(1).cast("long").alias("count"), at.alias("first_ts"), at.alias("last_ts"))
    key = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.col(c) - 1)
    return infer.merge(infer.collapse(infer.objects(made), "sum")).withColumns({c: key(c) for c in ("first_ts", "last_ts")})


def merge_empty_arrays(spark, sf_dir):
    """Empty and filled arrays are one variation."""
    return _supplier_variations(spark, sf_dir, F.col("s_suppkey") % 2 == 0).select("entity", "count", "first_ts", "last_ts", F.size("was").alias("n_merged"))


def merge_loose(spark, sf_dir):
    """Two arrays, either of them empty or both: still one variation, whose
    arrays are filled from each other."""
    found = _supplier_variations(spark, sf_dir, F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0)
    return found.select("entity", "count", F.size("was").alias("n_merged"), F.contains("sig", F.lit("[]")).alias("still_empty"))


def conformance_check(spark, sf_dir):
    """Order documents whose structure no inferred root variation has."""
    from shapewright.operators import model

    counted = cut(extract.triples_of_typed(documents.orders_docs(spark, sf_dir), "orders"))
    triples = counted.withColumn("ord", F.monotonically_increasing_id())
    return model.conformance(counted, infer.infer(triples, "sum", merging=False))


def graph_entity_variations(spark, sf_dir):
    return extract.graph_entity_variations(*documents.graph(spark, sf_dir))


def graph_relationship_counts(spark, sf_dir):
    return extract.graph_relationships(*documents.graph(spark, sf_dir)).select("type", "src_label", "dst_label", "count", "n_edges")


def graph_edge_properties(spark, sf_dir):
    return extract.graph_relationships(*documents.graph(spark, sf_dir)).groupBy("type", "properties").agg(F.sum("count").alias("count"))


def graph_isolated_nodes(spark, sf_dir):
    found = extract.graph_entity_variations(*documents.graph(spark, sf_dir)).where("relationships = ''")
    return found.groupBy("entity").agg(F.sum("count").alias("count"))


QUERIES = {f.__name__: f for f in (skeleton_counts_orders, skeleton_counts_customers, skeleton_counts_conversations, skeleton_counts_events, classify_kinds, event_props_shapes, field_order, oid_timestamps, relational_to_documents, array_element_dedup, array_shape, triples_validate_first_row, collapse_first_meta, collapse_sum_meta, entity_names, inner_entities, inner_count_propagation, alias_join, metadata_fold_m1, merge_empty_arrays, merge_loose, conformance_check, graph_entity_variations, graph_relationship_counts, graph_edge_properties, graph_isolated_nodes)}

_ITEM = """'{"e":"Detail","r":0,"f":[' || CASE WHEN d THEN '["discount","N"],' ELSE '' END || '["part_id","N"],["quantity","N"],["supplier_id","N"]]}'"""
_SHAPES = "SELECT l_orderkey, l_discount > 0 AS d, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity}) AS place FROM lineitem GROUP BY 1, 2"
_NODE = "(SELECT 'Customer' AS entity, c_custkey AS k, 'balance:double,name:string' || CASE WHEN c_acctbal > 5000 THEN ',vip:boolean' ELSE '' END AS properties FROM customer)"
_ORDER_RELS = "SELECT o_orderkey, CASE WHEN l.l_orderkey IS NULL THEN '' ELSE 'CONTAINS->Part,SUPPLIED_BY->Supplier' END AS r, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'priority:string,' ELSE '' END || 'status:string,total:double' AS p FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o_orderkey"

ORACLES = {
    "skeleton_counts_orders": f"""
WITH s AS (SELECT l_orderkey, string_agg({_ITEM}, ',' ORDER BY place) AS items FROM ({_SHAPES}) GROUP BY 1)
SELECT '{{"e":"Orders","r":1,"f":[["_id","N"],["customer_id","N"],["details",{{"a":[' || coalesce(items, '') || ']}}],["order_date","S"],' ||
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN '["priority","S"],' ELSE '' END || '["status","S"],["total_price","N"]]}}' AS signature,
  count(*) AS count, 0::BIGINT AS first_ts, 0::BIGINT AS last_ts
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1""",
    "skeleton_counts_customers": """
SELECT '{"e":"Customers","r":1,"f":[["_id",' || CASE WHEN c_custkey % 3 = 0 THEN '{"e":"_id","r":0,"f":[["$oid","S"]]}' ELSE '"N"' END ||
  '],["address",{"e":"Address","r":0,"f":[' || CASE WHEN c_custkey % 2 = 0 THEN '["code","N"],' ELSE '' END || '["segment","S"]]}],["balance","N"],["name","S"],["nation_id","N"]' ||
  CASE WHEN c_acctbal > 5000 THEN ',["vip","B"]' ELSE '' END || ']}' AS signature, count(*) AS count,
  min(CASE WHEN c_custkey % 3 = 0 THEN 1600000000 + c_custkey ELSE 0 END) AS first_ts, max(CASE WHEN c_custkey % 3 = 0 THEN 1600000000 + c_custkey ELSE 0 END) AS last_ts
FROM customer GROUP BY 1""",
    "skeleton_counts_conversations": """
SELECT '{"e":"Conversations","r":1,"f":[["_id","N"],["turns",{"a":[{"e":"Turn","r":0,"f":[["role","S"],["text","S"]]}]}]]}' AS signature,
  count(DISTINCT conv_id) AS count, 0::BIGINT AS first_ts, 0::BIGINT AS last_ts FROM conversations""",
    "skeleton_counts_events": """
SELECT '{"e":"Events","r":1,"f":[["_id","N"],["props",{"e":"Props","r":0,"f":[["k","N"]]}],["tags",{"a":[' ||
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"S"' ELSE '"S","N"' END || ']}],["type","S"],["user_id","N"],["value","N"]]}' AS signature,
  count(*) AS count, 0::BIGINT AS first_ts, 0::BIGINT AS last_ts FROM events GROUP BY 1""",
    "classify_kinds": "SELECT key, kind, n FROM (VALUES ('_id', 'NUMBER'), ('props', 'OBJECT'), ('tags', 'ARRAY'), ('type', 'TEXTUAL'), ('user_id', 'NUMBER'), ('value', 'NUMBER')) t(key, kind), (SELECT count(*) AS n FROM events)",
    "event_props_shapes": "SELECT 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events WHERE json_structure(props) IS NOT NULL",
    "field_order": "SELECT name, row_number() OVER (ORDER BY name) AS place FROM (VALUES ('_id'), ('name'), ('nation_id'), ('balance'), ('vip'), ('address')) t(name)",
    "oid_timestamps": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1600000000 + c_custkey ELSE 0 END AS seconds FROM customer",
    "relational_to_documents": "SELECT o_orderkey AS order_id, count(l_orderkey)::INT AS n_details, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "array_element_dedup": f"SELECT o_orderkey AS order_id, coalesce(string_agg(CASE WHEN d THEN 'discounted' ELSE 'plain' END, ',' ORDER BY place) FILTER (WHERE d IS NOT NULL), '') AS shapes FROM orders LEFT JOIN ({_SHAPES}) ON l_orderkey = o_orderkey GROUP BY 1",
    "array_shape": "SELECT event_id, event_id % 3 <> 2 AS homogeneous, CASE event_id % 3 WHEN 0 THEN 0 ELSE 2 END::INT AS size, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'TEXTUAL' ELSE 'TEXTUAL,NUMBER' END AS inners FROM events",
    "triples_validate_first_row": "SELECT * FROM (VALUES ('as it is', true), ('later row bad', true), ('first row bad', false), ('empty', true)) t(rows, valid)",
    "collapse_first_meta": f"WITH {_TRIPLES_SQL} SELECT 'Orders' AS entity, CASE WHEN has_p THEN '_id,customer,priority,status' ELSE '_id,customer,status' END AS fields, arg_min(count, ord) AS count, arg_min(first_ts, ord) AS first_ts, arg_min(last_ts, ord) AS last_ts FROM t GROUP BY has_p, since",
    "collapse_sum_meta": f"WITH {_TRIPLES_SQL} SELECT 'Orders' AS entity, CASE WHEN has_p THEN '_id,customer,priority,status' ELSE '_id,customer,status' END AS fields, sum(count)::BIGINT AS count, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM t GROUP BY has_p, since",
    "entity_names": f"""
WITH s AS (SELECT l_orderkey, string_agg(d::VARCHAR, ',' ORDER BY place) AS items FROM ({_SHAPES}) GROUP BY 1)
SELECT 'Orders' AS entity, true AS is_root, count(DISTINCT coalesce(items, '') || (o_orderpriority <> '4-NOT SPECIFIED')::VARCHAR) AS n_shapes FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
UNION ALL SELECT 'Detail', false, count(DISTINCT l_discount > 0) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "inner_entities": "SELECT 'Customer' AS entity",
    "inner_count_propagation": f"WITH {_TRIPLES_SQL} SELECT 'Customer' AS entity, CASE WHEN since THEN 'id,since' ELSE 'id' END AS fields, sum(count)::BIGINT AS count, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM t GROUP BY since",
    "alias_join": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'has' || n_name ELSE n_name || 'ListOf' END AS alias, n_name AS entity FROM nation WHERE n_nationkey % 3 = 0",
    "metadata_fold_m1": """
WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 END AS ts FROM orders),
f AS (SELECT o_custkey, r, 1::BIGINT AS count, ts AS first_ts, ts AS last_ts FROM o WHERE r = 1
  UNION ALL SELECT o.o_custkey, o.r, f.count + 1, CASE WHEN f.first_ts = 0 OR o.ts < f.first_ts THEN o.ts ELSE f.first_ts END, CASE WHEN f.last_ts = 0 OR o.ts > f.last_ts THEN o.ts ELSE f.last_ts END
  FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1)
SELECT o_custkey, max(count) AS count, arg_max(first_ts, r) AS first_ts, arg_max(last_ts, r) AS last_ts FROM f GROUP BY 1""",
    "merge_empty_arrays": "SELECT 'S' || s_nationkey AS entity, count(*) AS count, min(s_suppkey) AS first_ts, max(s_suppkey) AS last_ts, count(DISTINCT s_suppkey % 2)::INT AS n_merged FROM supplier GROUP BY s_nationkey",
    "merge_loose": "SELECT 'S' || s_nationkey AS entity, count(*) AS count, count(DISTINCT (s_suppkey % 2 = 0, s_suppkey % 3 = 0))::INT AS n_merged, bool_and(s_suppkey % 2 = 0) OR bool_and(s_suppkey % 3 = 0) AS still_empty FROM supplier GROUP BY s_nationkey",
    "conformance_check": "SELECT 0::BIGINT AS unmatched",
    "graph_entity_variations": f"""
SELECT entity, properties, 'LOCATED_IN->Nation' || CASE WHEN o IS NULL THEN '' ELSE ',PLACED->Order' END AS relationships, count(*) AS count
  FROM {_NODE} LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = k GROUP BY ALL
UNION ALL SELECT 'Order', p, r, count(*) FROM ({_ORDER_RELS}) GROUP BY ALL
UNION ALL SELECT 'Part', 'name:string,size:integer', '', count(*) FROM part
UNION ALL SELECT 'Supplier', 'name:string', 'LOCATED_IN->Nation', count(*) FROM supplier
UNION ALL SELECT 'Nation', 'name:string', '', count(*) FROM nation""",
    "graph_relationship_counts": """
SELECT 'PLACED' AS type, 'Customer' AS src_label, 'Order' AS dst_label, count(DISTINCT o_custkey) AS count, count(*) AS n_edges FROM orders
UNION ALL SELECT 'CONTAINS', 'Order', 'Part', count(DISTINCT l_orderkey), count(*) FROM lineitem
UNION ALL SELECT 'SUPPLIED_BY', 'Order', 'Supplier', count(DISTINCT l_orderkey), count(*) FROM lineitem
UNION ALL SELECT 'LOCATED_IN', 'Customer', 'Nation', count(DISTINCT c_custkey), count(*) FROM customer
UNION ALL SELECT 'LOCATED_IN', 'Supplier', 'Nation', count(DISTINCT s_suppkey), count(*) FROM supplier""",
    "graph_edge_properties": """
SELECT 'PLACED' AS type, '' AS properties, count(DISTINCT o_custkey)::BIGINT AS count FROM orders
UNION ALL SELECT 'CONTAINS', 'quantity:double', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'SUPPLIED_BY', '', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'LOCATED_IN', '', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""",
    "graph_isolated_nodes": """
SELECT 'Order' AS entity, count(*)::BIGINT AS count FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Nation', count(*) FROM nation""",
}
