import json

import pytest
from pyspark.sql import functions as F

from shapewright.operators import extract, infer, model, signature
from shapewright.streaming.skeletons import stream_counts


def triples(spark, rows):
    return spark.createDataFrame([(i, json.dumps(s), *m) for i, (s, m) in enumerate(rows)], "ord long, schema string, count long, first_ts long, last_ts long")


def found(spark, rows, **options):
    got = infer.infer(triples(spark, rows), **options).collect()
    return {(r.entity, tuple(f[0] for f in json.loads(r.sig)["f"])): (r["count"], r.first_ts, r.last_ts) for r in got}


def nodes(value, entity=None):
    out = []
    signature.walk(value, "", signature.Namer(), out, root=True, entity=entity)
    return out


def test_names_and_order():
    assert nodes({"_type": "orders", "x": 1})[0][:2] == ("Orders", True)
    assert nodes({"x": 1})[0][0] == ""
    assert [n[0] for n in nodes({"_type": "c", "endereco": {"rua": "A"}})] == ["Endereco", "C"]
    assert [n[0] for n in nodes({"_type": "c", "items": [{"sku": 1}, {"sku": 2}]})][0] == "Item"
    assert [f[0] for f in json.loads(nodes({"_type": "t", "z": 1, "a": 1, "m": 1})[0][3])["f"]] == ["a", "m", "z"]
    assert [f[0] for f in json.loads(nodes({"": 1, "\U00010000": 1})[0][3])["f"]] == ["\U00010000", ""]


def test_arrays_keep_distinct_elements_in_order():
    sig = lambda v: json.loads(nodes({"x": v})[-1][3])["f"][0][1]
    assert sig([]) == {"a": []}
    assert sig(["x"]) == sig(["x", "y", "z"]) == {"a": ["S"]}
    assert sig(["x", 1, "y"]) == {"a": ["S", "N"]}
    assert len(sig([{"sku": 1}, {"nome": 1}])["a"]) == 2
    assert sig("oid") == "O" and sig("OID") == "S" and sig(True) == "B" and sig(None) == "0"


def test_collapse_and_propagation(spark):
    two = [({"_type": "t", "x": 1}, (3, 10, 20)), ({"_type": "t", "x": 1}, (2, 5, 30))]
    assert found(spark, two) == {("T", ("x",)): (3, 10, 20)}
    assert found(spark, two, mode="sum") == {("T", ("x",)): (5, 5, 30)}
    inner = [({"_type": "c", "address": {"city": "s"}}, (99, 10, 20))]
    assert found(spark, inner)[("Address", ("city",))] == (99, 10, 20)
    shared = [({"_type": "c", "address": {"a": 1}}, (1, 0, 0)), ({"_type": "c", "address": {"a": 1}, "x": 1}, (1, 0, 0))]
    assert found(spark, shared)[("Address", ("a",))][0] == 2


def test_metadata_fold(spark):
    rows = spark.createDataFrame([(1, 1, 5, 100), (2, 1, 1, 0), (3, 1, 0, 7)], "ord long, count long, first_ts long, last_ts long")
    got = rows.agg(infer.folded(F.array_sort(F.collect_list(F.struct("ord", "count", "first_ts", "last_ts")))).alias("m")).first().m
    assert tuple(got) == (3, 0, 100)


def test_alias_join(spark):
    rows = [({"_type": "p", "hasAddress": {"city": "s"}}, (1, 0, 0)), ({"_type": "address", "city": "s", "zip": "s"}, (1, 0, 0))]
    assert {e for e, _ in found(spark, rows)} == {"P", "Address"}
    assert {e for e, _ in found(spark, rows, join_aliases=False)} == {"P", "Hasaddress", "Address"}
    names = spark.createDataFrame([("List", 0, False), ("Of", 1, False), ("listoflist", 2, True)], "entity string, ord int, inner boolean")
    assert [tuple(r) for r in infer.aliases(names).collect()] == [("listoflist", "List")]


def test_merge(spark):
    arrays = [({"_type": "t", "a": [], "z": 1}, (1, 1, 1)), ({"_type": "t", "a": ["s"], "z": 1}, (2, 2, 2)), ({"_type": "t", "a": [], "z": "s"}, (4, 4, 4))]
    got = infer.infer(triples(spark, arrays)).collect()
    assert sorted((r["count"], len(r.was)) for r in got) == [(3, 2), (4, 1)]
    hetero = [({"_type": "t", "a": [1, "s"]}, (1, 0, 0)), ({"_type": "t", "a": [1]}, (1, 0, 0))]
    assert len(infer.infer(triples(spark, hetero)).collect()) == 2
    both = [({"_type": "t", "a": [], "b": ["s"]}, (1, 0, 0)), ({"_type": "t", "a": [], "b": []}, (1, 0, 0))]
    assert len(infer.infer(triples(spark, both)).collect()) == 1


def test_triples_are_checked_by_the_first_row(spark):
    make = lambda rows: spark.createDataFrame(rows, "ord long, schema string, count string, first_ts string, last_ts string")
    good, bad = (1, "{}", "1.9", "0", "0"), (2, "[]", "true", "0", "0")
    assert infer.valid_triples(make([good, bad])).first().valid
    assert not infer.valid_triples(make([bad])).first().valid
    assert infer.valid_triples(make([good]).limit(0)).first().valid
    assert infer.read_triples(make([good])).first()["count"] == 1
    with pytest.raises(ValueError):
        infer.read_triples(make([bad]))


def test_typed_signatures_are_those_of_json(spark):
    docs = spark.sql("""select 1 as _id, 'a' as name, named_struct('city', 's', 'zip', cast(null as string)) as address, array(named_struct('sku', 1, 'q', cast(null as int)), named_struct('sku', 1, 'q', 2)) as items
        union all select 2, null, null, array()""")
    typed = docs.select(signature.typed(docs.schema, "T").alias("signature")).collect()
    text = docs.select(F.lit("t").alias("collection"), F.to_json(F.struct("*")).alias("doc"))
    assert {r.signature for r in signature.signatures(text).collect()} == {r.signature for r in typed}


def test_null_and_bad_documents_have_no_signature(spark):
    docs = spark.createDataFrame([("c", None), ("c", "{"), ("c", "[1]"), ("c", "{}")], "collection string, doc string")
    assert [r.signature is None for r in signature.signatures(docs).collect()] == [True, True, True, False]
    assert extract.triples_of_json(docs).count() == 1
    assert extract.triples_of_json(docs.limit(0)).count() == 0


def test_object_id_seconds(spark):
    rows = spark.createDataFrame([("5f5e1000" + "0" * 16,), ("x",), (None,)], "i string")
    assert [r[0] for r in rows.select(extract.oid_seconds("i")).collect()] == [0x5F5E1000, 0, 0]


def test_minimal_model(spark):
    oid = {"$oid": "6a2f1b17" + "0" * 16}
    docs = [("products", {"_id": oid, "price": 1, "stock": 1, "title": "s"}), ("products", {"_id": oid, "price": 1, "tags": ["a", "b"], "title": "s"}), ("customers", {"_id": oid, "city": "s", "name": "s", "orders": 1, "vip": True}), ("customers", {"_id": oid, "city": "s", "name": "s"}), ("customers", {"_id": oid, "city": "s", "name": "s", "orders": 1})]
    made = extract.triples_of_json(spark.createDataFrame([(c, json.dumps(d)) for c, d in docs], "collection string, doc string"))
    m = model.infer_model(made.withColumn("ord", F.monotonically_increasing_id()))
    assert {(r.name, r.root) for r in m.entity_types.collect()} == {("Products", True), ("Customers", True), ("_id", False)}
    assert {(r.entity, r.n, r.c) for r in m.variations.groupBy("entity").agg(F.count("*").alias("n"), F.sum("count").alias("c")).collect()} == {("Products", 2, 2), ("Customers", 3, 3), ("_id", 1, 5)}
    f = m.features.collect()
    assert {(r.entity, r.name) for r in f if r.optional} == {("Products", "stock"), ("Products", "tags"), ("Customers", "orders"), ("Customers", "vip")}
    assert {(r.lower, r.upper, r.targets[0].entity) for r in f if r.kind == "Aggregate"} == {(1, 1, "_id")}
    assert not [r for r in f if r.kind == "Key"] and {r.data_type for r in f if r.name == "tags"} == {"PList<String>"}


def test_references(spark):
    names = spark.createDataFrame([(0, "Customer", True), (1, "a.b", True), (2, "Inner", False)], "entity_id int, name string, root boolean")
    fields = spark.createDataFrame([("customerId",), ("hasCustomer",), ("CUSTOMERID",), ("customerCount",), ("totalPrice",), ("aXb_id",), ("inner_id",)], "name string")
    got = {r.name: r.refs_to for r in model.references(fields, model.reference_patterns(names)).collect()}
    assert got == {"customerId": "Customer", "hasCustomer": "Customer", "CUSTOMERID": "Customer", "aXb_id": "a.b"}


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":1}\n{"x":2}\n{"y":1}\n')
    docs = spark.readStream.text(str(tmp_path)).selectExpr("'c' as collection", "value as doc")
    query = stream_counts(docs).writeStream.format("memory").queryName("skeletons").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["count"] for r in spark.table("skeletons").collect()) == [1, 2]
