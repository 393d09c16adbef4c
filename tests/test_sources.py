import pytest
from pyspark.sql import functions as F

from shapewright.operators import compare
from shapewright.operators.model import FEATURES, VARIATIONS, Model
from shapewright.sources import documents, xmi


def test_json_collection_keeps_absent_and_null_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":null}\n{}\nnot json\n')
    rows = documents.json_collection(spark, str(tmp_path), "c").select(F.to_json("doc").alias("d")).collect()
    assert sorted(str(r.d) for r in rows) == ["None", '{"x":null}', "{}"]


def test_embedding_gives_empty_arrays(spark):
    parents, children = spark.range(2), spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "p long, n int, v string")
    got = documents.embed(parents, children, "id", "p", "items", [F.col("v")], "n").orderBy("id").collect()
    assert [[x.v for x in r["items"]] for r in got] == [["a", "b"], []]


def test_database_names():
    assert documents.check_name("shop") == "shop"
    for bad in ("", "a/b", "..", "a\\b", "a\nb"):
        with pytest.raises(ValueError):
            documents.check_name(bad)


def test_graph_counts_sources_not_edges(spark):
    from shapewright.operators import extract

    none = F.create_map().cast("map<string,string>")
    nodes = spark.createDataFrame([("u1", "User"), ("u2", "User"), ("m1", "Movie"), ("m2", "Movie")], "id string, label string").withColumn("props", none)
    edges = spark.createDataFrame([("u1", "m1", "WATCHED"), ("u1", "m2", "WATCHED")], "src string, dst string, type string").withColumn("props", none)
    rels = extract.graph_relationships(nodes, edges).collect()
    assert [(r["count"], r.n_edges) for r in rels] == [(1, 2)]
    users = extract.graph_entity_variations(nodes, edges).where("entity = 'User'").collect()
    assert {(r.relationships, r["count"]) for r in users} == {("WATCHED->Movie", 1), ("", 1)}


def test_xmi_round_trip(spark, tmp_path):
    types = spark.createDataFrame([(0, "A", True), (1, "B", False)], "entity_id int, name string, root boolean")
    variations = spark.createDataFrame([("A", 1, 5, 0, 0, None), ("B", 1, 5, 0, 0, None)], VARIATIONS)
    rows = [("A", 1, 0, "Attribute", "_id", "Number", None, None, False, None, None, None), ("A", 1, 1, "Key", None, None, None, None, False, None, None, "_id"), ("A", 1, 2, "Aggregate", "b", None, 0, -1, True, [("B", 1)], None, None), ("A", 1, 3, "Attribute", "t", "PTuple<String,Number>", None, None, False, None, None, None), ("B", 1, 0, "Attribute", "a_id", "PList<>", None, None, False, None, None, None), ("B", 1, 1, "Reference", None, None, 0, -1, False, None, "A", "a_id")]
    m = Model("m", types, variations, spark.createDataFrame([(*r, None, None) for r in rows], FEATURES))
    path = str(tmp_path / "new" / "m.xmi")
    xmi.write(m, path)
    back = xmi.read(spark, path)
    assert sorted(back.features.collect(), key=str) == sorted(m.features.collect(), key=str)
    assert compare.compare(m, back).count() == 0
