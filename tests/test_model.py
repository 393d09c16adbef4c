"""Models: the driver's path against Spark's, comparison, graphs, files, signatures."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.functions import naming
from shapewright.operators import compare, extract, graph, infer, model, signature
from shapewright.sources import xmi

NAMES = "a b _id items orders order_id address hasAddress addressList tags count".split()


def value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [1, "s", True, None, "oid", 2.5][kind]
    if kind == 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: value(rng, depth - 1) for k in rng.sample(NAMES, rng.randrange(1, 4))}


def docs(seed, n=40):
    rng = random.Random(seed)
    return [{"_type": rng.choice(["orders", "customers", "address"])} | {k: value(rng, 3) for k in rng.sample(NAMES, rng.randrange(1, 5))} for _ in range(n)]


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("options", [{}, {"profile": "corrected"}, {"merging": False, "join_aliases": False}])
def test_the_drivers_path_is_sparks(spark, seed, options):
    triples = spark.createDataFrame([(i, json.dumps(d), 1 + i % 5, (i * 7) % 4, (i * 3) % 5) for i, d in enumerate(docs(seed))], "ord long, schema string, count long, first_ts long, last_ts long")
    small, large = (model.infer_model(triples, kept=kept, **options) for kept in (10_000, 0))
    for name in ("entity_types", "variations", "features"):
        assert rows(getattr(small, name)) == rows(getattr(large, name))


def test_raw_rows_are_checked(spark):
    make = lambda rows: spark.createDataFrame(rows, "ord long, schema string, count string, first_ts string, last_ts string")
    assert model.infer_model(make([(1, '{"_type":"t","x":1}', "1.9", "0", "0")])).variations.first()["count"] == 1
    with pytest.raises(ValueError, match="numeric"):
        model.infer_model(make([(1, '{"_type":"t"}', '"x"', "0", "0")]))


def test_nothing_is_optional_without_tags(spark):
    triples = spark.createDataFrame([(0, '{"_type":"t","x":1}', 1, 0, 0), (1, '{"_type":"t"}', 1, 0, 0)], "ord long, schema string, count long, first_ts long, last_ts long")
    for kept in (0, 9):
        assert [r.optional for r in model.infer_model(triples, kept=kept).features.collect()] == [True]
        assert [r.optional for r in model.infer_model(triples, kept=kept, tag=False).features.collect()] == [False]


# --- comparison ---


def test_types():
    assert compare.canonical("PList<PList<Long>>") == compare.canonical("PList<PList<integer>>") == "PList<PList<number>>"
    assert compare.canonical("PTuple<String,PTuple<Float,int>>") == compare.canonical("PTuple<PTuple<Number,double>,string>")
    assert compare.canonical("PMap<int,PSet<x>>") == "PMap<number,PSet<x>>" and compare.canonical("PList<>") == "PList<>"
    assert compare.canonical("PMap<a,b>") != compare.canonical("PMap<b,a>")


def made(spark, features, counts=(1, 1, 1, 1), names=("E", "Other", "Others")):
    base = dict(name=None, data_type=None, lower=None, upper=None, optional=False, targets=None, refs_to=None, attribute=None, featured_by=None, opposite=None)
    held = [base | dict(entity="E", variation_id=v, pos=p) | f for v, own in enumerate(features, 1) for p, f in enumerate(own)]
    variations = [("E", v, counts[v - 1], 0, 0, None) for v in range(1, len(features) + 1)]
    return model.Model("m", spark.createDataFrame([(i, n, True) for i, n in enumerate(names)], model.TYPES), spark.createDataFrame(variations, model.VARIATIONS), spark.createDataFrame(held, model.FEATURES))


def found(a, b):
    out = [sorted((r.category, r.fatal) for r in compare.compare(a, b, kept=kept).collect()) for kept in (10_000, 0)]
    assert out[0] == out[1]
    return out[0]


def test_first_match_and_orphans(spark):
    x, y = dict(kind="Attribute", name="x", data_type="String"), dict(kind="Attribute", name="y", data_type="String")
    a = made(spark, [[x], [x], [y]], (1, 2, 3))
    assert found(a, a) == [("COUNT", False), ("VARIATION", False)]
    assert found(a, made(spark, [[y], [x], [y]], (3, 1, 3))) == [("COUNT", False), ("VARIATION", False)]
    assert found(a, made(spark, [[x], [x]], (1, 2))) == [("COUNT", False), ("VARIATION", False), ("VARIATION", True), ("VARIATION", True)]
    messages = [r.message for r in compare.compare(made(spark, [[x], [y]]), made(spark, [[x], [x], [y], [y]])).where("category = 'VARIATION' and not fatal").collect()]
    assert messages == ["E variation 2 of the second has no match", "E variation 4 of the second has no match"]


def test_features(spark):
    one = lambda **f: made(spark, [[f]])
    ref = dict(kind="Reference", name="r", lower=1, upper=1, refs_to="Other", featured_by=[dict(relationship="REL", variation_id=1), dict(relationship="A", variation_id=1)])
    agg = dict(kind="Aggregate", name="g", lower=0, upper=-1, targets=[dict(entity="Other", variation_id=1), dict(entity="Big", variation_id=1)])
    same = [
        (ref, ref | dict(refs_to="Others")), (ref, ref | dict(featured_by=[dict(relationship="RELS", variation_id=2), dict(relationship="B", variation_id=1)])),
        (agg, agg | dict(targets=[dict(entity="bigs", variation_id=2), dict(entity="OTHER", variation_id=9)])),
        (dict(kind="Attribute", name="x", data_type="Long"), dict(kind="Attribute", name="x", data_type="integer")),
    ]
    other = [
        (ref, ref | dict(refs_to="Otherwise")), (ref, ref | dict(refs_to=None)), (ref, ref | dict(upper=-1)), (ref, ref | dict(opposite="o")), (ref, ref | dict(featured_by=None)),
        (ref, ref | dict(featured_by=ref["featured_by"][:1])), (agg, agg | dict(targets=agg["targets"][:1])), (agg, agg | dict(optional=True)), (agg, agg | dict(name="G")),
    ]
    for a, b in same:
        assert found(one(**a), one(**b)) == []
    for a, b in other:
        assert found(one(**a), one(**b)) == [("VARIATION", False), ("VARIATION", True)]
    key = [dict(kind="Attribute", name="_id", data_type="Long"), dict(kind="Key", attribute="_id")]
    assert found(made(spark, [key]), made(spark, [key[::-1]])) == []
    assert found(made(spark, [key]), made(spark, [[*key[:1], dict(kind="Key", attribute="other")]])) != []


def test_near_entities(spark):
    x = [[dict(kind="Attribute", name="x", data_type="String")]]
    a = made(spark, x, names=("E", "Order"))
    assert found(a, made(spark, x, names=("E", "Orders"))) == [("ENTITY", False)]
    assert found(a, made(spark, x, names=("E", "Orderliness"))) == [("ENTITY", True)]
    assert found(made(spark, x, names=("E", "F")), made(spark, x, names=("Es", "F"))) == [("ENTITY", True), ("VARIATION", True), ("VARIATION", True)]


# --- graphs and files ---


def small_graph(spark):
    nodes = [("u1", "User", {"name": "string", "age": "integer"}), ("u2", "User", {"name": "string"}), ("u3", "User", {"name": "string"}), ("m1", "Movie", {"title": "string"}), ("m2", "Movie", {"title": "string"})]
    edges = [("u1", "m1", "WATCHED", {"stars": "integer"}), ("u1", "m2", "WATCHED", {"stars": "integer"}), ("u1", "m2", "WATCHED", {}), ("u2", "m1", "FAVORITE", {}), ("u2", "m2", "WATCHED", {"stars": "integer"})]
    return spark.createDataFrame(nodes, "id string, label string, props map<string,string>"), spark.createDataFrame(edges, "src string, dst string, type string, props map<string,string>")


def test_graph_model(spark, tmp_path):
    m = graph.graph_model(*small_graph(spark), "g", intermediate=f"file://{tmp_path}/shapes")
    assert {(r.entity, r["count"]) for r in m.variations.collect()} == {("Movie", 2), ("User", 1)} and m.variations.count() == 4
    assert sorted((r.owner, r.variation_id, r["count"]) for r in m.relationship_variations.collect()) == [("FAVORITE", 1, 1), ("WATCHED", 1, 1), ("WATCHED", 2, 2)]
    assert [tuple(r) for r in m.relationship_features.collect()] == [("WATCHED", 2, 0, "stars", "integer", True)]
    refs = {(r.name, r.refs_to, r.lower, r.upper, tuple(x.variation_id for x in r.featured_by)) for r in m.features.where("kind = 'Reference'").collect()}
    assert refs == {("WATCHED", "Movie", 1, 1, (1, 2)), ("WATCHED", "Movie", 1, 1, (2,)), ("FAVORITE", "Movie", 1, 1, (1,))}
    assert {(r.name, r.optional) for r in m.features.where("kind = 'Attribute'").collect()} == {("name", False), ("age", True), ("title", False)}
    assert spark.read.json(f"file://{tmp_path}/shapes/nodes").count() == 4
    nodes, edges = small_graph(spark)
    empty = graph.graph_model(nodes.limit(0), edges.limit(0), "g")
    assert empty.entity_types.count() == empty.relationship_types.count() == 0


def test_files_lose_nothing(spark, tmp_path):
    rich = made(spark, [[dict(kind="Attribute", name="a", data_type="PMap<String,PList<PTuple<Number,Null>>>"), dict(kind="Attribute", name="b", data_type="PSet<PList<>>", optional=True), dict(kind="Reference", name="r", lower=1, upper=1, refs_to="Other", opposite="r"), dict(kind="Key", attribute="a")], []])
    for m in (graph.graph_model(*small_graph(spark), "g"), rich):
        xmi.write(m, f"{tmp_path}/x/m.xmi")
        back = xmi.read(spark, f"{tmp_path}/x/m.xmi")
        for name in ("entity_types", "features", "variations", "relationship_types", "relationship_variations", "relationship_features"):
            if getattr(m, name) is not None:
                assert rows(getattr(m, name)) == rows(getattr(back, name)), name
        assert compare.equivalent(compare.compare(m, back)).first().equivalent


def test_entry_point(spark, tmp_path):
    from shapewright.__main__ import main

    nodes, edges = small_graph(spark)
    nodes.write.parquet(f"file://{tmp_path}/nodes"), edges.write.parquet(f"file://{tmp_path}/edges")
    main(["--kind", "graph", "--name", "g", "--nodes", f"file://{tmp_path}/nodes", "--edges", f"file://{tmp_path}/edges", "--output", str(tmp_path)])
    assert xmi.read(spark, f"{tmp_path}/g.xmi").relationship_types.count() == 2
    (tmp_path / "c.json").write_text('{"_id":1,"x":"y"}\n{"_id":2}\nbad\n')
    main(["--name", "d", "--input", f"c={tmp_path}/c.json", "--output", str(tmp_path)])
    assert sum(r["count"] for r in xmi.read(spark, f"{tmp_path}/d.xmi").variations.collect()) == 2


# --- signatures ---


def test_typed_signatures_are_those_of_json(spark):
    inner = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.ArrayType(T.StringType()))])
    kind = T.StructType([
        T.StructField("a", T.ArrayType(T.LongType())), T.StructField("s", T.ArrayType(inner)), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("nested", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("maps", T.ArrayType(T.MapType(T.StringType(), T.BooleanType()))), T.StructField("o", inner),
    ])
    rng = random.Random(2)
    some = lambda f: None if rng.random() < 0.25 else f()
    array = lambda f: [some(f) for _ in range(rng.randrange(4))]
    struct = lambda: (some(lambda: 1), some(lambda: array(lambda: rng.choice(["x", "oid"]))))
    keys = ["k", "é", "\U00010000", "\uffee", 'q"', "_type"]
    data = [(some(lambda: array(lambda: 1)), some(lambda: array(struct)), some(lambda: {k: some(lambda: 1.5) for k in rng.sample(keys, 3)}), some(lambda: array(lambda: array(lambda: "x"))), some(lambda: array(lambda: {"b": some(lambda: True)})), some(struct)) for _ in range(200)]

    def plain(x, kind):
        if x is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, x) if v is not None}
        return [plain(v, kind.elementType) for v in x] if isinstance(kind, T.ArrayType) else x

    table = spark.createDataFrame(data, kind)
    got = [r.s for r in table.select(signature.typed(kind, "T").alias("s")).collect()]
    namer = signature.Namer()
    assert got == [signature.dump(signature.walk(plain(x, kind), "", namer, root=True, entity="T")) for x in data]
    for bad in (T.VariantType(), T.MapType(T.StringType(), inner)):
        with pytest.raises(TypeError):
            signature.typed(T.StructType([T.StructField("v", bad)]), "T")


def test_erased_json_has_the_same_structures(spark):
    texts = [json.dumps(d, separators=rng_sep) for seed in range(4) for rng_sep in [(",", ":") if seed % 2 else (", ", " : ")] for d in docs(seed, 60)]
    texts += ['{"a":01}', '{"a":1.}', '{"a":-}', '{"a":"\\x"}', '{"a":"b', '{"a":[1,2,3,"x","y",4,true,false]}', '{"f":false,"x-1":-1.5e3,"oid":"oid","n":[null,null]}', "{}", "[]", "", '{"a":"' + "\\n" * 9000 + '"}', '{"a":"b:c","d":["e:",":"]}', '{"a\\"1":"2"}']
    table = spark.createDataFrame([("c", t) for t in [*texts, None]], "collection string, doc string")
    plain = signature.signatures(table).where("signature is not null").groupBy("signature").count()
    assert {(r.signature, r["count"]) for r in extract.triples_of_json(table).collect()} == {(r.signature, r["count"]) for r in plain.collect()}
    assert table.select(signature.erased("doc").alias("e")).distinct().count() < table.distinct().count()


def test_texts_of_trees():
    assert signature.describe('{"e":"","r":1,"f":[["a","N"]]}') == '<null>{"a": Number }'
    assert signature.raw({"_type": "t", "a": [1, 1, "s"]}) == {"f": [["_type", "S"], ["a", {"a": ["N", "N", "S"]}]]}
    assert signature.skeleton({"_type": "t", "a": [1, 2], "b": [1, "x"], "c": "oid", "d": {"e": None}}) == {"a": [0], "b": [0, "s"], "c": "oid", "d": {"e": None}}
    out = []
    signature.walk({"kind": "dogs", "x": 1, "y": {"x": 2}}, "", signature.Namer(), out, root=True, ignored={"kind", "x"}, marker="kind")
    assert [(e, json.loads(s)["f"][0][0] if json.loads(s)["f"] else None) for e, _, _, s in out] == [("Y", None), ("Dogs", "y")]


def test_sql_functions(spark):
    naming.register(spark)
    words = spark.createDataFrame([(w,) for w in ["person", " Boxes ", "order_id", "employee_first_name", "HTMLParser", "sheep", "", "x", "active-model", None]], "w string")
    both = {"pluralize": naming.pluralize, "singularize": naming.singularize, "is_uncountable": naming.is_uncountable, "capitalize": naming.capitalize, "underscore": naming.underscore, "humanize": naming.humanize, "title_case": naming.title_case, "upper_camel_case": naming.upper_camel_case, "lower_camel_case": naming.lower_camel_case}
    for name, f in both.items():
        assert all(r.a == r.b for r in words.select(F.expr(f"{name}(w)").alias("a"), f("w").alias("b")).collect()), name
    numbers = spark.range(-30, 130)
    assert numbers.select(F.expr("ordinalize(id)").alias("a"), naming.ordinalize("id").alias("b")).where("not (a <=> b)").isEmpty()


def test_metamodel(spark, tmp_path):
    (tmp_path / "m.ecore").write_text('<p xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><eClassifiers xsi:type="ecore:EClass" name="A" abstract="true"/><eClassifiers xsi:type="ecore:EClass" name="B" eSuperTypes="#//A"><eStructuralFeatures xsi:type="ecore:EAttribute" name="n" lowerBound="1" eType="ecore:EDataType http://x#//EString"/></eClassifiers></p>')
    got = [tuple(r) for r in xmi.read_metamodel(spark, str(tmp_path / "m.ecore")).collect()]
    assert got == [("A", True, [], None, None, None, None, None), ("B", False, ["A"], "n", "EAttribute", "EString", 1, 1)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from shapewright import tables

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(bare)


def test_large_tables_are_written(spark, monkeypatch):
    from shapewright import tables

    monkeypatch.setattr(tables, "KEPT", 3)
    assert sorted(r.id for r in tables.cut(spark.range(9)).collect()) == list(range(9))
    assert tables.cut(spark.range(3)).count() == 3 and tables.cut(spark.range(0)).count() == 0
    assert infer.KEPT == 10_000
