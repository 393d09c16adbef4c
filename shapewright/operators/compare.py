"""Structural equivalence of two models, as a table of classified divergences.

Divergences are (category, fatal, message); models are equivalent if none is
fatal. Names and primitive types compare as columns, over any table. Whole
models are compared entity by entity: matching bags of features is an ordered,
greedy affair where container names only need to be near each other, so an
entity's variations are worked on together - on the driver while both models
are small, else in a task for each pair of entities."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.operators.model import Model
from shapewright.tables import KEPT

# Type names that mean the same, the length by which names may differ, the categories.
SYNONYMS = {"long": "number", "integer": "number", "int": "number", "number": "number", "double": "double", "float": "double", "string": "string", "boolean": "boolean"}
NEAR = 3
CATEGORIES = "SCHEMA_NAME ENTITY RELATIONSHIP VARIATION FEATURE COUNT ROOT".split()
DIVERGENCE = "category string, fatal boolean, message string"


# --- columns ---


def compare_names(a, b) -> Column:
    """Equal in lower case, or one holds the other and is less than NEAR longer."""
    x, y = F.lower(a), F.lower(b)
    return (x == y) | ((x.contains(y) | y.contains(x)) & (F.abs(F.length(x) - F.length(y)) < NEAR))


def canonical_type(name) -> Column:
    """A primitive's type name, synonyms folded; unknown names as they are."""
    name = F.col(name) if isinstance(name, str) else name
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name)


def same_primitive(a, b) -> Column:
    """Types by name: both absent are the same, one absent is not."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.col(a).isNull() & F.col(b).isNull()).otherwise(canonical_type(a) == canonical_type(b))


def bags_equal(a, b) -> Column:
    """Whether two arrays hold the same elements as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def canonical_data_types(table: DataFrame, column: str, out: str) -> DataFrame:
    """``table`` with ``out``: the type text in ``column`` in canonical form."""
    def run(frames):
        for frame in frames:
            yield frame.assign(**{out: [None if t is None else canonical(t) for t in frame[column]]})

    return table.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in table.dtypes)}, `{out}` string")


# --- types and features ---


def canonical(text: str) -> str:
    """A type text with synonyms folded at any depth and tuples in sorted order.
    Two types are the same if their canonical texts are."""
    m = re.fullmatch(r"(\w+)<(.*)>", text, re.S)
    if not m:
        return SYNONYMS.get(text.lower(), text)
    parts = [canonical(x) for x in split_types(m[2])]
    return f"{m[1]}<{','.join(sorted(parts) if m[1] == 'PTuple' else parts)}>"


def split_types(text: str) -> list[str]:
    """The types between a container's brackets, at its own level."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]] if text else []


def near(a: str | None, b: str | None) -> bool:
    """``compare_names`` of two names, either of which may be absent."""
    if a is None or b is None:
        return a is b
    x, y = a.lower(), b.lower()
    return x == y or ((x in y or y in x) and abs(len(x) - len(y)) < NEAR)


def match_bag(a: list, b: list, same) -> bool:
    """Whether each of ``a`` finds one of ``b`` of its own, the first that is the
    same, and none is left."""
    if len(a) != len(b):
        return False
    rest = list(b)
    for x in a:
        at = next((i for i, y in enumerate(rest) if same(x, y)), None)
        if at is None:
            return False
        del rest[at]
    return True


def prepared(features: list[dict]) -> list[dict]:
    """A variation's features, ready to be compared: ``key`` holds all that must
    be equal, ``ends``, ``to`` and ``by`` the names that need only be near."""
    attributes = {f["name"]: (f["name"], canonical(f["data_type"]) if f["data_type"] is not None else None, bool(f["optional"])) for f in features if f["kind"] == "Attribute"}
    out = []
    for f in features:
        kind = f["kind"]
        key = [f["name"] or "", f["name"] is None, kind]
        if kind in ("Attribute", "Aggregate"):
            key.append(bool(f["optional"]))
        if kind == "Attribute":
            key += [attributes[f["name"]][1] or "", f["data_type"] is None]
        if kind in ("Aggregate", "Reference"):
            key += [f["lower"] or 0, f["upper"] or 0]
        if kind in ("Key", "Reference"):
            key.append(str(attributes.get(f["attribute"], f["attribute"])))
        by = f["featured_by"] or []
        if kind == "Reference":
            key += [f["opposite"] or "", len(by), f["refs_to"] is None]
        ends = [t["entity"] for t in f["targets"] or []] if kind == "Aggregate" else []
        key.append(len(ends))
        # of the variations that feature a reference only the first one's owner counts
        out.append(dict(key=tuple(map(str, key)), ends=ends, to=f["refs_to"] if kind == "Reference" else None, by=by[0]["relationship"] if by else None))
    return out


def same_feature(a: dict, b: dict) -> bool:
    return a["key"] == b["key"] and near(a["to"], b["to"]) and near(a["by"], b["by"]) and match_bag(a["ends"], b["ends"], near)


class Variation:
    def __init__(self, variation_id: int, count: int, features: list[dict]):
        self.id, self.count = variation_id, count
        self.features = prepared(features)
        self.key = tuple(sorted(f["key"] for f in self.features))

    def same(self, other: Variation) -> bool:
        return self.key == other.key and match_bag(self.features, other.features, same_feature)


def variation_divergences(name: str, ours: list[Variation], theirs: list[Variation]) -> tuple[list[tuple], bool]:
    """Divergences of two matched owners' variations, and whether all of ours have
    a match. The first match counts, and may do so for several of ours; those of
    theirs that are nobody's are reported in order."""
    out, good, matched = [], len(ours) == len(theirs), set()
    if not good:
        out.append(("VARIATION", True, f"{name}: {len(ours)} and {len(theirs)} variations"))
    by_key = defaultdict(list)
    for v in sorted(theirs, key=lambda v: v.id):
        by_key[v.key].append(v)
    for v in sorted(ours, key=lambda v: v.id):
        mate = next((x for x in by_key[v.key] if v.same(x)), None)
        if mate is None:
            good = False
            out.append(("VARIATION", True, f"{name} variation {v.id} has no match"))
            continue
        matched.add(mate.id)
        if v.count != mate.count:
            out.append(("COUNT", False, f"{name} variation {v.id} is counted otherwise: {v.count} and {mate.count}"))
    out += [("VARIATION", False, f"{name} variation {v.id} of the second has no match") for v in sorted(theirs, key=lambda v: v.id) if v.id not in matched]
    return out, good


def pair_divergences(name: str, their_name: str, exact: bool, root_differs: bool, ours: list, theirs: list) -> list[tuple]:
    """Divergences of an entity and the one it was matched with."""
    out, good = variation_divergences(name, ours, theirs)
    if exact:
        return out + [("ROOT", False, f"{name}: root differs")] * root_differs
    return out + [("ENTITY", not good, f"{name} is named {their_name}" + ("" if good else ", and their variations differ"))]


# --- models ---


def _matched(ours: list[dict], theirs: list[dict], fuzzy: bool) -> list[tuple]:
    """(ours, theirs or None, whether their names are equal) of each of ours."""
    out = []
    for a in ours:
        exact = next((b for b in theirs if a["name"].lower() == b["name"].lower()), None)
        other = next((b for b in theirs if near(a["name"], b["name"])), None) if exact is None and fuzzy else None
        out.append((a, exact or other, exact is not None))
    return out


def _owned(variations: DataFrame, features: DataFrame, owner: str) -> DataFrame:
    """(owner, variation_id, count, features): a row for each variation."""
    item = F.struct(*[F.col(c) for c in features.columns if c not in (owner, "variation_id")])
    held = features.groupBy(owner, "variation_id").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("f")))).alias("held"))
    joined = variations.join(held, [owner, "variation_id"], "left")
    return joined.select(F.col(owner).alias("owner"), "variation_id", "count", F.coalesce(F.transform("held", lambda x: x.f), F.array().cast(f"array<{item_type(features, owner)}>")).alias("features"))


def item_type(features: DataFrame, owner: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in features.dtypes if n not in (owner, "variation_id")) + ">"


def _relationship_features(features: DataFrame) -> DataFrame:
    """A relationship's attributes with the columns of an entity's features."""
    empty = {"targets": "array<struct<entity:string,variation_id:int>>", "refs_to": "string", "attribute": "string", "featured_by": "array<struct<relationship:string,variation_id:int>>", "opposite": "string", "lower": "int", "upper": "int"}
    return features.select("*", F.lit("Attribute").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def _held(variations: DataFrame, features: DataFrame, owner: str, kept: int) -> dict | None:
    """{owner: its variations} of tables of at most ``kept`` rows, else None."""
    few = [x.limit(kept + 1).toArrow() for x in (variations, features)]
    if any(x.num_rows > kept for x in few):
        return None
    own, out = defaultdict(list), defaultdict(list)
    for f in sorted(few[1].to_pylist(), key=lambda f: f["pos"]):
        own[f[owner], f["variation_id"]].append(f)
    for v in few[0].to_pylist():
        out[v[owner]].append(Variation(v["variation_id"], v["count"], own[v[owner], v["variation_id"]]))
    return out


def compare_owned(sides: list[tuple], owner: str, pairs: list[dict], kept: int = KEPT) -> DataFrame:
    """Divergences of matched owners. ``sides``, ours and theirs, are (variations,
    features) with an ``owner`` column; they come to the driver if they have at
    most ``kept`` rows, else each pair (name, their_name, exact, root_differs) is
    a task's. The pairs are rows of the schema's size."""
    spark = sides[0][0].sparkSession
    if not pairs:
        return spark.createDataFrame([], DIVERGENCE)
    few = [_held(*x, owner, kept) if kept else None for x in sides]
    if None not in few:
        return spark.createDataFrame([d for p in pairs for d in pair_divergences(p["name"], p["their_name"], p["exact"], p["root_differs"], few[0].get(p["name"], []), few[1].get(p["their_name"], []))], DIVERGENCE)
    ours, theirs = (_owned(*x, owner) for x in sides)
    wanted = spark.createDataFrame([(i, *(p[k] for k in ("name", "their_name", "exact", "root_differs"))) for i, p in enumerate(pairs)], "pair int, name string, their_name string, exact boolean, root_differs boolean")
    side = lambda x, name, n: wanted.join(x, F.col(name) == F.col("owner"), "left").drop("owner").withColumn("side", F.lit(n))

    def one(table):
        import pyarrow as pa

        rows = table.to_pylist()
        p = rows[0]
        ours, theirs = ([Variation(r["variation_id"], r["count"], r["features"]) for r in rows if r["side"] == n and r["variation_id"] is not None] for n in (0, 1))
        made = pair_divergences(p["name"], p["their_name"], p["exact"], p["root_differs"], ours, theirs)
        return pa.Table.from_pylist([dict(zip(("category", "fatal", "message"), d)) for d in made], schema=pa.schema([("category", pa.string()), ("fatal", pa.bool_()), ("message", pa.string())]))

    return side(ours, "name", 0).unionByName(side(theirs, "their_name", 1)).groupBy("pair").applyInArrow(one, DIVERGENCE)


def compare(first: Model, second: Model, kept: int = KEPT) -> DataFrame:
    """All divergences of two models: schema name, numbers of entity types,
    entity types (exact names first, then near ones, in order), roots,
    variations, counts, and the same for relationship types by exact names."""
    spark = first.entity_types.sparkSession
    found = [("SCHEMA_NAME", True, f"{first.name} and {second.name}")] if first.name != second.name else []
    types = [sorted(m.entity_types.toArrow().to_pylist(), key=lambda t: t["entity_id"]) for m in (first, second)]
    if len(types[0]) != len(types[1]):
        found.append(("ENTITY", True, f"{len(types[0])} and {len(types[1])} entity types"))
    matched = _matched(*types, fuzzy=True)
    found += [("ENTITY", True, f"{a['name']} is missing") for a, b, _ in matched if b is None]
    pairs = [dict(name=a["name"], their_name=b["name"], exact=exact, root_differs=a["root"] != b["root"]) for a, b, exact in matched if b is not None]
    out = compare_owned([(m.variations, m.features) for m in (first, second)], "entity", pairs, kept)
    names = [sorted(m.relationship_types.toArrow().to_pylist(), key=lambda t: t["name"]) if m.relationship_types is not None else [] for m in (first, second)]
    if len(names[0]) != len(names[1]):
        found.append(("RELATIONSHIP", True, f"{len(names[0])} and {len(names[1])} relationship types"))
    matched = _matched(*names, fuzzy=False)
    found += [("RELATIONSHIP", True, f"{a['name']} is missing") for a, b, _ in matched if b is None]
    pairs = [dict(name=a["name"], their_name=b["name"], exact=True, root_differs=False) for a, b, _ in matched if b is not None]
    if pairs:
        out = out.unionAll(compare_owned([(m.relationship_variations, _relationship_features(m.relationship_features)) for m in (first, second)], "owner", pairs, kept))
    return spark.createDataFrame(found, DIVERGENCE).unionAll(out)


def equivalent(divergences: DataFrame) -> DataFrame:
    """One row (equivalent): no divergence is fatal."""
    return divergences.agg((~F.coalesce(F.bool_or("fatal"), F.lit(False))).alias("equivalent"))
