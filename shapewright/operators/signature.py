"""Structural signatures: what a document is once its values are erased.

A signature is canonical JSON text. Leaves are "S", "N", "B", "0" (null) and "O"
(object id); an array is {"a":[...]} of its distinct element signatures in order
of first occurrence; an object is {"e":entity,"r":0 or 1,"f":[[name,signature],
...]} with fields in UTF-16 order and without the type marker. Two nodes have
the same structure exactly when their signatures are equal."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.functions import naming

#: The field that names a root's entity, and the fields left out at every depth (fixed values).
MARKER, IGNORED = "_type", frozenset({"_type"})
#: A text leaf of this value stands for an object id (fixed value).
OID = "oid"

KINDS = {"S": "String", "N": "Number", "B": "Boolean", "0": "Null", "O": "ObjectId"}


def utf16(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def field_order(name) -> Column:
    """Sort key of field names: UTF-16 code units."""
    return F.encode(F.col(name) if isinstance(name, str) else name, "UTF-16BE")


def classify(value) -> Column:
    """The kind of a VARIANT: OBJECT, ARRAY, BOOLEAN, NUMBER, NULL, OBJECT_ID or TEXTUAL."""
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(shape.startswith("OBJECT"), "OBJECT")
        .when(shape.startswith("ARRAY"), "ARRAY")
        .when(shape == "BOOLEAN", "BOOLEAN")
        .when(shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "NUMBER")
        .when(shape == "VOID", "NULL")
        .when(text == OID, "OBJECT_ID")
        .otherwise("TEXTUAL")
    )


def leaf(value) -> str:
    if isinstance(value, bool):
        return "B"
    if isinstance(value, (int, float)):
        return "N"
    if value is None:
        return "0"
    if isinstance(value, str):
        return "O" if value == OID else "S"
    raise TypeError(f"no kind for {type(value).__name__}")


def dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class Namer:
    """The naming rules in Python, for trees: the same as the column functions,
    remembered by word."""

    def __init__(self, rules: naming.Naming = naming.DEFAULT):
        import re

        java = lambda r: re.sub(r"\$(\d)", r"\\g<\1>", r)
        compiled = lambda own: [(re.compile(rule, re.I | re.A), java(to)) for rule, to in own]
        self.singulars, self.plurals = compiled(rules.singulars), compiled(rules.plurals)
        self.uncountables, self.seen = rules.uncountables, {}

    def capitalize(self, word: str) -> str:
        w = word.strip()
        return w[:1].upper() + w[1:].lower()

    def _first(self, word: str, rules) -> str:
        w = word.strip()
        if w and w.lower() not in self.uncountables:
            w = next((rule.sub(to, w) for rule, to in rules if rule.search(w)), w)
        return w

    def singular(self, word: str) -> str:
        return self._first(word, self.singulars)

    def plural(self, word: str) -> str:
        return self._first(word, self.plurals)

    def element(self, word: str) -> str:
        """The entity of an array's elements: the field's singular, capitalised."""
        if word not in self.seen:
            self.seen[word] = self.capitalize(self.singular(word))
        return self.seen[word]


def fields_of(sig: str) -> list[dict]:
    """The fields of an object's signature: pos, name, is_array, prims (kinds of
    its leaves) and targets (entity, signature) of its objects. An array within
    an array stands for its own elements."""
    rows = []
    for pos, (name, value) in enumerate(json.loads(sig)["f"]):
        many = isinstance(value, dict) and "a" in value
        items, flat = value["a"] if many else [value], []
        while items:
            x, *items = items
            if isinstance(x, dict) and "a" in x:
                items = [*x["a"], *items]
            else:
                flat.append(x)
        prims, targets = [x for x in flat if isinstance(x, str)], [(x["e"], dump(x)) for x in flat if isinstance(x, dict)]
        rows.append(dict(pos=pos, name=name, is_array=many, prims=prims, targets=targets))
    return rows


def walk(value, name: str, namer: Namer, out: list | None = None, root: bool = False, entity: str | None = None, depth: int = 0, ignored=IGNORED, marker: str = MARKER):
    """The signature of a tree as nested lists; ``out`` gets (entity, is_root,
    depth, signature text) of every object, children before parents."""
    if isinstance(value, dict):
        own = (entity if entity is not None else namer.capitalize(str(value.get(marker) or ""))) if root else name
        fields = []
        for key in sorted((k for k in value if k not in ignored), key=utf16):
            child = value[key]
            inner = namer.element(key) if isinstance(child, list) else namer.capitalize(key)
            fields.append([key, walk(child, inner, namer, out, depth=depth + 1, ignored=ignored)])
        made = {"e": own, "r": int(root), "f": fields}
        if out is not None:
            out.append((own, root, depth, dump(made)))
        return made
    if isinstance(value, list):
        seen, items = set(), []
        for x in value:
            made = walk(x, name, namer, out, depth=depth + 1, ignored=ignored)
            if (key := dump(made)) not in seen:
                seen.add(key)
                items.append(made)
        return {"a": items}
    return leaf(value)


def signatures(docs: DataFrame, doc: str = "doc", collection: str = "collection", rules: naming.Naming = naming.DEFAULT, ignored=IGNORED) -> DataFrame:
    """Add ``signature`` to rows with a document (VARIANT or JSON text) and its
    collection. Null and unparsable documents have a null signature. Arrow
    batches; needed only where documents have no type known to Spark."""
    text = F.to_json(F.col(doc)) if dict(docs.dtypes)[doc] == "variant" else F.col(doc)
    fields = [f for f in docs.schema.fields if f.name != doc]
    schema = T.StructType([*fields, T.StructField("signature", T.StringType())])

    def run(batches):
        import pyarrow as pa

        namer = Namer(rules)
        for batch in batches:
            made = []
            for raw, kind in zip(batch.column(len(fields)).to_pylist(), batch.column(batch.schema.get_field_index(collection)).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                made.append(dump(walk(value, "", namer, root=True, entity=namer.capitalize(kind or ""), ignored=ignored)) if isinstance(value, dict) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=schema.names)

    return docs.select(*[f.name for f in fields], text.alias("_json")).mapInArrow(run, schema)


def typed(schema: T.StructType, entity: str, root: bool = True, rules: naming.Naming = naming.DEFAULT, col: Column | None = None) -> Column:
    """The signature of typed documents as a plain expression: a NULL field is
    absent, a NULL in an array or a map is a null; a map is an object. For
    documents assembled from tables; no Python runs. The whole plan is one
    grouped count over a short string. VARIANT columns have no type to go by:
    they are refused here and need ``signatures``."""
    namer = Namer(rules)
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    parts = []
    for f in sorted((f for f in schema.fields if f.name not in IGNORED), key=lambda f: utf16(f.name)):
        value = F.col(f.name) if col is None else col[f.name]
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"[{quoted(f.name)},"), _typed(f.dataType, f.name, value, namer, rules), F.lit("]"))))
    body = F.concat_ws(",", *parts) if parts else F.lit("")
    return F.concat(F.lit(f'{{"e":{quoted(entity)},"r":{int(root)},"f":['), body, F.lit("]}"))


def _typed(kind: T.DataType, name: str, value: Column, namer: Namer, rules) -> Column:
    if isinstance(kind, T.StructType):
        return typed(kind, namer.capitalize(name), False, rules, value)
    if isinstance(kind, T.ArrayType):
        def one(x):
            struct = isinstance(kind.elementType, T.StructType)
            own = typed(kind.elementType, namer.element(name), False, rules, x) if struct else _typed(kind.elementType, namer.singular(name) if isinstance(kind.elementType, T.MapType) else name, x, namer, rules)
            return F.when(x.isNull(), F.lit('"0"')).otherwise(own)

        return F.concat(F.lit('{"a":['), F.array_join(F.array_distinct(F.transform(value, one)), ","), F.lit("]}"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda x: F.struct(F.encode(x.key.cast("string"), "UTF-16BE").alias("at"), x.key.cast("string").alias("key"), x.value.alias("value")))
        entries = F.array_sort(F.transform(F.filter(entries, lambda x: ~x.key.isin(*IGNORED)), _signed_entry(kind.valueType, namer, rules)))
        return F.concat(F.lit(f'{{"e":{json.dumps(namer.capitalize(name), ensure_ascii=False)},"r":0,"f":['), F.array_join(F.transform(entries, lambda x: x.sig), ","), F.lit("]}"))
    if isinstance(kind, T.VariantType):
        raise TypeError(f"{name}: a VARIANT has no type to go by; use signatures()")
    if isinstance(kind, T.BooleanType):
        return F.lit('"B"')
    if isinstance(kind, T.NumericType):
        return F.lit('"N"')
    if isinstance(kind, T.StringType):
        return F.when(value == OID, F.lit('"O"')).otherwise(F.lit('"S"'))
    if isinstance(kind, T.NullType):
        return F.lit('"0"')
    return F.lit('"S"')  # dates, timestamps and binaries are text, as extraction makes them


def _signed_entry(kind: T.DataType, namer: Namer, rules):
    """A map's entry as (its place, its signature). Values that are objects or
    hold some are named by their key, which no expression can know beforehand."""
    if _holds_objects(kind):
        raise TypeError("a map of objects has entities named by its keys; use signatures()")

    def one(x):
        text = F.to_json(F.array(x.key))
        own = F.when(x.value.isNull(), F.lit('"0"')).otherwise(_typed(kind, "", x.value, namer, rules))
        return F.struct(x["at"].alias("at"), F.concat(F.lit("["), text.substr(F.lit(2), F.length(text) - 2), F.lit(","), own, F.lit("]")).alias("sig"))

    return one


def _holds_objects(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.MapType)) or (isinstance(kind, T.ArrayType) and _holds_objects(kind.elementType))


#: Parts of JSON text (fixed values): a string as the grammar has it, and a number.
_STRING = r'''"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'''
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+(?![0-9.eE+-])"
#: Texts beyond this length are left as they are: the patterns recurse in Java.
_LONGEST = 4096


def erased(text) -> Column:
    """JSON text with its values erased: texts become "s" ("oid" stays), numbers
    0, booleans true, and runs of equal elements one. The signature is that of
    the text itself, invalid text stays invalid; far fewer texts differ."""
    text = F.col(text) if isinstance(text, str) else text
    strings = F.regexp_replace(text, rf'\G((?:[^"]++|{_STRING}\s*+:|"{OID}")*+){_STRING}', '$1"s"')
    numbers = F.regexp_replace(strings, rf'\G((?:[^"0-9-]++|{_STRING})*+){_NUMBER}', "$10")
    booleans = F.regexp_replace(numbers, rf'\G((?:[^"f]++|{_STRING})*+)false', "$1true")
    for one in ('"s"', "0", "true"):
        booleans = F.regexp_replace(booleans, f"(?<=[\\[,]){one}(?:,{one})+(?=[,\\]])", one)
    return F.when(F.length(text) <= _LONGEST, booleans).otherwise(text)


def describe(sig: str) -> str:
    """A signature as readable text, an object as <entity>{"field": Kind, ...}."""
    def one(x):
        if isinstance(x, str):
            return KINDS[x]
        if "a" in x:
            return f"[{', '.join(map(one, x['a']))}]"
        return f"<{x.get('e') or 'null'}>{{{', '.join(f'{json.dumps(k, ensure_ascii=False)}: {one(v)}' for k, v in x['f'])} }}"

    return one(json.loads(sig))


def raw(value):
    """The tree of a JSON value without entity names and marker, with every
    element of its arrays."""
    if isinstance(value, dict):
        return {"f": [[k, raw(value[k])] for k in sorted(value, key=utf16)]}
    return {"a": [raw(x) for x in value]} if isinstance(value, list) else leaf(value)


def skeleton(value, ignored=IGNORED):
    """The value-free JSON that a map-reduce extraction emits: "s", 0, true, null
    or "oid", and an array of one element where all its elements are alike."""
    if isinstance(value, dict):
        return {k: skeleton(v, ignored) for k, v in value.items() if k not in ignored}
    if isinstance(value, list):
        items = [skeleton(x, ignored) for x in value]
        return items[:1] if items and all(dump(x) == dump(items[0]) for x in items) else items
    return {"S": "s", "N": 0, "B": True, "0": None, "O": OID}[leaf(value)]


def array_shape(values) -> Column:
    """(homogeneous, size, kinds in order) of an ARRAY<VARIANT> added one by one:
    equal kinds count up, different ones expand."""
    kinds = F.transform(values, lambda x: classify(x))
    same = F.size(F.array_distinct(kinds)) <= 1
    return F.struct(same.alias("homogeneous"), F.size(kinds).alias("size"), F.when(same, F.array_distinct(kinds)).otherwise(kinds).alias("inners"))
