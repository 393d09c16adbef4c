"""Sources: document collections, tables as documents, and property graphs."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """(collection, doc VARIANT) of JSON lines. No schema is inferred: a merged
    one would lose the difference between absent and null and between types.
    Unparsable lines have a null document."""
    return spark.read.text(path).select(F.lit(collection).alias("collection"), F.try_parse_json("value").alias("doc"))


def collections(frames: list[DataFrame]) -> DataFrame:
    """Several collections as one."""
    return functools.reduce(DataFrame.unionByName, frames)


def connector(spark: SparkSession, kind: str, collection: str, **options) -> DataFrame:
    """(collection, doc) by a connector that gives raw JSON, if it is installed."""
    read = spark.read.format(kind).options(**options).load()
    return read.select(F.lit(collection).alias("collection"), F.try_parse_json(F.col(read.columns[0]).cast("string")).alias("doc"))


def sampled(nodes: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """A graph scan's sampling ratio (a feature of the scan; 1.0 reads all)."""
    return nodes if fraction >= 1.0 else nodes.sample(fraction, seed)


def check_name(name: str) -> str:
    """A database name that is fit for a path."""
    if not name or ".." in name or re.search(r"[/\\\r\n]", name):
        raise ValueError(f"not a database name: {name!r}")
    return name


def embed(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, columns: list, order: str) -> DataFrame:
    """``parents`` with an array ``name`` of their ``children``, empty if none.

    One shuffle of each side on the key; children are put in order within their
    parent. A parent with very many children is one array by its nature."""
    item = F.struct(order, F.struct(*columns).alias("item"))
    grouped = children.groupBy(F.col(child_key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.item).alias(name))
    joined = parents.join(grouped, parents[key] == grouped._k, "left").drop("_k")
    kind = joined.schema[name].dataType
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items embedded. NULL is an absent field: priority
    is left out if not specified, an item's discount if there is none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_price"), F.col("o_orderdate").cast("string").alias("order_date"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"))
    items = table(spark, sf_dir, "lineitem")
    columns = [F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount")]
    return embed(orders, items, "_id", "l_orderkey", "details", columns, "l_linenumber")


def customers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON documents: every third has an object id, vip only from a
    balance of 5,000 on, the address a code only for even keys."""
    c = table(spark, sf_dir, "customer")
    key, oid = F.col("c_custkey"), F.concat(F.lpad(F.lower(F.hex(F.lit(1_600_000_000) + F.col("c_custkey"))), 8, "0"), F.lpad(F.lower(F.hex("c_custkey")), 16, "0"))
    plain = F.concat(F.lit('{"_id":'), F.when(key % 3 == 0, F.concat(F.lit('{"$oid":"'), oid, F.lit('"}'))).otherwise(key.cast("string")), F.lit(',"name":'), F.to_json(F.struct("c_name")).substr(F.lit(11), F.length(F.to_json(F.struct("c_name"))) - 11), F.lit(',"nation_id":'), F.col("c_nationkey").cast("string"), F.lit(',"balance":'), F.col("c_acctbal").cast("string"), F.when(F.col("c_acctbal") > 5000, ',"vip":true').otherwise(""), F.lit(',"address":{"segment":"'), F.col("c_mktsegment"), F.lit('"'), F.when(key % 2 == 0, F.concat(F.lit(',"code":'), key.cast("string"))).otherwise(""), F.lit("}}"))
    return c.select(F.lit("customers").alias("collection"), plain.alias("doc"), "c_custkey")


def events_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents with their own JSON in ``props`` and tags that are
    empty, texts, or mixed by the event's id."""
    e = table(spark, sf_dir, "events")
    tags = F.when(F.col("event_id") % 3 == 0, "[]").when(F.col("event_id") % 3 == 1, '["a","b"]').otherwise('["a",1]')
    doc = F.concat(F.lit('{"_id":'), F.col("event_id").cast("string"), F.lit(',"user_id":'), F.col("user_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit(',"tags":'), tags, F.lit("}"))
    return e.select(F.lit("events").alias("collection"), doc.alias("doc"), "event_id")


def conversations_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns embedded (typed)."""
    t = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", "text").alias("item")))), lambda x: x.item)
    return t.groupBy(F.col("conv_id").alias("_id")).agg(turns.alias("turns"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tables: customers place orders, orders contain parts
    from suppliers, customers and suppliers are located in nations. props hold
    the type name of each property, absent ones left out."""
    c, o, p, s, n, l = (table(spark, sf_dir, x) for x in ("customer", "orders", "part", "supplier", "nation", "lineitem"))  # noqa: E741
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def node(df, kind, key, props, some=()):
        always = F.create_map(*[F.lit(x) for pair in props.items() for x in pair])
        for prop, type_, when in some:
            always = F.map_concat(always, F.when(when, F.create_map(F.lit(prop), F.lit(type_))).otherwise(F.create_map().cast("map<string,string>")))
        return df.select(name(kind, key).alias("id"), F.lit(kind).alias("label"), always.alias("props"))

    nodes = [
        node(c, "Customer", "c_custkey", {"name": "string", "balance": "double"}, [("vip", "boolean", F.col("c_acctbal") > 5000)]),
        node(o, "Order", "o_orderkey", {"status": "string", "total": "double"}, [("priority", "string", F.col("o_orderpriority") != "4-NOT SPECIFIED")]),
        node(p, "Part", "p_partkey", {"name": "string", "size": "integer"}),
        node(s, "Supplier", "s_suppkey", {"name": "string"}),
        node(n, "Nation", "n_nationkey", {"name": "string"}),
    ]
    bare, quantity = F.create_map().cast("map<string,string>"), F.create_map(F.lit("quantity"), F.lit("double"))
    edge = lambda df, a, ka, b, kb, kind, props: df.select(name(a, ka).alias("src"), name(b, kb).alias("dst"), F.lit(kind).alias("type"), props.alias("props"))
    edges = [
        edge(o, "Customer", "o_custkey", "Order", "o_orderkey", "PLACED", bare),
        edge(l, "Order", "l_orderkey", "Part", "l_partkey", "CONTAINS", quantity),
        edge(l, "Order", "l_orderkey", "Supplier", "l_suppkey", "SUPPLIED_BY", bare),
        edge(c, "Customer", "c_custkey", "Nation", "c_nationkey", "LOCATED_IN", bare),
        edge(s, "Supplier", "s_suppkey", "Nation", "s_nationkey", "LOCATED_IN", bare),
    ]
    return collections(nodes), collections(edges)


def user_profiles(spark: SparkSession, users: int) -> tuple[DataFrame, DataFrame]:
    """Deterministic (users, movies) documents (typed): two user shapes, half and
    half, about 15 % with empty arrays; half as many movies as users."""
    odd, empty = F.col("id") % 2 == 1, F.col("id") % 20 < 3
    watched = F.array(F.struct((F.col("id") % 97).alias("movie_id"), (F.col("id") % 5).alias("stars")))
    favourite = F.when(empty, F.array().cast("array<bigint>")).otherwise(F.array(F.col("id") % 97))
    address = F.struct(F.lit("c").alias("city"), F.col("id").alias("number"), F.when(odd, "p").alias("postcode"), F.lit("s").alias("street"))
    rows = spark.range(users).select(F.col("id").alias("_id"), F.lit("e").alias("email"), F.lit("n").alias("name"), F.when(odd, "s").alias("surname"), F.when(odd, favourite).alias("favoriteMovies"), F.when(empty, F.array().cast("array<struct<movie_id:bigint,stars:bigint>>")).otherwise(watched).alias("watchedMovies"), address.alias("address"))
    movies = spark.range(users // 2).select(F.col("id").alias("_id"), F.lit("g").alias("genre"), F.lit("t").alias("title"), (F.lit(1950) + F.col("id") % 70).alias("year"))
    return rows, movies
