"""Queries of the naming functions, over names of the tables' own columns and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.functions import naming
from shapewright.sources.documents import table

# Word forms that the rules must give.
PAIRS = """class/classes package/packages message/messages axis/axes octopus/octopi virus/viri status/statuses bus/buses
tomato/tomatoes quiz/quizzes party/parties half/halves search/searches box/boxes process/processes address/addresses
fish/fish category/categories query/queries movie/movies index/indices wife/wives move/moves salesperson/salespeople
person/people man/men woman/women basis/bases diagnosis/diagnoses datum/data analysis/analyses child/children day/days
news/news series/series species/species ox/oxen photo/photos elf/elves information/information mouse/mice louse/lice
house/houses alias/aliases vertex/vertices matrix/matrices testis/testes crisis/crises rice/rice shoe/shoes horse/horses
prize/prizes edge/edges detail/details human/humen""".split()


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x.split("/")) for x in PAIRS], "singular string, plural string")


def pluralize_words(spark, sf_dir):
    return _words(spark).select("singular", naming.pluralize("singular").alias("made"), naming.pluralize("plural").alias("again"))


def singularize_words(spark, sf_dir):
    return _words(spark).where("singular <> 'human'").select("plural", naming.singularize("plural").alias("made"), naming.singularize("singular").alias("again"))


def capitalize_words(spark, sf_dir):
    """All part names: first letter upper, all others lower."""
    return table(spark, sf_dir, "part").select("p_partkey", naming.capitalize("p_name").alias("name"), naming.capitalize("p_type").alias("type"))


def camelize_words(spark, sf_dir):
    words = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "orders").select("o_orderkey", naming.upper_camel_case(words, "-").alias("upper_camel"), naming.lower_camel_case(words, "-").alias("lower_camel"))


def underscore_words(spark, sf_dir):
    words = F.concat(F.lit("orderPriority"), F.replace("o_orderpriority", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "orders").select("o_orderkey", naming.underscore(words).alias("made"))


def humanize_words(spark, sf_dir):
    words = F.concat(F.lower("c_mktsegment"), F.lit("_customer_value_id"))
    return table(spark, sf_dir, "customer").select("c_custkey", naming.humanize(words).alias("made"), naming.humanize(words, "value").alias("shorter"))


def title_words(spark, sf_dir):
    words = F.concat(F.lower("c_mktsegment"), F.lit("_customer_id"))
    return table(spark, sf_dir, "customer").select("c_custkey", naming.title_case(words).alias("made"))


def ordinalize_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", naming.ordinalize("c_custkey").alias("made"))


def uncountables(spark, sf_dir):
    return _words(spark).select("singular", naming.is_uncountable("singular").alias("made"))


QUERIES = {f.__name__: f for f in (pluralize_words, singularize_words, capitalize_words, camelize_words, underscore_words, humanize_words, title_words, ordinalize_numbers, uncountables)}

_VALUES = ", ".join("('{}', '{}')".format(*x.split("/")) for x in PAIRS)
_CAMEL = "list_aggregate(list_transform(string_split(replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_'), '_'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')"

ORACLES = {
    "pluralize_words": f"SELECT singular, plural AS made, plural AS again FROM (VALUES {_VALUES}) t(singular, plural)",
    "singularize_words": f"SELECT plural, singular AS made, singular AS again FROM (VALUES {_VALUES}) t(singular, plural) WHERE singular <> 'human'",
    "capitalize_words": "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS name, upper(p_type[1]) || lower(p_type[2:]) AS type FROM part",
    "camelize_words": f"SELECT o_orderkey, {_CAMEL} AS upper_camel, lower(({_CAMEL})[1]) || ({_CAMEL})[2:] AS lower_camel FROM orders",
    "underscore_words": r"SELECT o_orderkey, lower(replace(regexp_replace(regexp_replace('orderPriority' || replace(o_orderpriority, ' ', '-'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g'), '-', '_')) AS made FROM orders",
    "humanize_words": "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' customer value' AS made, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' customer' AS shorter FROM customer",
    "title_words": "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Customer' AS made FROM customer",
    "ordinalize_numbers": "SELECT c_custkey, c_custkey || CASE WHEN c_custkey BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS made FROM customer",
    "uncountables": f"SELECT singular, singular = ANY(['equipment', 'information', 'rice', 'money', 'species', 'series', 'fish', 'sheep']) AS made FROM (VALUES {_VALUES}) t(singular, plural)",
}
