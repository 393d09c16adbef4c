import pytest
from pyspark.sql import functions as F

from shapewright.functions import naming
from shapewright.plans.words import PAIRS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_plural_and_singular(spark):
    rows = spark.createDataFrame([tuple(x.split("/")) for x in PAIRS], "s string, p string")
    got = rows.select("s", "p", naming.pluralize("s").alias("ps"), naming.singularize("p").alias("sp"), naming.pluralize("p").alias("pp"), naming.singularize("s").alias("ss")).collect()
    assert not [r for r in got if r.ps != r.p or r.pp != r.p]
    assert not [r for r in got if r.s != "human" and (r.sp != r.s or r.ss != r.s)]


def test_word_edges(spark):
    assert one(spark, naming.pluralize(F.lit(None).cast("string"))) is None
    assert one(spark, naming.pluralize(F.lit("  "))) == ""
    assert one(spark, naming.pluralize(F.lit(" dog "), F.lit(1))) == " dog "
    assert one(spark, naming.pluralize(F.lit(" dog "), F.lit(2))) == "dogs"
    assert one(spark, naming.singularize(F.lit("the blue mailmen"))) == "the blue mailman"
    assert one(spark, naming.pluralize(F.lit("CamelOctopus"))) == "CamelOctopi"


@pytest.mark.parametrize("f, word, more, want", [
    (naming.lower_camel_case, "the-first_name", ("-",), "theFirstName"),
    (naming.upper_camel_case, "area51_controller", (), "Area51Controller"),
    (naming.lower_camel_case, "X", (), "X"),
    (naming.underscore, "ACTIVERecord", (), "active_record"),
    (naming.underscore, "The.firstName", (".",), "the_first_name"),
    (naming.capitalize, "watchedMovie", (), "Watchedmovie"),
    (naming.capitalize, "_id", (), "_id"),
    (naming.humanize, "employee_value_string", ("value",), "Employee string"),
    (naming.humanize, "employee_id", (), "Employee"),
    (naming.title_case, "employee_salary", (), "Employee Salary"),
    (naming.title_case, "x-ray", (), "X-Ray"),
])
def test_forms(spark, f, word, more, want):
    assert one(spark, f(F.lit(word), *more)) == want


def test_ordinals(spark):
    want = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 13: "13th", 21: "21st", 111: "111st", 112: "112nd", -1: "-1th"}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", naming.ordinalize("n").alias("x")).collect()
    assert {r.n: r.x for r in got} == want


def test_rules_are_values(spark):
    more = naming.DEFAULT.add_irregular("goose", "geese").add_uncountable(" Sheepdog ", None).add_pluralize("(foo)$", "$1foo")
    assert one(spark, more.pluralize(F.lit("goose"))) == "geese"
    assert one(spark, more.singularize(F.lit("Geese"))) == "Goose"
    assert one(spark, more.pluralize(F.lit("sheepdog"))) == "sheepdog"
    assert one(spark, more.pluralize(F.lit("foo"))) == "foofoo"
    assert one(spark, naming.DEFAULT.pluralize(F.lit("goose"))) == "gooses"
    assert one(spark, more.clear().pluralize(F.lit("dog"))) == "dog"


def test_sql_functions(spark):
    naming.register(spark)
    assert tuple(spark.sql("select pluralize('octopus'), singularize('details'), capitalize('abC d'), pluralize(null)").first()) == ("octopi", "detail", "Abc d", None)
