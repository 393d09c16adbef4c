"""English naming rules as Spark column expressions.

Rules are data: a ``Naming`` holds regular expressions in Java's syntax, which
is Spark's own, so every function is a plain expression inside whole-stage
codegen. A ``Naming`` is immutable; ``add_*`` return another one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The rules in order of registration (the last registered is tried first).
PLURALS = [
    ("$", "s"),
    ("s$", "s"),
    ("(ax|test)is$", "$1es"),
    ("(octop|vir)us$", "$1i"),
    ("(octop|vir)i$", "$1i"),
    ("(alias|status)$", "$1es"),
    ("(bu)s$", "$1ses"),
    ("(buffal|tomat)o$", "$1oes"),
    ("([ti])um$", "$1a"),
    ("([ti])a$", "$1a"),
    ("sis$", "ses"),
    ("(?:([^f])fe|([lr])f)$", "$1$2ves"),
    ("(hive)$", "$1s"),
    ("([^aeiouy]|qu)y$", "$1ies"),
    ("(x|ch|ss|sh)$", "$1es"),
    ("(matr|vert|ind)ix|ex$", "$1ices"),
    ("([m|l])ouse$", "$1ice"),
    ("([m|l])ice$", "$1ice"),
    ("^(ox)$", "$1en"),
    ("(quiz)$", "$1zes"),
    ("(people|men|children|sexes|moves|stadiums)$", "$1"),
    ("(oxen|octopi|viri|aliases|quizzes)$", "$1"),
]
SINGULARS = [
    ("s$", ""),
    ("(s|si|u)s$", "$1s"),
    ("(n)ews$", "$1ews"),
    ("([ti])a$", "$1um"),
    ("((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses$", "$1$2sis"),
    ("(^analy)ses$", "$1sis"),
    ("(^analy)sis$", "$1sis"),
    ("([^f])ves$", "$1fe"),
    ("(hive)s$", "$1"),
    ("(tive)s$", "$1"),
    ("([lr])ves$", "$1f"),
    ("([^aeiouy]|qu)ies$", "$1y"),
    ("(s)eries$", "$1eries"),
    ("(m)ovies$", "$1ovie"),
    ("(x|ch|ss|sh)es$", "$1"),
    ("([m|l])ice$", "$1ouse"),
    ("(bus)es$", "$1"),
    ("(o)es$", "$1"),
    ("(shoe)s$", "$1"),
    ("(cris|ax|test)is$", "$1is"),
    ("(cris|ax|test)es$", "$1is"),
    ("(octop|vir)i$", "$1us"),
    ("(octop|vir)us$", "$1us"),
    ("(alias|status)es$", "$1"),
    ("(alias|status)$", "$1"),
    ("^(ox)en", "$1"),
    ("(vert|ind)ices$", "$1ex"),
    ("(matr)ices$", "$1ix"),
    ("(quiz)zes$", "$1"),
]
IRREGULARS = [("person", "people"), ("man", "men"), ("child", "children"), ("sex", "sexes"), ("move", "moves"), ("stadium", "stadiums")]
UNCOUNTABLES = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep")

#: Stands before a letter that is to become upper-case; never in names.
_MARK = "\x01"


@dataclass(frozen=True)
class Naming:
    """Rule lists, first tried first, and the words without a plural."""

    plurals: tuple = ()
    singulars: tuple = ()
    uncountables: frozenset = field(default_factory=frozenset)

    def add_pluralize(self, rule: str, replacement: str | None) -> Naming:
        return replace(self, plurals=((rule, replacement or ""), *self.plurals))

    def add_singularize(self, rule: str, replacement: str | None) -> Naming:
        return replace(self, singulars=((rule, replacement or ""), *self.singulars))

    def add_irregular(self, singular: str, plural: str) -> Naming:
        """Both directions; the first letter stays as it is written."""
        out = self.add_pluralize(f"({singular[0]}){singular[1:]}$", f"$1{plural[1:]}")
        return out.add_singularize(f"({plural[0]}){plural[1:]}$", f"$1{singular[1:]}")

    def add_uncountable(self, *words: str | None) -> Naming:
        return replace(self, uncountables=self.uncountables | {w.strip().lower() for w in words if w is not None})

    def clear(self) -> Naming:
        return Naming()

    # --- expressions; null in, null out ---

    def is_uncountable(self, word) -> Column:
        low = F.lower(_strip(word))
        return F.coalesce(low.isin(*sorted(self.uncountables)) if self.uncountables else F.lit(False), F.lit(False))

    def pluralize(self, word, count=None) -> Column:
        """With a count of 1 or -1 the word as it is, not even stripped."""
        word = _col(word)
        out = self._first(word, self.plurals)
        return out if count is None else F.when(_col(count).isin(1, -1), word).otherwise(out)

    def singularize(self, word) -> Column:
        return self._first(_col(word), self.singulars)

    def _first(self, word: Column, rules) -> Column:
        """The stripped word is bound once, by a transform of one element: the
        rules' code would be too long for one method if it stood in each."""

        def choose(w: Column) -> Column:
            low = F.lower(w)
            out = F.when((w == "") | (low.isin(*sorted(self.uncountables)) if self.uncountables else F.lit(False)), w)
            for rule, replacement in rules:
                out = out.when(F.regexp_like(w, F.lit(f"(?i){rule}")), F.regexp_replace(w, f"(?i){rule}", replacement))
            return out.otherwise(w)

        return F.element_at(F.transform(F.array(_strip(word)), choose), 1)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(x) -> Column:
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def _default() -> Naming:
    out = Naming()
    for rule in PLURALS:
        out = out.add_pluralize(*rule)
    for rule in SINGULARS:
        out = out.add_singularize(*rule)
    for pair in IRREGULARS:
        out = out.add_irregular(*pair)
    return out.add_uncountable(*UNCOUNTABLES)


#: The rules in force where none are given.
DEFAULT = _default()


def pluralize(word, count=None, rules: Naming = DEFAULT) -> Column:
    return rules.pluralize(word, count)


def singularize(word, rules: Naming = DEFAULT) -> Column:
    return rules.singularize(word)


def is_uncountable(word, rules: Naming = DEFAULT) -> Column:
    return rules.is_uncountable(word)


def capitalize(words) -> Column:
    """The first character upper-case, all others lower-case."""
    w = _strip(words)
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))


def upper_marked(text: Column, pattern: str, keep: str) -> Column:
    """``text`` with the letters that ``pattern`` finds (its ``keep``) upper-case."""
    parts = F.split(F.regexp_replace(text, pattern, _MARK + keep), _MARK, -1)
    raised = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))
    return F.concat(F.element_at(parts, 1), F.array_join(raised, ""))


def camel_case(word, upper_first: bool, *delimiters: str) -> Column:
    w = _strip(word)
    for d in delimiters:
        w = F.replace(w, F.lit(d), F.lit("_"))
    upper = upper_marked(w, r"(^|_)(.)", "$2")
    if upper_first:
        return upper
    return F.when(F.length(w) < 2, w).otherwise(F.concat(F.lower(F.substring(w, 1, 1)), upper.substr(F.lit(2), F.length(upper))))


def upper_camel_case(word, *delimiters: str) -> Column:
    return camel_case(word, True, *delimiters)


def lower_camel_case(word, *delimiters: str) -> Column:
    return camel_case(word, False, *delimiters)


def underscore(word, *delimiters: str) -> Column:
    w = F.regexp_replace(_strip(word), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    w = F.replace(F.regexp_replace(w, r"([a-z\d])([A-Z])", "$1_$2"), F.lit("-"), F.lit("_"))
    for d in delimiters:
        w = F.replace(w, F.lit(d), F.lit("_"))
    return F.lower(w)


def humanize(words, *removable: str) -> Column:
    """``removable`` are regular expressions."""
    w = F.regexp_replace(_strip(words), "_id$", "")
    for token in removable:
        w = F.regexp_replace(w, token, "")
    return capitalize(F.regexp_replace(w, "_+", " "))


def title_case(words, *removable: str) -> Column:
    return upper_marked(humanize(words, *removable), r"\b([a-z])", "$1")


def ordinalize(number) -> Column:
    """11 to 13 have th; others go by the last digit, so 111 has st and a negative number th."""
    n = _col(number).cast("long")
    end = n % 10
    suffix = F.when(n.between(11, 13), "th").when(end == 1, "st").when(end == 2, "nd").when(end == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def register(spark: SparkSession, rules: Naming = DEFAULT) -> None:
    """The functions for SQL, as temporary SQL functions (no Python involved):
    pluralize, singularize, is_uncountable, capitalize, underscore, humanize,
    title_case, upper_camel_case, lower_camel_case and ordinalize."""
    quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    clean = "regexp_replace(w, r'^\\s+|\\s+$', '')"
    words = ", ".join(f"'{quoted(w)}'" for w in sorted(rules.uncountables)) or "null"

    def define(name: str, body: str, takes: str = "w STRING", gives: str = "STRING") -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")

    def raised(text: str, pattern: str, keep: str) -> str:
        """``upper_marked`` as SQL text; the parts are found once."""
        parts = f"split(regexp_replace({text}, r'{pattern}', concat(char(1), '{keep}')), char(1), -1)"
        return f"array_join(transform({parts}, (x, i) -> if(i = 0, x, concat(upper(substr(x, 1, 1)), substr(x, 2)))), '')"

    for name, own in (("pluralize", rules.plurals), ("singularize", rules.singulars)):
        cases = " ".join(f"WHEN regexp_like({clean}, '(?i){quoted(r)}') THEN regexp_replace({clean}, '(?i){quoted(r)}', '{quoted(s)}')" for r, s in own)
        define(name, f"CASE WHEN {clean} = '' OR lower({clean}) IN ({words}) THEN {clean} {cases} ELSE {clean} END")
    define("is_uncountable", f"coalesce(lower({clean}) IN ({words}), false)", gives="BOOLEAN")
    define("capitalize", f"concat(upper(substr({clean}, 1, 1)), lower(substr({clean}, 2)))")
    define("underscore", f"lower(replace(regexp_replace(regexp_replace({clean}, '([A-Z]+)([A-Z][a-z])', '$1_$2'), r'([a-z\\d])([A-Z])', '$1_$2'), '-', '_'))")
    spaced = f"regexp_replace(regexp_replace({clean}, '_id$', ''), '_+', ' ')"
    define("humanize", f"capitalize({spaced})")
    define("title_case", raised(f"capitalize({spaced})", r"\b([a-z])", "$1"))
    upper = raised(clean, "(^|_)(.)", "$2")
    define("upper_camel_case", upper)
    define("lower_camel_case", f"CASE WHEN length({clean}) < 2 THEN {clean} ELSE concat(lower(substr({clean}, 1, 1)), substr({upper}, 2)) END")
    define("ordinalize", "concat(n, CASE WHEN n BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END)", "n BIGINT")
