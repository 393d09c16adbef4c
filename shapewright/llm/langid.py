"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of the text's likelihood under a
character-trigram model, the likelihood of the declared language, and a prior
of the document's host. Host priors are smoothed towards the prior of the
host's address suffix, and that towards the corpus prior; all are counted over
all documents by grouped aggregation. A declared language with too little text
for a model of its own is a hypothesis too: its text is as likely as that of an
even mixture of the modelled languages or as evenly spread trigrams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import each, materialise, without_rows

#: Documents of each declared language that the trigram model is fitted on, on average (the only sample taken).
FIT_DOCS = 400
#: Trigrams of these documents at least, for a model: with less text a language has none. A model takes 256 KB.
LEAST_TRIGRAMS = 2000
#: Trigrams are hashed to so many cells.
CELLS = 1 << 16
#: The evidence of a text is worth at most so many trigrams: neighbouring ones aren't independent.
EFFECTIVE = 60.0
#: Weight of the wider prior in documents.
SMOOTH = 10.0
#: Prior of a language that isn't among the modelled ones; trigrams of none are taken as evenly spread.
UNKNOWN = 1e-3
#: Share of texts in no language that are declared as a language without a model.
STRAY = 0.1
#: Share of trigrams in any text that may be anything: keys, names, codes.
NOISE = 0.1
#: A document is rejected if languages have less than this posterior in all, or with fewer letters.
LEAST_POSTERIOR, LEAST_LETTERS = 0.5, 3

# What declares no language.
NOTHING = "und zxx mul unknown none null nan n/a na -".split()


def declared(lang) -> F.Column:
    """The declared language: the first part of a language tag (two or three
    letters, so at most 18,252 values) in lower case, any other text as it is;
    null if it says nothing."""
    text = F.lower(F.trim(lang.cast("string")))
    tag = F.regexp_extract(text, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when((text == "") | text.isin(NOTHING), None).when(tag != "", tag).otherwise(text)


def trigrams(text: str):
    """Hashed character trigrams of the lower-cased text's letters; runs of
    anything else count as one space."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7))
    c = np.where(letter, c, 32).astype(np.uint64)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    n = int((c != 32).sum())
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64), n
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA6B) + c[2:] * np.uint64(0xC2B2AE35)
    return ((h >> np.uint64(13)) % np.uint64(CELLS)).astype(np.int64), n


def fit(docs: DataFrame, per_language: int = FIT_DOCS):
    """(languages, table of CELLS x (languages + 1)) of log-likelihoods against
    evenly spread trigrams, from about ``per_language`` whole documents of each
    declared language, chosen by the hashes of their ids; CELLS numbers a
    language at most come to the driver. Languages are the declared tags whose
    documents chosen have LEAST_TRIGRAMS trigrams, however rare they are. The
    last column is an even mixture of all of them and evenly spread trigrams."""
    import numpy as np

    tagged = docs.select("doc_id", declared(F.col("lang")).alias("lang"), "text").where(F.regexp_like("lang", F.lit("^[a-z]{2,3}$")))
    # about per_language documents of each language, by the hash of their ids; whole texts, counted on the executors
    share = tagged.groupBy(F.col("lang").alias("l")).agg(F.ceil(F.least(F.lit(1.0), per_language / F.count("*")) * (1 << 20)).alias("rate"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20))
    chosen = tagged.join(F.broadcast(share), (F.col("lang") == F.col("l")) & (h < F.col("rate"))).select("lang", "text")  # 18,252 rows at most

    def run(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), each(batch.column(1))):
                for at in range(0, len(text or ""), 1 << 20):
                    own = np.bincount(trigrams(text[at : at + (1 << 20)])[0], minlength=CELLS)
                    sums[lang] = sums.get(lang, 0) + own
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at].astype(np.int64))], names=["lang", "cell", "n"])

    found = materialise(chosen.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "trigrams")
    enough = found.groupBy("lang").agg(F.sum("n").alias("m")).where(F.col("m") >= LEAST_TRIGRAMS)
    langs = sorted(r.lang for r in enough.select("lang").collect())
    if not langs:
        return [], np.zeros((CELLS, 1), dtype=np.float32)
    found = found.join(enough.select("lang"), "lang", "left_semi").toArrow()
    counts = np.zeros((CELLS, len(langs)))
    column = {lang: i for i, lang in enumerate(langs)}
    where = np.array([column[x] for x in found["lang"].to_pylist()], dtype=np.int64)
    counts[found["cell"].to_numpy(), where] = found["n"].to_numpy()
    # the corpus background smooths each language's cells
    background = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * CELLS)
    smooth = 50.0
    like = (counts + smooth * background[:, None] * 20) / (counts.sum(axis=0) + smooth * 20)
    like = (1 - NOISE) * like * CELLS + NOISE
    return langs, np.log(np.column_stack((like, (like.mean(axis=1) + 1) / 2))).astype(np.float32)


def suffix_of(host) -> F.Column:
    """The last label of a host name; a name without a dot is its own suffix."""
    return F.lower(F.element_at(F.split(host, r"\."), -1))


def identify(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Per row of ``docs(doc_id, text, lang, source)``: doc_id, text_key (hash of
    the text), predicted (language or null), posterior, n_letters, accepted.

    Null declared languages and null hosts give no evidence of their own (the
    suffix is then the empty one). A declared language without a model is itself
    predicted where it explains the text best. A text with fewer than
    LEAST_LETTERS letters, null and empty ones too, is rejected, and so is one
    that is more probably of no language than of any. Ties go to the first
    language by name. Null doc_ids and repeated rows get a row each. A table
    without a declared language that has text enough for a model has nothing to
    learn from: predicted is the declared language, posterior is null and texts
    with enough letters are accepted. Other columns, whatever their names, are
    not read; an empty table gives an empty result. Whole texts are scored, a
    million characters at a time."""
    spark = docs.sparkSession
    langs, table = fit(docs)
    k = len(langs)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            like, letters = np.zeros((batch.num_rows, k + 1)), np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(each(batch.column(1))):
                n = 0
                for at in range(0, len(text or ""), 1 << 20):
                    cells, own = trigrams(text[at : at + (1 << 20)])
                    letters[i] += own
                    n += len(cells)
                    if k and len(cells):
                        like[i] += table[cells].sum(axis=0, dtype=np.float64)
                if n > EFFECTIVE:
                    like[i] *= EFFECTIVE / n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, like.size + 1, k + 1), pa.int32()), pa.array(like.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists, pa.array(letters)], names=["doc_id", "text_key", "lang", "host", "like", "letters"])

    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    seen = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), declared(F.col("lang")).alias("lang"), host.alias("host"))
    seen = seen.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, lang string, host string, like array<double>, letters long")
    enough = F.col("letters") >= LEAST_LETTERS
    if not k:
        return seen.select("doc_id", "text_key", F.when(enough, F.col("lang")).alias("predicted"), F.lit(None).cast("double").alias("posterior"), F.col("letters").alias("n_letters"), enough.alias("accepted"))
    both = F.struct(F.slice("like", 1, k).alias("known"), F.element_at("like", k + 1).alias("mixed")).alias("x")
    seen = seen.withColumn("suffix", suffix_of("host")).select("doc_id", "text_key", "lang", "host", "suffix", "letters", both).select("*", "x.*").drop("x")
    seen = materialise(seen.withColumn("best", F.array_position("known", F.array_max("known")).cast("int")), "likelihoods")  # best: from 1
    # counts by (host, text's language), all documents: the input of the three priors
    by_host = materialise(seen.where(enough).groupBy("suffix", "host", "best").count(), "by_host")
    pairs = F.map_from_entries(F.collect_list(F.struct("best", "count")))  # a pair a language at most
    vector = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    corpus = {r.best: r.n for r in by_host.groupBy("best").agg(F.sum("count").alias("n")).collect()}  # k rows at most
    root = [(corpus.get(i + 1, 0) + 1) / (sum(corpus.values()) + k) for i in range(k)]
    smoothed = lambda own, wider: F.zip_with(own, wider, lambda a, b: (a + SMOOTH * b) / (F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + SMOOTH))
    suffix = by_host.groupBy("suffix", "best").agg(F.sum("count").alias("count")).groupBy("suffix").agg(pairs.alias("m"))
    suffix = suffix.select("suffix", smoothed(vector, F.array(*[F.lit(x) for x in root])).alias("wider"))
    prior = by_host.groupBy("suffix", "host").agg(pairs.alias("m")).join(suffix, "suffix")
    prior = materialise(prior.select(F.col("host").alias("h"), smoothed(vector, F.col("wider")).alias("prior")), "priors")
    # how far declared languages are right: P(declared | text's language) over k + 1 outcomes, the last any without a model
    column = {lang: i for i, lang in enumerate(langs)}
    heard = [[1.0] * (k + 1) for _ in range(k)]
    outcome = F.when(F.col("lang").isin(langs), F.col("lang"))
    for r in seen.where(enough & F.col("lang").isNotNull()).groupBy(outcome.alias("lang"), "best").count().collect():  # k x (k + 1) rows at most
        heard[r.best - 1][column.get(r.lang, k)] += r["count"]
    heard = [[math.log(x / sum(row)) for x in row] for row in heard]
    said = spark.createDataFrame([(lang, [heard[j][i] for j in range(k)]) for i, lang in enumerate([*langs, None])], "l string, said array<double>")
    modelled = F.col("lang").isin(langs)
    other = F.col("lang").isNotNull() & ~modelled
    # both sides exchanged, or the small one broadcast by its size: AQE splits a frequent host
    out = seen.join(prior, seen.host == prior.h, "left").withColumn("key", outcome).join(F.broadcast(said), F.col("key").eqNullSafe(F.col("l")))
    nothing = F.array(*[F.lit(0.0)] * k)
    logs = F.zip_with(F.zip_with("known", F.coalesce("prior", F.array(*[F.lit(x) for x in root])), lambda a, p: a + F.log(p)), F.when(F.col("lang").isNull(), nothing).otherwise(F.col("said")), lambda a, b: a + b)
    # a declared language without a model: its text is like the mixture, or like nothing known
    level = F.greatest(F.col("mixed"), F.lit(0.0))
    own = level + F.log(F.exp(F.col("mixed") - level) + F.exp(-level)) - math.log(2) + math.log(UNKNOWN)
    out = out.withColumn("logs", logs).withColumn("own", F.when(other, own)).withColumn("no", F.lit(math.log(UNKNOWN)) + F.when(other, math.log(STRAY)).otherwise(0.0))
    out = out.withColumn("best", F.array_max("logs")).withColumn("top", F.greatest("best", "own", "no"))
    part = lambda c: F.coalesce(F.exp(F.col(c) - F.col("top")), F.lit(0.0))
    known = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    own_wins = F.coalesce(F.col("own") > F.col("best"), F.lit(False))
    name = F.when(own_wins, F.col("lang")).otherwise(F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("logs", F.col("best")).cast("int")))
    total = known + part("own") + part("no")
    out = out.select("doc_id", "text_key", F.when(enough, name).alias("predicted"), F.when(enough, F.greatest(part("best"), part("own")) / total).alias("posterior"), F.col("letters").alias("n_letters"), (enough & ((known + part("own")) / total >= LEAST_POSTERIOR)).alias("accepted"))
    return out


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected. Rows that
    share a doc_id but not a text are judged by their own text."""
    return without_rows(docs, identify(docs).where(~F.col("accepted")))
