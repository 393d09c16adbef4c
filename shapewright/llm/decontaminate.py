"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question with
other numbers or names keeps its template. Windows of templates of documents
and benchmark items are hash-joined, and beside them the windows of the plain
lower-case words, so that a copy is found whatever its numbers and names; the
windows of a document and an item on neighbouring diagonals are chained, and the
values that fill the slots of a chain must map one to one (each value of the
item to one value of the document).

An item is compared with a document only if they share one of its rarer windows:
as many windows must match to cover an item, all but that many less one of the
ones most frequent among the items are enough to find every match. So a phrase
that many items begin with joins none of them with all documents that have it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapewright.llm.common import each, materialise, without_rows

#: Words in a window, and share of an item's words that matching windows must cover.
WINDOW, COVER = 5, 0.8
#: Words in an item at least to be looked for inside documents: a shorter one matches texts that are nothing else.
LEAST_WORDS = 3
#: Words of a window that aren't placeholders at least, for its template to say anything; its plain words always do.
LITERAL = 2
#: Diagonals (place in the document less place in the item) put together: words may be added or lost.
DRIFT = 16
#: Bits of a window's hash in the broadcast table of benchmark windows: 1 MB, whatever the benchmark's size.
TABLE_BITS = 23

# Units of measure and currencies, number words, common given names.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons
ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years hz khz mhz ghz w kw v a j kj cal kcal pa kpa k c f degree degrees percent usd eur gbp dollar
dollars euro euros pound pounds cent cents kb mb gb tb bit bits byte bytes""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
NAMES = """james john robert michael david william richard joseph thomas charles mary patricia jennifer linda elizabeth
barbara susan jessica sarah karen alice bob carol dave emma olivia anna peter paul mark tom tim sam lucy kate jane jack
george henry maria jose juan carlos luis ana pierre marie jean hans fritz""".split()

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°]{1,4})")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")


def classify(raw: str) -> tuple[str, str, str, bool]:
    """(kind, kind at a sentence's start, value, whether it ends a sentence).

    Kinds: num, unit, name, word, or empty for punctuation alone."""
    core = raw.rstrip(".,;:!?")
    if core.isalpha() and core.islower():  # most words
        kind = "num" if core in _NUMBER_SET else "unit" if core in _UNIT_SET and len(core) > 1 else "word"
        return kind, kind, core, raw[-1] in ".!?:"
    word = _EDGE.sub("", raw)
    ends = raw[len(raw.rstrip("\"')]}*#&$%")) - 1 :][:1] in {".", "!", "?", ":"} if raw else False
    ends = ends or raw[-1:] in {".", "!", "?", ":"}
    low = word.lower()
    if not low or not any(c.isalnum() for c in low):
        return "", "", "", ends
    if _NUMBER.fullmatch(low) or low in _NUMBER_SET:
        return "num", "num", low, ends
    if (m := _NUMBER_UNIT.fullmatch(low)) and m[2] in _UNIT_SET:
        return "num", "num", low, ends
    if low in _UNIT_SET and len(low) > 1:
        return "unit", "unit", low, ends
    if word[0].isupper() and word[1:].islower():
        return "name", "name" if low in _NAME_SET else "word", low, ends
    return "word", "word", low, ends


_UNIT_SET, _NUMBER_SET, _NAME_SET = frozenset(UNITS), frozenset(NUMBERS), frozenset(NAMES)


#: Codes of the placeholders (even; words have odd codes); 0 is dropped.
SLOTS = {"num", "unit", "name"}
PLACEHOLDER = {"": 0, "num": 0x5DEECE66D2, "unit": 0x27BB2EE687B0, "name": 0x369DEA0F31A52}


class Vocabulary(dict):
    """word -> row of the arrays below; dropped and begun anew beyond ``most``
    words, to bound its memory (the results don't depend on it)."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.begin()

    def begin(self) -> None:
        from array import array

        self.clear()
        # by row: code, code at a sentence's start, flags (1 placeholder, 2 one at a start, 4 ends a sentence), value
        self.codes, self.firsts, self.flags, self.values = array("Q"), array("Q"), array("B"), []
        self.exact = array("Q")  # code of the value

    def __missing__(self, raw: str) -> int:
        import xxhash

        kind, at_start, value, ends = classify(raw)
        self.exact.append(xxhash.xxh64_intdigest(value, 3) | 1)
        word = self.exact[-1] if "word" in (kind, at_start) else 0
        self.codes.append(word if kind == "word" else PLACEHOLDER[kind])
        self.firsts.append(word if at_start == "word" else PLACEHOLDER[at_start])
        self.flags.append((kind in SLOTS) + 2 * (at_start in SLOTS) + 4 * ends)
        self.values.append(value)
        self[raw] = at = len(self.values) - 1
        return at

    def template(self, text: str):
        """(codes, whether each is a placeholder, (rows of the words, this))."""
        import numpy as np

        if len(self) > self.most:
            self.begin()
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, bool), ([], self)
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        flags = np.frombuffer(self.flags, dtype=np.uint8)[at]
        start = np.concatenate(([True], (flags[:-1] & 4) > 0))
        code = np.where(start, np.frombuffer(self.firsts, dtype=np.uint64)[at], np.frombuffer(self.codes, dtype=np.uint64)[at])
        keep = code != 0
        slot = np.where(start, flags & 2, flags & 1) > 0
        return code[keep], slot[keep], (at[keep], self)


def windows(code, slot, width: int, exact):
    """(hashes of the templates of the windows of ``width`` words, hashes of their
    plain words, which of the first say anything: those with enough words)."""
    import numpy as np

    n = len(code) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    free = np.zeros(n, dtype=np.int64)
    for k in range(width):
        free += slot[k : k + n]

    def mixed(codes, seed):
        h = np.full(n, seed, dtype=np.uint64)
        for k in range(width):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    return mixed(code, width), mixed(exact, width + (1 << 20)), (free > 0) & (free <= width - min(LITERAL, width))


def chained(found: list[dict], words: int) -> tuple[float, bool] | None:
    """(coverage, whether some slot is filled otherwise) of the best chain of
    the windows ``found`` of an item and a document, or None if none reaches
    COVER.

    A chain begins with all windows of one diagonal and takes in others by the
    words they add; a diagonal's windows that add words count together or not at
    all, and the slots of a chain map one to one. Windows that add none (the
    item's own repeats, shifted) are off it."""
    diagonals: dict = {}
    for x in found:
        diagonals.setdefault(x["pos"] - x["at"], []).append((frozenset(range(x["at"], x["at"] + x["width"])), list(zip(x["theirs"], x["slots"]))))
    best = None
    for base in diagonals:
        covered: set = set()
        pairs: set = set()
        rest = dict(diagonals)
        at = base
        while at is not None:
            new = [(own, p) for own, p in rest.pop(at) if own - covered]
            more = pairs.union(*(p for _, p in new))
            if len({i for i, _ in more}) == len({d for _, d in more}) == len(more):
                pairs, covered = more, covered.union(*(own for own, _ in new))
            elif at == base:
                break
            gains = {d: len(frozenset().union(*(own for own, _ in x)) - covered) for d, x in rest.items()}
            at = max((d for d in gains if gains[d]), key=lambda d: (gains[d], -abs(d - base), d), default=None)
        if len(covered) >= COVER * words:
            own = (len(covered) / words, any(i != d for i, d in pairs))
            best = own if best is None else (max(best[0], own[0]), best[1] and own[1])
    return best


def _windows(table: DataFrame, id_col: str, widths, bits: bytes | None) -> DataFrame:
    """(id, text_key, n, width, pos, h, slots) of all windows of ``widths``, by
    their templates (slots: what fills these) and by their plain words (slots:
    all of them); with ``bits`` only those whose hash is in the table of
    benchmark windows. Texts of fewer than LEAST_WORDS words are one window."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        vocabulary = Vocabulary()
        table = None if bits is None else np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            row, n, width, pos, hashes, slots = [], [], [], [], [], []
            for i, text in enumerate(each(batch.column(2))):
                code, slot, (at, words) = vocabulary.template(text) if text else (np.zeros(0, np.uint64), np.zeros(0, bool), ([], None))
                if not len(code):
                    continue
                if len(code) < LEAST_WORDS:
                    own = [len(code)] if widths is None or len(code) in widths else []
                else:
                    own = [min(WINDOW, len(code))] if widths is None else [w for w in widths if w >= LEAST_WORDS]
                for w in own:
                    template, plain, says = windows(code, slot, w, np.frombuffer(words.exact, dtype=np.uint64)[at])
                    for h, fine, whole in ((template, says, False), (plain, np.ones(len(plain), dtype=bool), True)):
                        if table is not None:
                            key = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                            fine = fine & (table[key >> 3] >> (key & 7).astype(np.uint8) & 1).astype(bool)
                        for p in np.flatnonzero(fine).tolist():
                            row.append(i), n.append(len(code)), width.append(w), pos.append(p), hashes.append(int(h[p]))
                            slots.append([words.values[a] for a, s in zip(at[p : p + w].tolist(), slot[p : p + w]) if whole or s])
            h = pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))
            index = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(x, pa.int32()) for x in (n, width, pos)), h, pa.array(slots, pa.list_(pa.string()))], names=["id", "text_key", "n", "width", "pos", "h", "slots"])

    out = f"id {dict(table.dtypes)[id_col]}, text_key long, n int, width int, pos int, h long, slots array<string>"
    made = table.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, out)
    return made.withColumn("key", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "text_key"))


def _rare(items: DataFrame) -> DataFrame:
    """(item, h) of the windows of ``items`` without, of each item, the ones most
    frequent among the items, one fewer than it takes to cover the item: a
    document that covers it has at least one of those left."""
    often = items.groupBy("h").agg(F.countDistinct("key").alias("often"))
    at = items.join(often, "h").groupBy("key", "n", "width", "pos").agg(F.max("often").alias("often"))
    order = Window.partitionBy("key").orderBy(F.desc("often"), "pos")  # an item's windows
    needed = F.greatest(F.lit(1), F.ceil(F.round(COVER * F.col("n") / F.col("width"), 6)))
    left = at.withColumn("place", F.row_number().over(order)).where(F.col("place") >= needed).select("key", "pos")
    return left.join(items, ["key", "pos"]).select(F.col("key").alias("item"), "h").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents of ``docs(doc_id, text)`` that hold an item of
    ``benchmark(item_id, text)``: doc_id, item_id, coverage (share of the item's
    words in matching windows), reparameterised (some slot is filled otherwise)
    and text_key.

    Null and empty texts, and those without a letter or digit, match nothing. An
    item of fewer than LEAST_WORDS words matches only texts that are nothing
    else. Null ids are kept as they are; repeated rows give one row. Other
    columns, whatever their names, are not read; either table may be empty.
    Whole texts are searched, however long: a text's windows are held at once,
    those found among the benchmark's are all that goes on."""
    import numpy as np

    items = materialise(_windows(benchmark, "item_id", None, None).distinct(), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WINDOW at most
    keys = items.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).alias("k")).distinct().toArrow()["k"].to_numpy()  # 2^TABLE_BITS at most
    bits = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    bits[keys] = 1
    found = _windows(docs, "doc_id", widths, np.packbits(bits, bitorder="little").tobytes())
    # what the table let through by chance goes here; the rest is read twice, so it is written
    found = materialise(found.join(items.select("h").distinct(), "h", "left_semi"), "found")
    item = items.select(F.col("id").alias("item_id"), F.col("key").alias("item"), F.col("n").alias("words"), "width", F.col("pos").alias("at"), "h", F.col("slots").alias("theirs"))
    doc = found.select(F.col("id").alias("doc_id"), "text_key", "key", "pos", "h", "slots")
    asked = doc.join(_rare(items), "h").select("key", "item").distinct()
    pairs = asked.join(item, "item").join(doc, ["key", "h"])
    diagonal = F.col("pos") - F.col("at")
    band = F.explode(F.array(F.floor(diagonal / DRIFT) * 2, F.floor((diagonal + DRIFT / 2) / DRIFT) * 2 + 1))
    pairs = pairs.withColumn("band", band)
    # of a band at most DRIFT windows for each place in the item, by template and by words
    met = pairs.groupBy("doc_id", "text_key", "item_id", "words", "band").agg(F.collect_set(F.struct("at", "width", "pos", "theirs", "slots")).alias("found"))
    places = F.size(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1)))))
    met = met.where(places / F.col("words") >= COVER).select("doc_id", "text_key", "item_id", "words", "found")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best = [chained(x, n) for n, x in zip(batch.column(3).to_pylist(), each(batch.column(4)))]
            index = pa.array([i for i, x in enumerate(best) if x], pa.int64())
            coverage, other = (pa.array([x[k] for x in best if x], kind) for k, kind in enumerate((pa.float64(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(3)), coverage, other], names=["doc_id", "text_key", "item_id", "coverage", "other"])

    met = met.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, other boolean")
    return met.groupBy("doc_id", "text_key", "item_id").agg(F.max("coverage").alias("coverage"), F.min("other").alias("reparameterised")).select("doc_id", "item_id", "coverage", "reparameterised", "text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    return without_rows(docs, matches(docs, benchmark))
