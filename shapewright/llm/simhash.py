"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import components, each, materialise, without_rows

SEED = 42
BITS = 64
#: Shingles hashed at once, so that a very long text needs little memory.
STEP = 1 << 16


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned.

    A-Z are lower-cased, words are runs of non-white-space bytes, shingles are
    ``width`` words (fewer words: the whole sequence; none or null: zero)."""
    import numpy as np
    import xxhash

    words = raw.lower().split() if raw else []  # bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[len(words) - n :]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        cut = zip(starts[at : min(n, at + STEP)].tolist(), last[at : at + STEP].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in cut], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, k in enumerate(ones.tolist()) if 2 * k > n)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint of each whole text, as a signed
    long, and xxhash64 of the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = each(batch.column(2).cast(pa.binary()))
            fp = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], names=["doc_id", "text_key", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, fp long")


def popcount(x):
    import numpy as np

    return np.bitwise_count(x)


def trie_pairs(keys, budget: int, leaf: int = 64):
    """All pairs (i, j), i < j, of sorted unsigned 64-bit ``keys`` that differ in
    at most ``budget`` bits, in blocks; keys may repeat.

    ``keys`` in order are the leaves of a binary trie; a node is a range of
    them. All open node pairs go down one level together: a pair of children on
    different sides costs one bit, and pairs beyond the budget are dropped.
    Pairs of small nodes are settled by their leaves."""
    import numpy as np

    n = len(keys)
    if n < 2:
        return
    lo1, hi1, lo2, hi2, cost = (np.array([x]) for x in (0, n, 0, n, 0))
    for bit in range(BITS - 1, -1, -1):
        small = (hi1 - lo1) * (hi2 - lo2) <= leaf
        if small.any():
            yield from _leaves(keys, lo1[small], hi1[small], lo2[small], hi2[small], budget)
        lo1, hi1, lo2, hi2, cost = (x[~small] for x in (lo1, hi1, lo2, hi2, cost))
        if not len(lo1):
            return
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        m1, m2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = lo1 == lo2
        parts = [(lo1, m1, lo2, m2, cost), (m1, hi1, m2, hi2, cost), (lo1, m1, m2, hi2, cost + 1), (m1[~same], hi1[~same], lo2[~same], m2[~same], cost[~same] + 1)]
        lo1, hi1, lo2, hi2, cost = (np.concatenate([p[i] for p in parts]) for i in range(5))
        keep = (hi1 > lo1) & (hi2 > lo2) & (cost <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, cost = (x[keep] for x in (lo1, hi1, lo2, hi2, cost))
    for a, b, c, d in zip(lo1.tolist(), hi1.tolist(), lo2.tolist(), hi2.tolist()):  # nodes of equal keys
        high = max(1, (1 << 20) // (d - c))
        cuts = np.arange(a, b, high)
        for x in cuts:
            yield from _leaves(keys, *(np.array([v]) for v in (x, min(b, x + high), c, d)), budget)


def _leaves(keys, lo1, hi1, lo2, hi2, budget: int, step: int = 1 << 16):
    import numpy as np

    for at in range(0, len(lo1), step):
        a, b, c, d = (x[at : at + step] for x in (lo1, hi1, lo2, hi2))
        wide = d - c
        size = (b - a) * wide
        which = np.repeat(np.arange(len(a)), size)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        i, j = a[which] + k // wide[which], c[which] + k % wide[which]
        near = (i < j) & (popcount(keys[i] ^ keys[j]) <= budget)
        if near.any():
            yield i[near], j[near]


class Forest:
    """Disjoint sets of 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def join(self, i, j) -> None:
        import numpy as np

        while True:
            a, b = self.root[i], self.root[j]
            if (far := a != b).sum() == 0:
                return
            i, j, a, b = i[far], j[far], a[far], b[far]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


#: The key bits are cut into BLOCKS; two keys that differ in at most `budget`
#: bits agree in at least BLOCKS - budget of them.
BLOCKS = 6
#: Distinct fingerprints that share a block key, in one task, and trie bits that larger groups are cut by at a time.
GROUP = 4096
CUT = 4


def _split(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    at = [BITS * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def links(fps: DataFrame, budget: int = 4, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """A spanning forest of the links among distinct fingerprints ``fps(fp)``:
    rows (src, dst) that connect exactly what links of at most ``budget``
    differing bits connect.

    Two linked fingerprints agree in blocks - budget whole blocks. For each
    choice of so many blocks the fingerprints are dealt out by the bits in
    them; those that share these bits are one subtrie, self-joined in one task.
    Subtries of more than ``group`` fingerprints are cut by their next CUT trie
    bits into node pairs within what is left of the budget, a task each, and
    those that are still too large again, until all fit or no bits are left."""
    choices = list(itertools.combinations(_split(blocks), blocks - budget))

    def packed(cut):
        out = F.lit(0).cast("long")
        for lo, w in cut:
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << w) - 1)))
        return out

    keys = F.array(*[F.struct(F.lit(n).alias("t"), packed(cut).alias("k")) for n, cut in enumerate(choices)])
    dealt = fps.select("fp", F.explode(keys).alias("at")).select("at.t", "at.k", "fp")
    # a unit is a pair of trie nodes, at first a subtrie with itself; side: 0 or 1 of the pair, or -1 for both
    dealt = dealt.select("t", "k", "fp", F.lit(0).cast("long").alias("unit"), F.lit(-1).alias("side"), F.lit(0).alias("spent"))
    done = []
    for level in range(0, BITS - max(sum(w for _, w in cut) for cut in choices) - CUT, CUT):
        hot = dealt.groupBy("t", "k", "unit").count().where(F.col("count") > group).select("t", "k", "unit")
        hot = materialise(hot, "hot")
        if hot.isEmpty():
            break
        done.append(dealt.join(hot, ["t", "k", "unit"], "left_anti").select(F.xxhash64("t", "k", "unit").alias("g"), "fp"))
        # what is cut further is written, so that the next round counts and cuts a table, not this plan again
        dealt = materialise(_node_pairs(dealt.join(hot, ["t", "k", "unit"]), choices, budget, level), "cut")
    done.append(dealt.select(F.xxhash64("t", "k", "unit").alias("g"), "fp"))
    dealt = functools.reduce(DataFrame.unionByName, done).repartition("g").sortWithinPartitions("g")
    return dealt.select("g", F.col("fp").alias("node"), "fp").mapInArrow(lambda batches: _links(batches, budget), "src long, dst long")


def _node_pairs(big: DataFrame, choices, budget: int, level: int) -> DataFrame:
    """Rows of large units in the pairs of their nodes' children, told apart by
    the CUT bits after the first ``level`` ones outside the shared blocks: a row
    is in the pairs of its own child with each child of the other node that
    differs in no more bits than the budget leaves after what the unit's nodes
    have ``spent``."""
    child = F.lit(0).cast("long")
    for t, cut in enumerate(choices):
        fixed = {b for lo, w in cut for b in range(lo, lo + w)}
        own = F.lit(0).cast("long")
        for b in [b for b in range(BITS - 1, -1, -1) if b not in fixed][level : level + CUT]:
            own = F.shiftleft(own, 1).bitwiseOR(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)))
        child = F.when(F.col("t") == t, own).otherwise(child)
    flip = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("n")) for m in range(1 << CUT)]))
    out = big.withColumn("child", child).withColumn("flip", flip).where(F.col("spent") + F.col("flip.n") <= budget)
    mate = F.col("child").bitwiseXOR(F.col("flip.m"))
    within = F.when(mate == F.col("child"), -1).when(F.col("child") < mate, 0).otherwise(1)
    side = F.when(F.col("side") == -1, within).otherwise(F.col("side"))
    out = out.withColumn("mate", mate).withColumn("to", side)
    left, right = F.when(F.col("to") == 1, F.col("mate")).otherwise(F.col("child")), F.when(F.col("to") == 1, F.col("child")).otherwise(F.col("mate"))
    return out.select("t", "k", "fp", F.xxhash64("unit", left, right).alias("unit"), F.col("to").alias("side"), (F.col("spent") + F.col("flip.n")).alias("spent"))


def _links(batches, budget: int, most: int | None = None, spanning: bool = False):
    import numpy as np
    import pyarrow as pa

    for src, dst in _joined(batches, budget, most, spanning):
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(src)), pa.array(np.asarray(dst))], names=["src", "dst"])


def _joined(batches, budget: int, most: int | None, spanning: bool = False, few: int = 16):
    """Links within the runs of equal ``g`` of batches (g, node, fingerprint): of
    runs of up to ``few`` keys all of a batch at once, of longer ones a forest
    each; with ``spanning`` a forest of all, whose nodes may have several keys. The
    first 64 bits are the trie key; with ``most`` the fingerprint is a wide one,
    of which so many bits may differ in all."""
    import numpy as np

    held = []

    def stars(nodes, root):
        at = np.flatnonzero(nodes != nodes[root])
        return np.unique(np.stack([nodes[root[at]], nodes[at]]), axis=1)

    def near(words, i, j, step: int = 1 << 18):
        if most is None:
            return np.ones(len(i), dtype=bool)
        parts = [popcount(words[i[at : at + step]] ^ words[j[at : at + step]]).sum(axis=1) <= most for at in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            g, nodes = (batch.column(i).to_numpy() for i in range(2))
            fp = batch.column(2).to_numpy().view(np.uint64) if most is None else np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8")
            held.append((g, nodes, fp.reshape(len(g), fp.size // max(1, len(g)))))
            if held[-1][0].size == 0 or held[0][0][0] == held[-1][0][-1]:
                held = [x for x in held if x[0].size]
                continue
        if not held:
            continue
        g, nodes, words = (np.concatenate([x[i] for x in held]) for i in range(3))
        keys = words[:, 0].copy()
        starts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(g)]))
        if batch is not None:  # the last run may go on
            held = [tuple(x[starts[-1] :] for x in (g, nodes, words))]
            starts, ends = starts[:-1], ends[:-1]
        size = ends - starts
        some = (size > 1) & (size <= few)
        forest = Forest(len(g)) if spanning else None
        for i, j in _leaves(keys, starts[some], ends[some], starts[some], ends[some], budget):
            fine = near(words, i, j)
            if forest is None:
                yield nodes[i[fine]], nodes[j[fine]]
            else:
                forest.join(i[fine], j[fine])
        if forest is not None:
            yield stars(nodes, forest.root)
        for lo, hi in zip(starts[size > few], ends[size > few]):
            order = lo + np.argsort(keys[lo:hi], kind="stable")
            forest = Forest(len(order))
            for i, j in trie_pairs(keys[order], budget):
                apart = forest.root[i] != forest.root[j]
                i, j = i[apart], j[apart]
                fine = near(words, order[i], order[j])
                forest.join(i[fine], j[fine])
            if spanning:
                yield stars(nodes[order], forest.root)
                continue
            at = np.flatnonzero(forest.root != np.arange(len(order)))
            if len(at):
                yield nodes[order[forest.root[at]]], nodes[order[at]]


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id -
    the smallest doc_id reachable over links of at most ``budget`` bits -,
    text_key (xxhash64 of the text) and component (its own key).

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and equal texts share a fingerprint and so a component. Null
    doc_ids get a row; they are never a component_id unless the component has
    no other (then it is null). Whole texts are read, STEP shingles at a time.
    Other columns, whatever their names, are not read; an empty table gives an
    empty result."""
    fp = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = materialise(components(links(classes.select("fp"), budget)), "components")
    out = _by_component(fp.withColumn("node", F.col("fp")), classes.select(F.col("fp").alias("node"), "first"), found.withColumnRenamed("node", "of"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key", "component")


# --- near copies by a similarity of shingle sets ---

#: Words in a shingle, 64-bit words of a wide fingerprint, and bits of it that may differ. Shingle sets of Jaccard
#: similarity 0.8 (equal sizes: cosine 0.889, an angle of 0.1515 pi) differ in 77.6 of 512 bits, give or take 8.1.
SIMILAR_WIDTH, WIDE, WIDE_BUDGET = 5, 8, 86
#: Bits that the trie key, the first 64, may differ in: more than any but one in 1,000 pairs within WIDE_BUDGET does.
TRIE_BUDGET = 20
#: Bytes that tell a table's subtries apart; a wide fingerprint has 64 / TABLE tables.
TABLE = 2
#: Wide fingerprints of a subtrie in one block, on average.
WIDE_GROUP = 1024


def shingle_set(raw: bytes | None, width: int = SIMILAR_WIDTH):
    """The distinct hashes of the text's shingles (lower-case words; fewer words
    than ``width``: the whole sequence; none: none)."""
    import numpy as np
    import xxhash

    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, last = np.concatenate(([0], ends[:-1] + 1))[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, last)), dtype=np.uint64, count=n))


def wide_fingerprint(raw: bytes | None, width: int = SIMILAR_WIDTH) -> bytes:
    """A SimHash of WIDE x 64 bits of the text's ``shingle_set`` (none: zeros)."""
    import numpy as np

    h = shingle_set(raw, width)
    if not len(h):
        return bytes(8 * WIDE)
    ones = np.zeros(BITS * WIDE, dtype=np.int64)
    salt = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255 * 16):
        x = h[at : at + 255 * 16, None] ^ salt
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # counts up to 255 fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def wide_links(classes: DataFrame, most: int = WIDE_BUDGET, group: int = WIDE_GROUP) -> DataFrame:
    """Links (src, dst) among ``classes(node, fp)`` that connect what pairs of at
    most ``most`` differing bits connect, if they agree in one table's bytes.

    The fingerprint is cut into tables of TABLE bytes; those that agree in a
    table are one subtrie, self-joined in one task. Larger subtries are dealt
    into blocks, and each pair of blocks is a task's."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("fp", TABLE * t + 1, TABLE)) for t in range(8 * WIDE // TABLE)])
    return _subtrie_links(classes.select("node", "fp", F.explode(keys).alias("g")), group, TRIE_BUDGET, most)


def _subtrie_links(dealt: DataFrame, group: int, budget: int, most: int, spanning: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """The links ``_joined`` finds within each ``g`` of ``dealt(node, fp, g)``;
    that of more than ``group`` rows is dealt into blocks, a task each pair. With
    ``counted(g)`` the rows of a ``g`` are told by these of one row in SHARE."""
    n = F.col("count") * (1 if counted is None else SHARE)
    hot = (dealt if counted is None else counted).groupBy("g").count().where(n > group)
    hot = materialise(hot.select(F.col("g").alias("h"), F.ceil(n / group).cast("int").alias("k")), "hot")
    if not hot.isEmpty():
        big = dealt.join(hot, dealt.g == hot.h)
        own = F.pmod(F.xxhash64("node", "fp"), F.col("k")).cast("int")
        big = big.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        big = big.select("node", "fp", F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
        dealt = dealt.join(hot, dealt.g == hot.h, "left_anti").unionByName(big)
    dealt = dealt.select("g", "node", "fp").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(lambda batches: _links(batches, budget, most, spanning), "src long, dst long")


def similar(docs: DataFrame, width: int = SIMILAR_WIDTH, most: int = WIDE_BUDGET) -> DataFrame:
    """Per row of ``docs``: doc_id, component_id - the smallest doc_id reachable
    over links of texts whose sets of ``width``-word shingles are about 0.8
    similar or more - and text_key (xxhash64 of the text).

    Similarity is told by the differing bits of wide fingerprints. Texts without
    words are one class. Null and repeated ids, other columns and empty tables
    are treated as ``near_duplicates`` does."""
    fp = _wide_fingerprints(docs, width)
    classes = materialise(fp.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp")), "classes")
    edges = materialise(wide_links(classes.select("node", "fp"), most).distinct(), "links")
    found = materialise(components(edges).withColumnRenamed("node", "of"), "components")
    return _by_component(fp, classes.select("node", "first"), found).select("doc_id", "component_id", "text_key", "component")


def _wide_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, size, fp, node): bytes of the texts, wide fingerprints and
    their hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = [wide_fingerprint(t, width) for t in each(batch.column(3).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.binary())], names=["doc_id", "text_key", "size", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    fp = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    fp = fp.mapInArrow(run, f"doc_id {kind}, text_key long, size long, fp binary")
    return materialise(fp.withColumn("node", F.xxhash64("fp")), "fingerprints")


#: Candidates for the exact comparison: texts that agree in one of SAMPLES samples of SAMPLE_BITS bits and differ in at
#: most HEAD_BUDGET of the first HEAD bytes' bits (of them TRIE_BUDGET in the trie key). A pair of similarity 0.8
#: differs in 15.2 % of the bits; by calculation 0.4 % of such pairs aren't candidates. Of pairs that share nothing one
#: in 10^11 is within HEAD_BUDGET (of 36 of 128 bits: one in 2.5 million, which at 10^7 texts chains them all together).
SAMPLES, SAMPLE_BITS, HEAD, HEAD_BUDGET = 64, 14, 24, 50
#: Samples of the first pass: what they connect is one node for the others.
EARLY = 8
#: One text in SHARE tells which samples' runs are too long for a task.
SHARE = 16
#: Texts, and bytes of them, that are compared in one task, on average; texts that each block of a larger group has.
COMPARED, COMPARED_BYTES, PIVOTS = 1024, 16 << 20, 32
#: Bits of a text's hash that pick its word of 64 bits in the table of texts to be compared: 2 MB, whatever their number.
FILTER_BITS = 18


def near_copies(docs: DataFrame, width: int = SIMILAR_WIDTH, tenths: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, component_id - the smallest doc_id reachable
    over links of texts whose sets of ``width``-word shingles have a Jaccard
    similarity of ``tenths`` tenths or more - and text_key (xxhash64 of the text).

    Wide fingerprints give the candidates (see SAMPLES), of which a spanning
    forest a run is kept, first of EARLY samples and then, between what these
    connect, of the others: texts that candidates connect are a group. Within each
    group shingle sets are compared exactly, so that no link is below the bound;
    what is connected already isn't compared again, and only links that connect
    come out. Texts of equal fingerprints are one class. Null and repeated ids,
    other columns and empty tables are treated as ``near_duplicates`` does."""
    fp = _wide_fingerprints(docs, width)
    classes = fp.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.min(F.struct("text_key", "size")).alias("t"))
    classes = materialise(classes.select("node", "first", "fp", F.col("t.text_key").alias("k"), F.col("t.size").alias("size")), "classes")
    now, found = classes.select("node", "fp", (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SHARE)) == 0).alias("counts")), None
    for early in (True, False):
        some = range(EARLY) if early else range(EARLY, SAMPLES)
        counted = _samples(now.where("counts"), some, HEAD).select("g")
        pairs = _subtrie_links(_samples(now, some, HEAD), GROUP, TRIE_BUDGET, HEAD_BUDGET, True, counted)
        pairs = materialise(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "candidates")
        if found is not None:
            pairs = pairs.unionAll(found.select(F.col("of").alias("src"), F.col("component").alias("dst")))
        found = materialise(components(pairs).withColumnRenamed("node", "of"), "components")
        if early:
            now = now.join(found, now.node == found.of, "left").select(F.coalesce("component", "node").alias("node"), "fp", "counts")
            now = materialise(now, "now")
    found = _compared(docs, classes, found.withColumnRenamed("of", "node"), width, tenths)
    return _by_component(fp, classes.select("node", "first"), found.withColumnRenamed("node", "of")).select("doc_id", "component_id", "text_key", "component")


def _compared(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, tenths: int) -> DataFrame:
    """(node, component) of the nodes that have a text similar enough in their
    group of ``groups(node, component)``.

    A group is compared in one task. A larger one is dealt into blocks that share
    about PIVOTS of its texts, which joins dense groups in one pass; then the
    texts outside the largest component - a block of them a task - are compared
    with each block of the whole group."""
    members = materialise(groups.withColumnRenamed("component", "of").join(classes.select("node", "k", "size"), "node"), "members")
    blocks = lambda n: F.greatest(F.ceil(n / COMPARED), F.ceil(F.sum("size") / COMPARED_BYTES)).cast("int")
    many = members.groupBy("of").agg(F.count("*").alias("n"), blocks(F.count("*")).alias("b")).where("b > 1")
    many = materialise(many, "many")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("b")).cast("int")
    columns = ["k", "node", "of", "query"]
    if many.isEmpty():
        dealt = members.select(F.col("of").alias("g"), "k", "node", F.col("node").alias("of"), F.lit(True).alias("query"))
        return components(_similar(docs, dealt, width, tenths, "links"))
    big = materialise(members.join(many, "of").withColumn("own", own), "big")
    pivot = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")) < PIVOTS
    first = big.withColumn("at", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.array("own"))))
    first = first.select(F.xxhash64("of", "at").alias("g"), "k", "node").unionByName(members.join(many, "of", "left_anti").select(F.col("of").alias("g"), "k", "node"))
    edges = _similar(docs, first.select("g", "k", "node", F.col("node").alias("of"), F.lit(True).alias("query")), width, tenths, "links")
    found = components(edges)
    now = big.join(found, "node", "left").withColumn("now", F.coalesce("component", "node")).drop("component")
    now = materialise(now, "now")
    most = now.groupBy("of", "now").agg(F.count("*").alias("m")).groupBy("of").agg(F.max_by("now", F.struct("m", "now")).alias("most"))
    rest = now.join(most, "of").where("now <> most")
    parts = materialise(rest.groupBy("of").agg(blocks(F.count("*")).alias("r")), "parts")
    if parts.isEmpty():
        return found
    queries = rest.join(parts, "of").withColumn("part", F.pmod(F.xxhash64("node", F.lit(4)), F.col("r")).cast("int"))
    queries = queries.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("query", F.lit(True))
    others = now.join(parts, "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("at", F.col("own")).withColumn("query", F.lit(False))
    both = queries.select(F.xxhash64("of", "part", "at").alias("g"), "k", "node", F.col("now").alias("of"), "query")
    both = both.unionByName(others.select(F.xxhash64("of", "part", "at").alias("g"), "k", "node", F.col("now").alias("of"), "query"))
    more = _similar(docs, both.select("g", *columns), width, tenths, "more")
    return components(more.unionAll(found.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, text) once for each text whose hash is in ``keys(k)``, and for others by
    chance: a broadcast table of the keys' bits tells which texts are shuffled."""
    bit = f"cast(shiftrightunsigned(k, {58 - FILTER_BITS}) & 63 as int)"
    table = keys.groupBy(F.shiftrightunsigned("k", 64 - FILTER_BITS).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    texts = docs.select(F.xxhash64("text").alias("k"), "text")
    held = (F.shiftrightunsigned("k", 64 - FILTER_BITS) == F.col("word")) & F.expr(f"shiftrightunsigned(bits, {bit}) & 1 = 1")
    return texts.join(F.broadcast(table), held, "left_semi").dropDuplicates(["k"])


def _similar(docs: DataFrame, dealt: DataFrame, width: int, tenths: int, name: str) -> DataFrame:
    """Links (src, dst) that connect what is similar enough within each ``g`` of
    ``dealt(g, k, node, of, query)``: a query and any row, of different ``of``."""
    kind = "src long, dst long"

    def run(batches):
        import pyarrow as pa

        def links(pairs):
            return pa.RecordBatch.from_arrays([pa.array([x[side] for x in pairs], pa.int64()) for side in (0, 1)], names=["src", "dst"])

        now, out = None, []
        for batch in itertools.chain(batches, [None]):
            rows = [(None, None, None, None, None)]  # after the last
            if batch is not None:
                rows = zip(*(batch.column(i).to_pylist() for i in range(4)), each(batch.column(4).cast(pa.binary())))
            for g, node, of, query, text in rows:
                if now is not None and now[0] != g:
                    out += [(now[1][i], now[1][j]) for i, j in similar_pairs(now[4], now[2], now[3], tenths)]
                    if len(out) > 4096 or batch is None:
                        yield links(out)
                        out = []
                if batch is not None and (now is None or now[0] != g):
                    now = g, [], [], [], []
                if batch is not None:
                    for to, x in zip(now[1:], (node, of, query, shingle_set(text, width))):
                        to.append(x)

    rows = dealt.join(_texts(docs, dealt.select("k")), "k").select("g", "node", "of", "query", "text").repartition("g").sortWithinPartitions("g")
    return materialise(rows.mapInArrow(run, kind).distinct(), name)


def similar_pairs(sets, of, query, tenths: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of ``sets`` (sorted distinct hashes) that connect what pairs of
    a Jaccard similarity of ``tenths`` tenths or more connect, if i or j is a
    ``query``; sets of equal ``of`` are connected already. Only sets whose sizes
    allow it, and that no pair before has connected, are compared."""
    import numpy as np

    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    n, size = len(order), size[order]
    if n < 2:
        return []
    label = np.unique(np.asarray(of)[order], return_inverse=True)[1]
    asks = np.asarray(query)[order]
    words, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(words), dtype=np.uint8)
    out = []
    for a in np.flatnonzero(asks):
        lo, hi = np.searchsorted(10 * size, tenths * size[a], "left"), np.searchsorted(tenths * size, 10 * size[a], "right")
        to = lo + np.flatnonzero((label[lo:hi] != label[a]) & ~(asks[lo:hi] & (np.arange(lo, hi) < a)))
        if not len(to):
            continue
        mark[flat[starts[a] : ends[a]]] = 1
        begin = np.cumsum(size[to]) - size[to]
        at = np.arange(begin[-1] + size[to[-1]]) + np.repeat(starts[to] - begin, size[to])
        both = np.add.reduceat(mark[flat[at]], begin, dtype=np.int64)
        mark[flat[starts[a] : ends[a]]] = 0
        to = to[10 * both >= tenths * (size[a] + size[to] - both)]
        if len(to):
            joined, first = np.unique(label[to], return_index=True)
            out += [(int(order[a]), int(order[x])) for x in to[first]]
            label[np.isin(label, joined)] = label[a]
    return out


def _samples(classes: DataFrame, samples: range, head: int) -> DataFrame:
    """(node, fp: ``head`` bytes of the fingerprint, g: sample and its bits) of
    ``classes(node, fp)``, a row for each of ``samples``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(SEED)
        picked = np.stack([rng.choice(BITS * WIDE, SAMPLE_BITS, replace=False) for _ in range(SAMPLES)])[list(samples)]
        weights = 1 << np.arange(SAMPLE_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                g = bits[:, picked] @ weights + (np.array(samples) << SAMPLE_BITS)
                index = pa.array(np.repeat(np.arange(part.num_rows), len(samples)))
                heads = pa.array([x.tobytes() for x in raw[:, :head]], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), heads.take(index), pa.array(g.ravel())], names=["node", "fp", "g"])

    return classes.select("node", "fp").mapInArrow(run, "node long, fp binary, g long")


def _by_component(fp: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``fp(node, ...)`` with component, a node for each component, and
    component_id, the smallest ``first`` of the ``classes(node, first)`` in it by
    ``found(of, component)``."""
    joined = classes.join(found, classes.node == found.of, "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    joined = materialise(joined, "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialise(joined.join(least, "component").select(F.col("node").alias("key"), "component", "component_id"), "of")
    # both sides are exchanged, so AQE splits the rows of a frequent fingerprint
    return fp.join(of, fp.node == of.key)


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each component of ``found`` (by default that
    of ``near_duplicates``; ``near_copies`` gives others): that with the smallest
    doc_id, and of several rows with this id in one component any one. Rows with
    a null doc_id go if their component has any doc_id, and else all stay. Rows
    that share a doc_id but not a component are judged each by its own; null and
    empty texts are a group like others. Other columns, whatever their names, are
    kept as they are; an empty table stays empty."""
    found = materialise((near_duplicates(docs) if found is None else found).select("doc_id", "component_id", "text_key", "component"), "near")
    out = without_rows(docs, found.where("doc_id <> component_id or (doc_id is null and component_id is not null)"))
    # several rows of a component's first document are rare: only these are dealt out
    first = found.where("doc_id = component_id")
    many = first.groupBy("component").count().where("count > 1").select("component")
    many = materialise(first.join(many, "component").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("component").alias("_c")).distinct(), "many")
    if many.isEmpty():
        return out
    same = (out.doc_id == many._d) & (F.xxhash64(out.text) == many._k)
    alone = out.join(many, same, "left_anti")
    packed = out.select(F.struct("*").alias("row"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_t"))
    one = packed.join(many, (packed._i == many._d) & (packed._t == many._k)).dropDuplicates(["_c"]).select("row.*")
    return alone.unionByName(one)
