"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one class. Classes are compared in tiles, in the axes of the
principal components: the products of the leading axes are summed first, the
rest is bounded by the norms of the suffixes, and a pair is dropped as soon as
sum and bound together can't reach the threshold. Pairs that remain are settled
by the cosine of the original vectors in double precision. Tiles whose first
two components are too far apart are never paired: unit vectors of cosine c are
sqrt(2 - 2c) apart, so cells of that width need only their neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import components, materialise, runs

#: Vectors in a tile at most, on average.
TILE = 2048
#: Leading axes after which a pair's bound is checked.
CHECKS = (8, 16, 32)


def _clean(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine & some)


def _axes(classes: DataFrame) -> dict[int, list]:
    """Principal axes of the unit vectors by dimension, from sums of products
    over all classes; at most dim x dim numbers come to the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for d, x in _by_dim(batch.column(0)):
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": [d], "s": [s.ravel().tolist()]}, schema=pa.schema([("dim", pa.int32()), ("s", pa.list_(pa.float64()))]))

    parts = classes.select("embedding").mapInArrow(run, "dim int, s array<double>")
    rows = parts.select("dim", F.posexplode("s").alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d in {r.dim for r in rows}:
        m = np.zeros(d * d)
        for r in rows:
            if r.dim == d:
                m[r.at] = r.v
        m = m.reshape(d, d)
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _by_dim(col):
    """(dimension, unit vectors) of an Arrow list column, by dimension."""
    import numpy as np

    n = col.value_lengths().to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(n) - n
    for d in np.unique(n):
        x = flat[at[n == d][:, None] + np.arange(d)]
        yield int(d), unit(x)


def unit(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(x, y, axes, threshold: float, checks=CHECKS):
    """Pairs (i, j) of rows of unit vectors ``x`` and ``y`` with cosine >= threshold."""
    import numpy as np

    px, py = x @ axes, y @ axes
    d = px.shape[1]
    cuts = [c for c in checks if c < d]
    rest = lambda p, c: np.sqrt(np.maximum(0, (p[:, c:] ** 2).sum(axis=1)))
    slack = threshold - 1e-9
    if not cuts:
        i, j = np.nonzero(px @ py.T >= slack)
    else:
        c = cuts[0]
        part = px[:, :c] @ py[:, :c].T
        i, j = np.nonzero(part + np.outer(rest(px, c), rest(py, c)) >= slack)
        held = part[i, j]
        for c, up in zip(cuts, [*cuts[1:], d]):
            keep = []
            for at in range(0, len(i), 1 << 18):
                s = slice(at, at + (1 << 18))
                held[s] += np.einsum("ij,ij->i", px[i[s], c:up], py[j[s], c:up])
                bound = rest(px, up)[i[s]] * rest(py, up)[j[s]] if up < d else 0
                keep.append(held[s] + bound >= slack)
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            i, j, held = i[keep], j[keep], held[keep]
    sure = [np.einsum("ij,ij->i", x[i[at : at + (1 << 18)]], y[j[at : at + (1 << 18)]]) >= threshold for at in range(0, len(i), 1 << 18)]
    sure = np.concatenate(sure) if sure else np.zeros(0, dtype=bool)
    return i[sure], j[sure]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links (other
    rows with equal label and cosine >= threshold), component_id (smallest
    vec_id reachable by links) and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with null label or null vec_id, link with nothing: n_links 0, own
    component. Vectors of different dimensions don't link. Repeated rows link
    with each other. All classes of a label are compared; none is sampled."""
    from shapewright.llm.simhash import Forest

    # a class: the rows with equal label and vector; its smallest vec_id stands for it
    classes = _clean(vectors).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = materialise(classes, "classes")
    axes = _axes(classes)
    wide = math.sqrt(2 - 2 * threshold) + 1e-6

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = batch.column(0)
            n = col.value_lengths().to_numpy()
            cell = np.zeros((2, len(n)), dtype=np.int64)
            for d, x in _by_dim(col):
                p = x @ axes[d][:, :2]
                cell[: p.shape[1], n == d] = np.floor(p.T / wide).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int32)), pa.array(cell[0]), pa.array(cell[1])], names=[*batch.schema.names, "dim", "c1", "c2"])

    kind = dict(classes.dtypes)
    fields = ", ".join(f"{c} {kind[c]}" for c in ("embedding", "label", "rep", "mult"))
    placed = materialise(classes.select("embedding", "label", "rep", "mult").mapInArrow(place, f"{fields}, dim int, c1 long, c2 long"), "placed")
    cell = ["label", "dim", "c1", "c2"]
    tiles = placed.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / tile).cast("int").alias("k"))
    tiles = materialise(tiles, "tiles")
    # the tiles that each cell meets: its own and its neighbours'
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")
    near = tiles.select(*cell, step).select("label", "dim", (F.col("c1") + F.col("d.a")).alias("c1"), (F.col("c2") + F.col("d.b")).alias("c2"), F.col("c1").alias("m1"), F.col("c2").alias("m2"))
    near = tiles.join(near, cell).select("label", "dim", F.col("m1").alias("c1"), F.col("m2").alias("c2"), F.col("c1").alias("n1"), F.col("c2").alias("n2"), F.col("k").alias("nk"))
    near = near.join(tiles, cell).groupBy(*cell, "k").agg(F.collect_list(F.struct("n1", "n2", "nk")).alias("near"))  # nine at most
    dealt = placed.join(near, cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    other = F.explode(F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x.nk.cast("int") - 1), lambda t: F.struct(x.n1.alias("c1"), x.n2.alias("c2"), t.alias("t"))))))
    dealt = dealt.withColumn("other", other)
    mine, theirs = F.struct("c1", "c2", F.col("own").alias("t")), F.struct("other.c1", "other.c2", "other.t")
    dealt = dealt.select(F.xxhash64("label", "dim", F.least(mine, theirs), F.greatest(mine, theirs)).alias("unit"), "label", (mine <= theirs).alias("first"), "rep", "mult", "embedding", (mine == theirs).alias("same"))
    dealt = dealt.repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in runs(batches, "unit"):
            first, same = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("first", "same"))
            rep, mult = (table[c].combine_chunks().to_numpy() for c in ("rep", "mult"))
            if same.all():
                a = b = np.arange(len(rep))
            else:
                a, b = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(a) or not len(b):
                continue
            (d, x), *_ = _by_dim(table["embedding"].combine_chunks())
            i, j = compare(x[a], x[b], axes[d], threshold)
            if same.all():
                i, j = i[i < j], j[i < j]
            i, j = a[i], b[j]
            if not len(i):
                continue
            n = np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep))
            forest = Forest(len(rep))
            forest.join(i, j)
            src, dst = np.arange(len(rep))[n > 0], forest.root[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(rep[src]), pa.array(rep[dst]), pa.array(n[n > 0].astype(np.int64))], names=["src", "dst", "n"])

    found = materialise(dealt.mapInArrow(run, "src long, dst long, n long"), "links")
    n = found.groupBy("src").agg(F.sum("n").alias("n"))
    comp = components(found.select("src", "dst"))
    of = classes.join(n, classes.rep == n.src, "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = materialise(of.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("component")), "of")
    out = vectors.select("vec_id", "label", "embedding")
    out = out.join(of, (out.label == of.l) & (out.embedding == of.e) & out.vec_id.isNotNull(), "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
