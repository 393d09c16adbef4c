"""What the training-data operators share: tables in the shared folder, gapless
ranks, connected components and removal of rows by key."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapewright.tables import new_dir, stored

__all__ = ["components", "each", "materialise", "new_dir", "runs", "with_rank", "without_rows"]

#: Keys in a broadcast set at most (8 bytes each in the smallest form); beyond, a shuffled join.
BROADCAST_KEYS = 1_000_000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what is read later survives the loss of any executor."""
    return stored(df, name)


def with_rank(df: DataFrame, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Add ``rank``, gapless from 0 among the rows with equal ``by``.

    ``df`` must come from ``materialise`` and have the column ``pid``, the
    number of the task that wrote the row. Rows are numbered within (pid, by)
    and moved up by the counts of smaller pids, so that no task holds all rows
    of a frequent key: a group is at most what one task has written."""
    counts = df.groupBy("pid", *by).count()
    before = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("pid", *by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    at = Window.partitionBy("pid", *by).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(at) - 1)
    return numbered.join(base, ["pid", *by]).withColumn(rank, F.col("_base") + F.col("_row")).drop("_base", "_row")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``, longs without nulls.

    Returns (node, component) for every node of an edge; component is the
    smallest node reachable. Large-star and small-star steps alternate, each a
    grouped minimum (pre-aggregated) and a join whose two sides are both
    exchanged, so that AQE can split the rows of a very frequent node. Each
    step's edges are written to the shared folder. Stops when a round changes
    nothing; an empty input gives an empty result."""
    pair = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = materialise(pair.distinct(), "edges")
    state = F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.xxhash64("dst", "src")), F.lit(0)).alias("y")
    seen = now.agg(*state).first()
    while seen.n:
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = materialise(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m")), "least")
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = materialise(large.where("src <> dst").distinct(), "large")
        least = materialise(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = materialise(small.unionAll(least.withColumnRenamed("m", "dst")).distinct(), "edges")
        was, seen = seen, now.agg(*state).first()
        if was == seen:
            break
    out = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return out.unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't in ``gone(doc_id, text_key)``, where
    text_key is xxhash64(text); null ids match null ids. Broadcast up to
    BROADCAST_KEYS rows, beyond that both sides are shuffled."""
    gone = materialise(gone.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "gone")
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._d) & (F.xxhash64(docs.text) == gone._k), "left_anti")


def each(column, step: int = 256):
    """The values of an Arrow column, ``step`` of them in memory at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def runs(batches, key: str):
    """Regroup Arrow batches sorted by ``key`` into one table per equal key.

    Holds the rows of one key and one batch at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([batch]) if batch is not None and batch.num_rows else None
        if batch is None:
            if held:
                yield pa.concat_tables(held).combine_chunks()
            return
        if table is None:
            continue
        col = table[key].combine_chunks()
        n = len(col)
        cut = pc.indices_nonzero(pc.not_equal(col.slice(1), col.slice(0, n - 1))).to_numpy() + 1 if n > 1 else []
        edges = [0, *(int(c) for c in cut), n]
        for lo, hi in zip(edges, edges[1:]):
            part = table.slice(lo, hi - lo)
            if held and held[0][key][0].as_py() != part[key][0].as_py():
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
