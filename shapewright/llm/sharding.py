"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard drawn
from its id. In rounds, the copies of a text that lie in a minority shard move
to the shard where most of the others are, as far as that shard's quota allows;
what a round may move from shard to shard is a matrix of shards x shards. The
propagation works on (text, shard, copies), so a text with a third of all rows
is a few rows. Last, documents without copies fill the shards to exactly equal
counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import materialise, with_rank

SHARDS, ROUNDS = 24, 6
#: Part of its shards that a text with very many copies may take up; others live there too.
FILL = 0.8
#: Part of a shard's rows that moves may fill; the draws that admit whole blocks may go a little beyond it.
SPARE = 0.95


def propagate(blocks: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move the blocks ``blocks(text, shard, n)`` towards their texts' main
    shards: rows (text, shard, n) again, the same number of documents of each
    text. ``quota`` is the number of documents that each shard may hold."""
    shards = len(quota)
    room_each = min(quota) if min(quota) else 1
    for turn in range(rounds):
        size = blocks.groupBy("text").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.pmod(F.xxhash64("text", "shard"), F.lit(1 << 30)).alias("tie"), "shard"))).alias("held"))
        # at most one row a shard in `held`; a text needs as many shards as its copies fill
        need = F.greatest(F.lit(1), F.ceil(F.col("total") / (FILL * room_each))).cast("int")
        size = size.withColumn("homes", F.transform(F.slice("held", 1, need), lambda x: x.shard)).select("text", "homes")
        held = blocks.join(size, "text")
        home, k = F.array_contains("homes", F.col("shard")), F.size("homes")
        stay = held.where(home).select("text", "shard", F.col("shard").alias("to"), "n")
        # what is away from home goes to the homes in equal parts
        away = held.where(~home).select("text", "shard", "n", k.alias("k"), F.posexplode("homes").alias("i", "to"))
        turned = F.pmod(F.col("i") + F.pmod(F.xxhash64("text", "shard", F.lit(turn)), F.col("k")), F.col("k"))
        away = away.withColumn("n", (F.floor(F.col("n") / F.col("k")) + F.when(turned < F.col("n") % F.col("k"), 1).otherwise(0)).cast("long")).where("n > 0")
        wish = materialise(stay.unionAll(away.select("text", "shard", "to", "n")), "wishes")
        flow = wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards x shards rows at most
        load = [0] * shards
        want = {(r.shard, r.to): r.n for r in flow if r.shard != r.to}
        for r in flow:
            load[r.shard] += r.n
        if not want:
            break
        coming = [sum(n for (_, b), n in want.items() if b == t) for t in range(shards)]
        share = [1.0] * shards  # of the wishes to come that a shard can grant, with what leaves it meanwhile
        for _ in range(100):
            leaving = [sum(n * share[b] for (a, b), n in want.items() if a == t) for t in range(shards)]
            share = [min(1.0, max(0.0, quota[t] - load[t] + leaving[t]) / coming[t]) if coming[t] else 0.0 for t in range(shards)]
        part = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("to") + 1)
        draw = F.pmod(F.xxhash64("text", F.lit(turn), F.lit("move")), F.lit(1 << 30)) / float(1 << 30)
        big = F.col("n") > F.lit(max(1, room_each // 100))
        # small blocks move whole, by a draw; large ones by their share, to stay within the quota
        moved = F.when(F.col("to") == F.col("shard"), F.lit(0)).when(big, F.floor(F.col("n") * part)).when(draw < part, F.col("n")).otherwise(F.lit(0)).cast("long")
        wish = wish.withColumn("moved", moved)
        both = F.explode(F.array(F.struct(F.col("shard").alias("s"), (F.col("n") - F.col("moved")).alias("m")), F.struct(F.col("to").alias("s"), F.col("moved").alias("m"))))
        blocks = wish.select("text", both.alias("b")).where("b.m > 0").groupBy("text", F.col("b.s").alias("shard")).agg(F.sum("b.m").alias("n"))
        blocks = materialise(blocks, "blocks")
    return blocks


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, size (UTF-8 bytes + 8),
    text_crc32, law ('rows': shard counts differ by at most one), shard, slot
    (gapless from 0 in each shard) and grown_shard (null under this law).

    Null texts have size 8 and the checksum of an empty text and are linked with
    nothing; empty texts are equal texts. Null and repeated ids are rows like
    others. With fewer rows than shards some shards stay empty; an empty table
    gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha1("text").alias("text_key"), F.octet_length("text").alias("len"))
    start = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    rows = materialise(rows.withColumn("shard", start).withColumn("pid", F.spark_partition_id()), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    key = F.concat_ws(":", "text_key", "len").alias("text")
    blocks = rows.where("text_key is not null").groupBy(key, "shard").agg(F.count("*").alias("n"))
    many = materialise(blocks.groupBy("text").agg(F.sum("n").alias("total")).where("total > 1").select("text"), "copies")
    blocks = materialise(blocks.join(many, "text"), "blocks")
    placed = propagate(blocks, [int(SPARE * q) for q in quota], rounds)
    # a text's copies, by rank, go to its shards in order
    lists = placed.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("to"))  # a row a shard at most
    lists = materialise(lists, "places")
    keyed = rows.withColumn("text", F.when(F.col("text_key").isNotNull(), F.concat_ws(":", "text_key", "len")))
    # both sides exchanged: AQE splits the rows of a frequent text; pid stays that of the first table, which deals it evenly
    keyed = materialise(keyed.join(lists, "text", "left").select("doc_id", "size", "text_crc32", "shard", "text", "to", "pid"), "keyed")
    linked = with_rank(keyed.where("to is not null"), ["text"], ["doc_id"])
    fold = F.aggregate("to", F.struct(F.col("rank").cast("long").alias("left"), F.lit(-1).alias("at")), lambda s, x: F.struct(F.when(s["at"] >= 0, s["left"]).otherwise(s["left"] - x["n"]).alias("left"), F.when(s["at"] >= 0, s["at"]).when(s["left"] < x["n"], x["shard"]).otherwise(F.lit(-1)).alias("at")))
    linked = linked.withColumn("shard", fold["at"]).select("doc_id", "size", "text_crc32", "shard", F.lit(0).alias("single"))
    single = keyed.where("to is null").select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("single"))
    both = materialise(linked.unionByName(single).withColumn("pid", F.spark_partition_id()), "wanted")
    ranked = with_rank(both, ["shard", "single"], ["doc_id", "text_crc32"])
    # linked documents come first in a shard; what is beyond its quota fills the shards that lack rows
    count = {(r.shard, r.single): r.n for r in both.groupBy("shard", "single").agg(F.count("*").alias("n")).collect()}
    have = [count.get((s, 0), 0) + count.get((s, 1), 0) for s in range(shards)]
    over = [max(0, h - q) for h, q in zip(have, quota)]
    lack = [max(0, q - h) for h, q in zip(have, quota)]

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        q, h, linked = (np.array(x, dtype=np.int64) for x in (quota, have, [count.get((s, 0), 0) for s in range(shards)]))
        gone, ends = np.cumsum(over) - over, np.cumsum(lack)
        for batch in batches:
            shard, single, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
            at = rank + np.where(single == 1, linked[shard], 0)
            extra = at - q[shard] + gone[shard]  # rank among all that must go
            stay = at < q[shard]
            to = np.minimum(np.searchsorted(ends, extra, side="right"), shards - 1)
            slot = np.where(stay, at, extra - (ends - lack)[to] + h[to])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(stay, shard, to).astype(np.int32)), pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = dict(docs.dtypes)["doc_id"]
    out = ranked.select("doc_id", "size", "text_crc32", "shard", "single", "rank").mapInArrow(settle, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
