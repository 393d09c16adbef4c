"""Best-fit decreasing packing of token sequences, planned on the histogram of
piece lengths.

Lengths are whole numbers up to the capacity, so the plan needs only how many
pieces of each length there are: at most ``capacity`` counts, whatever the
corpus. Lengths are placed in decreasing order; a segment tree over remaining
capacities (0..capacity) finds the tightest class of open bins that takes the
length in logarithmic time, and as many pieces as the class has bins are placed
at once - exactly what placing them one by one does. The plan is a list of
intervals: the pieces of a length with ranks a..b go to bins x..x+b-a at an
offset. Pieces are ranked by a distributed count and look their interval up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import each, materialise, with_rank

CAPACITY = 1024
#: Id after each document.
END = 2


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which have open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        at += self.size
        self.any[at] = on
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def first(self, least: int) -> int | None:
        """The smallest capacity >= ``least`` that has open bins."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing: (length, first rank, pieces, first bin, offset).

    Bins with equal room are kept as ranges of bin numbers. ``counts`` has a
    number of pieces for lengths 1..capacity."""
    tree, room, bins, out = CapacityTree(capacity), {}, 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = tree.first(length)
            if free is None:  # a new bin's room is then the tightest, so each new bin is filled before the next
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each):
                    if n := full + (k < rest):
                        out.append((length, rank, n, bins, k * length))
                        rank += n
                for n, used, first in ((full, each * length, bins), (int(rest > 0), rest * length, bins + full)):
                    if n and capacity > used:
                        room.setdefault(capacity - used, []).append((first, n))
                        tree.set(capacity - used, True)
                bins += full + (rest > 0)
                break
            first, n = room[free].pop()
            if not room[free]:
                tree.set(free, False)
            take = min(n, left)
            if take < n:
                room[free].append((first + take, n - take))
                tree.set(free, True)
            out.append((length, rank, take, first, capacity - free))
            rank, left = rank + take, left - take
            if free > length:
                room.setdefault(free - length, []).append((first, take))
                tree.set(free - length, True)
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END,
    in pieces of ``capacity`` ids of which the first may be shorter."""
    from shapewright.llm.tokens import encode_long, load

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        coder = load(path)
        end = np.array([END], dtype="<u4")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(each(batch.column(1))):
                ids = np.concatenate((encode_long(coder, text).astype("<u4", copy=False), end)) if text else end
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    Null and empty texts are a piece of END alone. Null and repeated doc_ids are
    packed like others, a row each; other columns are not read. Ties between
    equal lengths go by place in the input's partitions. An empty table gives
    an empty result. Only lengths are shuffled, never ids or texts."""
    cut = materialise(pieces(docs, path, capacity).withColumn("pid", F.spark_partition_id()), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    placed = plan(counts, capacity)
    ranked = with_rank(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"])

    def look_up(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(sorted(placed), dtype=np.int64).reshape(-1, 5)
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            seq = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(table[at, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, out)
