"""Packing documents into as few fixed-capacity sequences as possible, without splitting more than needed.

Large-item matching: pieces above a third of the capacity go at most two to a
sequence, so the largest left is matched with the largest that fits beside it;
smaller pieces then go, largest first, into the tightest gap that takes them.

Pieces of one length are alike. So the packing is worked out on how many pieces
there are of each length (at most ``capacity`` numbers, whatever the input), gives
layouts with the number of sequences that have them, and every piece finds its
place by its rank among the pieces of its length. Ranks come from counts of small
buckets, so that no task sees all pieces of a common length.

Defined results: null text is the empty text and gives one piece, the end id;
repeated rows are separate documents, equal to each other; null ids are documents like
others; an empty table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .tokens import END_ID, default_path, encoder

ROWS_PER_BUCKET = 1_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids; the first may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = memoryview(ids + end)
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Layouts for counts of each length: (number of sequences, lengths in order of place)."""
    left = {n: k for n, k in counts.items() if k > 0}
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []  # gaps that are open, ascending

    def add(gap: int, number: int, layout: tuple[int, ...]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((number, layout))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        most = bisect_left(large, min(a, capacity - a) + 1) - 1  # the largest partner that fits
        pairs = 0
        if most >= 0:
            b = large[most]
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
        if pairs:
            add(capacity - a - b, pairs, (a, b))
            left[a] -= pairs
            left[b] -= pairs
            if b != a and not left[b]:
                large.remove(b)
        elif most >= 0 and large[most] == a:  # one of its kind is left over
            most -= 1
            if most >= 0:
                add(capacity - a - large[most], 1, (a, large[most]))
                left[large[most]] -= 1
                if not left[large[most]]:
                    large.pop(most)
            else:
                add(capacity - a, 1, (a,))
            left[a] -= 1
        else:
            add(capacity - a, left[a], (a,))
            left[a] = 0
        if not left[a]:
            large.remove(a)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        k = left[n]
        while k:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                if k >= each:
                    add(capacity - each * n, k // each, (n,) * each)
                if k % each:
                    add(capacity - k % each * n, 1, (n,) * (k % each))
                break
            gap = order[at]
            number, layout = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(number, k // each)
            if full:
                add(gap - each * n, full, layout + (n,) * each)
                k -= full * each
                number -= full
            if number and 0 < k < each:
                add(gap - k * n, 1, layout + (n,) * k)
                number, k = number - 1, 0
            if number:
                add(gap, number, layout)
    return [x for at in order for x in gaps[at]]


def slots(layouts: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int]]:
    """Places in rank order: (length, first rank, first sequence, offset)."""
    base, used, out = 0, {}, []
    for number, layout in layouts:
        offset = 0
        for n in layout:
            out.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + number
            offset += n
        base += number
    return out


def best_fit_pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(tokenized_pieces(docs, path or default_path(), capacity, end_id), "pieces")
    # At most as many rows as the capacity.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = slots(pack_counts(counts, capacity))
    by_length: dict[int, list] = {}
    for n, rank, sequence, offset in places:
        by_length.setdefault(n, []).append((rank, sequence, offset))
    # Bounded: at most one row per length, and layouts do not multiply with the input.
    table_ = spark.createDataFrame(list(by_length.items()), "of long, places array<struct<rank:bigint,sequence:bigint,offset:bigint>>").coalesce(1)
    buckets = max(1, -(-max(counts.values(), default=0) // ROWS_PER_BUCKET))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("of").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = bucketed.groupBy(F.col("length").alias("of"), F.col("bucket").alias("b")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        bucketed.withColumn("rank", F.row_number().over(local) - 1)
        .join(firsts, (F.col("length") == F.col("of")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", F.col("rank") + F.col("before")).drop("of", "b")
        .join(F.broadcast(table_), F.col("length") == F.col("of"))
        .withColumn("place", F.element_at(F.filter("places", lambda x: x["rank"] <= F.col("rank")), -1))
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place.sequence") + F.col("rank") - F.col("place.rank")).alias("sequence_id"), F.col("place.offset").alias("offset"))


def op5(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
