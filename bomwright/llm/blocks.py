"""Block tables: which fingerprints of a whole table may be within a Hamming radius of each other.

Bits are cut into blocks. Of two fingerprints that differ in at most ``radius`` bits
all but ``radius`` blocks are equal, so a table for each choice of that many blocks
brings them together: a table's key is the fingerprint with the other blocks masked
out. (A permutation that moves the chosen blocks to the front and sorts gives the
same groups.) There are as few blocks as keep groups of unlike fingerprints small.

Fingerprints of a key that very many share are dealt to tasks as pairs of parts, so no
task has more than two parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unlike fingerprints that one key may bring together, on average; and the most tables.
GROUP = 256
MOST_TABLES = 64
#: At most so many keys are dealt as parts.
HOT_KEYS = 20_000


def table_masks(bits: int, radius: int, n: int) -> list[int]:
    """The bits that each table looks at, for n fingerprints."""
    blocks = radius + 1
    while n > GROUP << (bits * (blocks - radius) // blocks) and comb(blocks + 1, radius) <= MOST_TABLES and blocks < bits:
        blocks += 1
    edges = [bits * k // blocks for k in range(blocks + 1)]
    every = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(some) for some in combinations(every, blocks - radius)]


def signed(x: int) -> int:
    """The low 64 bits of a number, as Spark holds them."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def met(distinct: DataFrame, columns: list[str], masks: list[int], part: int, found: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``found`` on whole groups of fingerprints that meet in a table.

    ``columns``: the 64-bit halves of a fingerprint, lowest first. ``found`` gets arrays
    sorted by group: the group's key, the table, the side, and the halves. Side 2 meets
    all of its group, 0 meets 1 only. ``others``: columns that come along after the halves.
    """
    spark = distinct.sparkSession
    keys = F.array(*(F.struct(*(F.col(c).bitwiseAND(F.lit(signed(m >> (64 * h)))).alias(f"v{h}") for h, c in enumerate(columns))) for m in masks))
    values = [f"v{h}" for h in range(len(columns))]
    tables = distinct.select(*columns, *others, F.posexplode(keys).alias("block", "v")).select(*columns, *others, "block", "v.*")
    # One number comes to the driver. Not more than HOT_KEYS keys have more fingerprints than the limit.
    limit = max(part, distinct.count() * len(masks) // HOT_KEYS)
    hot = tables.groupBy("block", *values).count().where(F.col("count") > limit).select(F.col("block").alias("of"), *(F.col(v).alias(f"of_{v}") for v in values), F.ceil(F.col("count") / limit).alias("parts"))
    match = [F.col("block") == F.col("of"), *(F.col(v) == F.col(f"of_{v}") for v in values)]
    own = F.pmod(F.xxhash64(*columns), F.coalesce("parts", F.lit(1).cast("bigint")))
    dealt = (
        tables.join(F.broadcast(hot), match, "left").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1)))
        .select(
            F.xxhash64("block", *values, F.least("own", "other"), F.greatest("own", "other")).alias("key"), "block",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), *columns, *others,
        )
    )

    def run(batches):
        rest = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # its group may go on in the next batch
            rest = [x[last:] for x in now]
            if last:
                yield from found([x[:last] for x in now])
        if rest is not None:
            yield from found(rest)

    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").mapInArrow(run, schema)
