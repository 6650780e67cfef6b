"""Substring dedup by bytes: depth-limited radix sort of suffixes.

Two suffixes matter to each other only if they agree through ``length`` (200) bytes.
They are sorted by most-significant-digit passes: a digit is eight bytes, each pass
orders every group by its next digit, and only groups of two or more go on to the
next. What is left after the pass that ends at byte 200 are exactly the repeated
windows; bytes are compared, not hashes (``repeated_starts``).

Before the passes, Spark deals suffixes to tasks so that equal ones meet, and leaves
out what needs no sorting:

1. Each suffix belongs to the anchor of its window, the block of 64 bytes with the
   least hash (see ``sketch``); equal windows have equal anchors. Neighbouring
   suffixes share an anchor, so they travel as a run. A count-min sketch drops runs
   whose anchor is surely unique.
2. Runs that are equal as a whole, by a 128-bit BLAKE2 digest of their bytes, have
   equal suffixes throughout: all are repeated, and one stands for all from here on.
3. A second sketch, of whole windows, drops suffixes that are surely unique.
4. What is left of a run, with its bytes, goes to the task of its anchor, equal ones
   counted first. Anchors with very many different runs are dealt to several tasks,
   suffix by suffix.

Rows come back to a document as ranges of starts, so no task sees all places of a
common passage, and counts are made by key before anything is shuffled.

Defined results: null and empty texts have no bytes; texts shorter than 200 bytes
keep them all; repeated rows are separate documents, so both lose what they share;
ids may be of any type, null or repeated; an empty table gives no rows; other columns,
of any name, come along only with ``kept_bytes``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialize, packed, small_batches, spread_join, table
from .rolling import BYTES, byte_column, chunks, prefix, span_hash
from .sketch import Runs, repeated, text_bytes

LENGTH = 200
BLOCK = 64
CHUNK = 1 << 19
DIGIT = 8
#: An anchor with more different runs than this is dealt to several tasks.
GROUP = 4_096
#: Bytes of runs that one call of the sort takes, or one group.
SORT_BYTES = 1 << 23


def _parts(column: pa.Array):
    data, offsets = byte_column(column)
    for at, end in chunks(offsets, CHUNK):
        part = data[offsets[at] : offsets[end]]
        yield at, end, part, offsets[at : end + 1] - offsets[at], prefix(BYTES[part])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def repeated_starts(data: np.ndarray, starts: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of ``data`` equal another one of their group through ``length`` bytes, or stand for several.

    ``group`` ascends. Each pass sorts groups by the next eight bytes and cuts them
    where these change; a group whose weights sum to 1 is done. The last digit may
    overlap the one before.
    """
    if length < DIGIT:
        raise ValueError(f"suffixes are sorted through at least {DIGIT} bytes")
    digits = np.ndarray((max(0, len(data) - DIGIT + 1),), ">u8", np.ascontiguousarray(data), strides=(1,))
    alive = np.arange(len(starts))
    new = np.append(True, group[1:] != group[:-1])[: len(starts)]
    for at in [*range(0, length - DIGIT + 1, DIGIT), *([length - DIGIT] if length % DIGIT else [])]:
        edges = np.flatnonzero(new)
        sizes = np.diff(np.append(edges, len(alive)))
        heavy = np.add.reduceat(weight[alive], edges) > 1 if len(edges) else np.zeros(0, bool)
        keep = np.repeat(heavy, sizes)
        alive, sizes = alive[keep], sizes[heavy]
        if not len(alive):
            break
        edges = np.cumsum(sizes) - sizes
        digit = digits[starts[alive] + at].astype(np.uint64)
        differ = np.repeat(np.logical_or.reduceat(digit != np.repeat(digit[edges], sizes), edges), sizes)
        some = np.flatnonzero(differ)
        if len(some):
            number = np.repeat(np.arange(len(sizes)), sizes)
            order = some[np.lexsort((digit[some], number[some]))]
            alive[some], digit[some] = alive[order], digit[order]
        new = np.zeros(len(alive), bool)
        new[edges] = True
        new[1:] |= digit[1:] != digit[:-1]
    out = np.zeros(len(starts), bool)
    if len(alive):
        edges = np.flatnonzero(new)
        out[alive[np.repeat(np.add.reduceat(weight[alive], edges) > 1, np.diff(np.append(edges, len(alive))))]] = True
    return out


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true flags."""
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` with each edge moved out to a boundary of UTF-8 characters."""
    if not gone.any() or data.max() < 0x80:
        return gone
    starts = (data & 0xC0) != 0x80
    starts[0] = True
    at = np.flatnonzero(starts)
    return np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(data))))


def _repeats(spans: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated windows of whole groups of spans, which are sorted by task."""
    data, offsets = byte_column(spans["span"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    task, shift, n = (spans[c].to_numpy() for c in ("task", "shift", "n"))
    sizes = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = repeated_starts(data, offsets[row] + place, task[row], n[row], length)
    turn = row[1:] != row[:-1]
    first = np.flatnonzero(hit & np.append(True, ~hit[:-1] | turn)[: len(hit)])
    last = np.flatnonzero(hit & np.append(~hit[1:] | turn, True)[-len(hit) :]) if len(hit) else first
    of = pa.array(row[first])
    low, high = (pa.array((place[x] + shift[row[first]]).astype(np.int32)) for x in (first, last))
    return pa.RecordBatch.from_arrays([*(spans[c].combine_chunks().take(of) for c in ("key", "digest", "places")), low, high], names=["of_key", "of_digest", "places", "low", "high"])


def _sorted_spans(distinct: DataFrame, length: int) -> DataFrame:
    """Repeated windows of spans (key, digest, span, n, places), as ranges within a span: of_key, of_digest, places, low, high."""
    limit = max(GROUP, distinct.count() // HOT_KEYS)
    # At most HOT_KEYS keys have more spans than the limit.
    hot = distinct.groupBy(F.col("key").alias("hot_key")).count().where(F.col("count") > limit).select("hot_key", F.ceil(F.col("count") / limit).alias("parts"))
    sized = distinct.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").drop("hot_key")
    columns = ["task", "key", "digest", "span", "shift", "n", "places"]
    few = sized.where(F.col("parts").isNull()).withColumns({"task": F.col("key"), "shift": F.lit(0)})
    many = sized.where(F.col("parts").isNotNull()).withColumn("shift", F.explode(F.sequence(F.lit(0), F.octet_length("span") - length)))
    many = many.withColumn("span", F.substring("span", F.col("shift") + 1, F.lit(length)))
    many = many.withColumn("task", F.xxhash64("key", F.pmod(F.xxhash64("span"), F.col("parts"))))
    dealt = few.select(*columns).unionByName(many.select(*columns))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SORT_BYTES:
                rows = pa.Table.from_batches(held)
                task = rows["task"].to_numpy()
                whole = int(np.searchsorted(task, task[-1]))  # the last group may go on in the next batch
                if whole:
                    yield _repeats(rows.slice(0, whole), length)
                held = rows.slice(whole).to_batches()
                size = sum(x.nbytes for x in held)
        if size:
            yield _repeats(pa.Table.from_batches(held), length)

    return dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "of_key bigint, of_digest binary, places bigint, low int, high int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, kept_bytes: bool = False, characters: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``kept_bytes``, the bytes (kept).

    With ``kept_bytes`` the other columns of ``docs`` come along in a struct, ``carried``. With ``characters``, kept
    (and no other column) is without the rest of characters that are cut in half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if kept_bytes else []
    docs = docs.select("doc_id", "text", packed(others).alias("carried"))
    carried_type = docs.schema["carried"].dataType.simpleString()
    n_bytes = text_bytes(docs)

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(Runs(sums, offsets, length, block).hash for _, _, _, offsets, sums in _parts(batch.column(0)))])

    maybe = spark.sparkContext.broadcast(repeated(docs.select("text"), hashes_of, n_bytes))
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "kept_sha256", "kept", "name", "text", "runs", "carried"]
    run_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int64()), ("whole", pa.binary())]))

    def split(batches):
        # Rows are named by where they are written; the names last, as they are read from what was written.
        named = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, end, data, offsets, sums in _parts(batch.column(1)):
                runs = Runs(sums, offsets, length, block)
                hit = maybe.value(runs.hash)
                low, high, owner = runs.low[hit], runs.high[hit], runs.owner[hit]
                base = offsets[owner]
                edges = np.searchsorted(owner, np.arange(end - at + 1))
                dirty = np.diff(edges) > 0
                raw, place = data.tobytes(), offsets.tolist()
                texts = [raw[place[k] : place[k + 1]] for k in range(end - at)]
                whole = [digest(raw[i:j]) for i, j in zip(low.tolist(), (high + length).tolist(), strict=True)]
                items = pa.StructArray.from_arrays(
                    [pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32)), pa.array(runs.hash[hit].view(np.int64)), pa.array(whole, pa.binary())],
                    fields=list(run_type.value_type),
                )
                flags = dirty.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(np.diff(offsets)), pa.array([None if d else hashlib.sha256(t).hexdigest() for t, d in zip(texts, flags, strict=True)], pa.string()),
                     pa.array([t if kept_bytes and not d else None for t, d in zip(texts, flags, strict=True)], pa.binary()),
                     pa.array([named + k if d else None for k, d in enumerate(flags)], pa.int64()),
                     pa.array([t if d else None for t, d in zip(texts, flags, strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), items), batch.column(2).slice(at, end - at)],
                    names=names,
                )
                named += end - at

    runs_ddl = "array<struct<low:int,high:int,anchor:bigint,whole:binary>>"
    parted = materialize(docs.mapInArrow(split, f"doc_id {id_type}, n_bytes bigint, kept_sha256 string, kept binary, name bigint, text binary, runs {runs_ddl}, carried {carried_type}"), "suffix-runs")
    suspects = parted.where(F.col("name").isNotNull())

    # Runs by anchor and by all that they span; equal ones are repeated as a whole.
    runs = suspects.select("name", F.explode("runs").alias("r")).select("name", "r.*")
    variants = runs.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("name", "low", "high")).alias("one"))
    variants = materialize(variants, "suffix-variants")
    ties = materialize(variants.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("variants"), F.sum("n").alias("places")).where("places > 1 AND variants > 1").drop("places"), "suffix-ties")
    same = variants.where("n > 1").select(F.col("anchor").alias("a"), F.col("whole").alias("w"), "n")
    whole_runs = spread_join(runs, same, [("anchor", "a"), ("whole", "w")], "n", F.xxhash64("name", "low")).select("name", "low", "high")

    # One run stands for all that equal it. The second sketch is of windows through the full depth.
    asked = spread_join(variants, ties, [("anchor", "a")], "variants", F.xxhash64("whole")).select("one.*", "anchor", "n")
    asked = asked.groupBy("name").agg(F.collect_list(F.struct("low", "high", "n", "anchor")).alias("asked")).withColumnRenamed("name", "of")
    texts = materialize(suspects.select("name", "text").join(asked, F.col("name") == F.col("of")).select("name", "text", "asked"), "suffix-asked")

    def in_full(batch: pa.RecordBatch):
        data, offsets = byte_column(batch.column(1).cast(pa.large_binary()).view(pa.large_string()))
        for k in range(batch.num_rows):
            some = batch.column(2)[k].values
            low, high, n, anchor = (some.field(j).to_numpy().astype(np.int64) for j in range(4))
            sizes = high - low + 1
            text = data[offsets[k] : offsets[k + 1]]
            sums = prefix(BYTES[text])
            starts = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield batch.column(0)[k].as_py(), text, (low, high, np.minimum(n, 2), anchor), span_hash(sums, starts, starts + length)

    def windows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(np.repeat(keys, np.repeat(n, high - low + 1)) for _, _, (low, high, n, _), keys in in_full(batch))])

    deep = spark.sparkContext.broadcast(repeated(texts, windows_of, n_bytes))

    def suffixes(batches):
        for batch in batches:
            for name, text, (low, high, n, anchor), keys in in_full(batch):
                hit, raw, rows, at = deep.value(keys), text.tobytes(), [], 0
                for i, j, count, key in zip(low.tolist(), high.tolist(), n.tolist(), anchor.tolist(), strict=True):
                    size = j - i + 1
                    if hit[at : at + size].any():
                        for a, b in zip(*map(np.ndarray.tolist, ranges(hit[at : at + size])), strict=True):
                            rows.append((key, raw[i + a : i + b + length], name, i + a, count))
                    at += size
                if rows:
                    key, span, of, start, count = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array(span, pa.binary()), pa.array(map(digest, span), pa.binary()), pa.array(of, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int64())],
                        names=["key", "span", "digest", "name", "start", "n"],
                    )

    pool = materialize(texts.mapInArrow(suffixes, "key bigint, span binary, digest binary, name bigint, start int, n bigint"), "suffixes")
    distinct = materialize(pool.groupBy("key", "digest", "span").agg(F.sum("n").alias("n"), F.count("*").alias("places")), "suffix-spans")
    repeats = materialize(_sorted_spans(distinct, length), "suffix-repeats")
    found = spread_join(pool.where("n = 1").select("key", "digest", "name", "start"), repeats, [("key", "of_key"), ("digest", "of_digest")], "places", F.xxhash64("name", "start"))
    single = found.select("name", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    found = whole_runs.unionByName(single).groupBy("name").agg(F.collect_list(F.shiftleft(F.col("low").cast("bigint"), 32).bitwiseOR(F.col("high").cast("bigint"))).alias("found")).withColumnRenamed("name", "of")
    judged = suspects.select("doc_id", "name", "text", "carried").join(found, F.col("name") == F.col("of"), "left").select("doc_id", "text", "found", "carried")
    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "carried"]

    def cut(batches):
        for batch in batches:
            rows = []
            for text, some in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                gone = np.zeros(len(data), bool)
                if some.is_valid:
                    change = np.zeros(len(data) + 1, np.int32)
                    ranges = some.values.to_numpy()
                    np.add.at(change, ranges >> 32, 1)
                    np.add.at(change, (ranges & 0xFFFFFFFF) + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                rest = data[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                kept = data[~whole_characters(data, gone)].tobytes() if characters else rest
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), kept if kept_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)), batch.column(3)], names=out)

    zero = F.lit(0).cast("bigint")
    clean = parted.where(F.col("name").isNull()).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", "kept", "carried")
    result = clean.unionByName(judged.mapInArrow(cut, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, carried {carried_type}"))
    return result if kept_bytes else result.drop("kept", "carried")


def op7(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
