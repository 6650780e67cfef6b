"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

Terms are shingles of five words, each weighted by how often it occurs (texts of
fewer words are one shingle). A term's 128-bit hash votes on each bit with its
weight, and the fingerprint has the bits that win over half of the votes. The share
of differing bits grows with the angle between the term vectors; ``likeness`` turns
it back into their cosine, 0 where they have nothing in common.

``neighbours`` finds, for every fingerprint, all others within a Hamming radius by
permuted block tables (see ``blocks``). It counts them where they meet and keeps the
least distance, so that pairs are not written; a pair that meets in several tables
counts in the first.

Defined results: null and empty texts have fingerprint zero, and likeness 1 to each
other; equal texts have equal fingerprints; repeated rows are documents that follow
each other; ids may be of any type that has an order, null ones come first; an empty
table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import met, table_masks
from .common import materialize, small_batches, spread_join, table
from .rolling import BYTES, bit_counts, byte_column, chunks, majority, mix, prefix, span_hash, word_spans

SHINGLE = 5
#: Bytes of a sketch, and the mixings.
SKETCH = 64
ODD = np.random.default_rng(17).integers(1, 1 << 62, SKETCH)
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RADIUS = 3
#: More fingerprints with one block than this are dealt to several tasks.
PART = 4_096


def least_bytes(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A sketch of each set of hashes, ``SKETCH`` bytes in 64-bit words: a byte of the least of all hashes under each of as many mixings. Two sets agree in about the share of bytes that they have of both together."""
    out = np.zeros((len(begin), SKETCH), np.uint8)
    full = np.flatnonzero(size)
    for k in range(SKETCH if len(full) else 0):
        turned = (h ^ (h >> np.uint64(29))) * np.uint64(2 * int(ODD[k]) + 1)
        out[full, k] = mix(np.minimum.reduceat(turned ^ (turned >> np.uint64(32)), begin[full])) >> np.uint64(56)
    return out.view("<u8")


def fingerprint_texts(texts: pa.Array, shingle: int = SHINGLE, alike: bool = False, sketches: list[np.ndarray] | None = None) -> np.ndarray:
    """Two 64-bit halves of each text's fingerprint; to a list given as ``sketches`` those of all texts' shingles are added.

    ``alike``: A-Z count as a-z, every different shingle votes once, and where votes are
    even a bit of the sum of all hashes decides, so that bits of short texts too are set in
    half of all texts.
    """
    data, offsets = byte_column(texts)
    out = np.zeros((len(texts), 2), np.uint64)
    for at, end in chunks(offsets, CHUNK):
        part, local = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        if alike:
            part = LOWER[part]
        starts, ends, first = word_spans(part, local)
        sums = prefix(span_hash(prefix(BYTES[part]), starts, ends))
        n_words = np.diff(first)
        # The places where a shingle starts: all but a text's last four words, and its first if it has fewer.
        size = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
        begin = np.cumsum(size) - size
        places = np.repeat(first[:-1] - begin, size) + np.arange(size.sum())
        stops = np.minimum(places + shingle, np.repeat(first[1:], size))
        h = span_hash(sums, places, stops)
        if alike:
            text = np.repeat(np.arange(end - at), size)
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
            h, size = h[new], np.bincount(text[new], minlength=end - at)
            begin = np.cumsum(size) - size
        if sketches is not None:
            sketches.append(least_bytes(h, begin, size))
        for half in (0, 1):
            counts = bit_counts(h, begin, begin + size)
            out[at:end, half] = majority(counts, size)
            if alike:
                sums = np.append(np.uint64(0), np.cumsum(h))
                even = np.packbits(2 * counts == size[:, None], axis=1, bitorder="little").view("<u8").ravel()
                out[at:end, half] |= even & mix(sums[begin + size] - sums[begin])
            h = mix(h + np.uint64(0x632BE59BD9B4E019))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the term vectors, as far as two fingerprints show it: 0 to 1."""
    apart = np.bitwise_count(a ^ b).sum(-1) / 128
    near = np.maximum(0.0, np.cos(np.pi * apart))
    return np.where(apart >= 0.5, 0.0, near)


def hex_of(fingerprints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in fingerprints.tolist()]


def edit(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much, or all, of the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_FIELDS = [("doc_id", None), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _rows(ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    changed = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    edited = fingerprint_texts(pa.array(changed, pa.large_string()))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(hex_of(own)), pa.array(hex_of(edited)), pa.array(likeness(own, edited)), pa.array(likeness(own, after))]


def fingerprints_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    Documents are sorted by id in range partitions. A task has every next document
    but its last one's; it leaves its first and last document aside, and those two
    rows of each partition are joined up afterwards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())
    id_type = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        part, first, last = TaskContext.get().partitionId(), None, None

        def out(columns, ends=None):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), ends or pa.nulls(n, pa.string()), pa.nulls(n, pa.string()) if ends is None else first_text], names=[n for n, _ in _FIELDS] + ["part", "head", "tail"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                own = fingerprint_texts(batch.column(1))
                if first is None:
                    first = texts[0]
                if last is not None:
                    ids, texts, own = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], own])
                if len(texts) > 1:
                    yield out(_rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]))
                last = (ids[-1:], texts[-1], own[-1:])
        if last is not None:
            nothing = [pa.nulls(1, t) for _, t in _FIELDS[1:]]
            first_text = pa.array([last[1]])
            yield out([last[0], *nothing], pa.array([first]))

    kept = materialize(ordered.mapInArrow(run, f"{done}, part int, head string, tail string"), "fingerprints")
    # One row per partition that has any: its last document, and the text of its first one. Their numbers come to the driver.
    ends = kept.where(F.col("head").isNotNull())
    numbers = sorted(r["part"] for r in ends.select("part").collect())
    after = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "of int, next_part int")
    heads = ends.select(F.col("part").alias("head_part"), F.col("head").alias("following"))
    lasts = ends.join(F.broadcast(after), F.col("part") == F.col("of"))
    joined = lasts.join(heads, F.col("next_part") == F.col("head_part")).select("doc_id", F.col("tail").alias("text"), "following")

    def finish(batches):
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(_rows(batch.column(0), texts, following, fingerprint_texts(batch.column(1)), fingerprint_texts(batch.column(2))), names=[n for n, _ in _FIELDS])

    return kept.where(F.col("head").isNull()).drop("part", "head", "tail").unionByName(joined.mapInArrow(finish, done))


def _near_counts(columns: list[np.ndarray], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Counts of near fingerprints of groups that meet in a table, each pair in the first table in which it meets."""
    keys, table_, side, low, high = columns
    low, high = low.view(np.uint64), high.view(np.uint64)
    halves = [(np.uint64(m & (1 << 64) - 1), np.uint64(m >> 64)) for m in masks]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    count, least = np.zeros(len(keys), np.int64), np.full(len(keys), 129)
    for at, size in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        mine = np.arange(at, at + size)
        left, right = (mine[side[mine] == k] for k in (0, 1)) if side[at] != 2 else (mine, mine)
        for some in np.array_split(right, -(-len(right) * max(1, len(left)) // 1_000_000)) if len(left) and len(right) else ():
            a, b = low[left, None] ^ low[some], high[left, None] ^ high[some]
            apart = np.bitwise_count(a).astype(np.int16) + np.bitwise_count(b)
            i, j = np.nonzero((apart <= radius) & (left[:, None] != some))
            first = np.ones(len(i), bool)
            for m, n in halves[: int(table_[at])]:
                first &= ((a[i, j] & m) | (b[i, j] & n)) != 0
            i, j = i[first], j[first]
            away = apart[i, j]
            np.add.at(count, some[j], 1)
            np.minimum.at(least, some[j], away)
            if side[at] != 2:
                np.add.at(count, left[i], 1)
                np.minimum.at(least, left[i], away)
    near = count > 0
    yield pa.RecordBatch.from_arrays([pa.array(low[near].view(np.int64)), pa.array(high[near].view(np.int64)), pa.array(count[near]), pa.array(least[near].astype(np.int32))], names=["low", "high", "n_near", "nearest"])


def neighbours(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of every different fingerprint (column ``fingerprint``, 32 hex digits; null: none) how many others are within ``radius`` bits.

    Columns: fingerprint, copies (rows that have it), n_near, nearest (bits; null if none).
    """
    half = lambda k: F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("bigint")
    known = fingerprints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("copies"))
    distinct = materialize(known.select("fingerprint", "copies", half(0).alias("low"), half(1).alias("high")), "fingerprints-distinct")
    masks = table_masks(128, radius, distinct.count())
    counts = met(distinct.select("low", "high"), ["low", "high"], masks, PART, lambda columns: _near_counts(columns, masks, radius), "low bigint, high bigint, n_near bigint, nearest int")
    summed = counts.groupBy(F.col("low").alias("l"), F.col("high").alias("h")).agg(F.sum("n_near").alias("n_near"), F.min("nearest").alias("nearest"))
    joined = distinct.join(summed, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")), "left")
    return joined.select("fingerprint", "copies", F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


def with_neighbours(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``fingerprints_with_edits`` with n_near and nearest of their fingerprint."""
    near = materialize(neighbours(rows, radius).withColumnRenamed("fingerprint", "of"), "fingerprints-near")
    return spread_join(rows, near, [("fingerprint", "of")], "copies", F.xxhash64("doc_id", "edited_sha256"))


def op4(spark, sf_dir: str) -> DataFrame:
    rows = materialize(fingerprints_with_edits(table(spark, sf_dir, "documents")), "fingerprints-all")
    return with_neighbours(rows)
