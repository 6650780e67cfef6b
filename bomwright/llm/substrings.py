"""Substring dedup by words: passages of 50 words that an earlier document has are removed.

First pass: a count-min sketch, merged from the sketches of all tasks, overestimates
how many documents have each window of 50 words (see ``sketch``). Second pass: only
windows that it estimates at two or more are grouped exactly, by a 64-bit hash of
their words, to find the least doc_id that has each; a window is removed from every
other document. No repeated window is lost, and windows estimated once (nearly all)
are never shuffled. Two different windows have one hash with odds of about
(number of estimated repeats) ** 2 / 2 ** 65: the hash joins words pairwise and mixes
at every step (``rolling.tree_hash``), so regular texts are no worse than others. It
has no secret, so this does not hold for texts made to collide.

Counts are made by key before anything is shuffled, windows that many documents share
are dealt to several tasks, and rows come back to a document, not to a window, so no
task sees all places of a common passage.

Defined results: null and empty texts have no words; texts of fewer than 50 words
keep them all; ids may be numbers or texts, in their own order; a null id comes after
all others, and documents of equal id never remove from each other; repeated rows
agree; an empty table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, spread_join, table
from .rolling import byte_column, chunks, prefix, tree_hash, word_hash, word_spans
from .sketch import Runs, repeated, text_bytes

LENGTH = 50
BLOCK = 25
CHUNK = 1 << 20
LAST = (1 << 63) - 1


class Words:
    """The words of a run of texts: spans, hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.hashes = word_hash(data, self.starts, self.ends)
        self.sums = prefix(self.hashes)

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The kept words of text k, joined by a space."""
        a, b = self.first[k], self.first[k + 1]
        starts, ends = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            starts, ends = starts[keep], ends[keep]
        raw = self.data.tobytes() if not hasattr(self, "raw") else self.raw
        self.raw = raw
        return b" ".join([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])


def _parts(column: pa.Array):
    data, offsets = byte_column(column)
    for at, end in chunks(offsets, CHUNK):
        yield at, end, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])


def sketch_windows(docs: DataFrame, length: int, block: int):
    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for _, _, words in _parts(batch.column(0)):
            runs = Runs(words.sums, words.first, length, block)
            order = np.lexsort((runs.owner, runs.hash))
            h, o = runs.hash[order], runs.owner[order]
            out.append(h[np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))] if len(h) else h)  # once for each document
        return np.concatenate(out)

    return repeated(docs.select("text"), hashes_of, text_bytes(docs))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, the kept words (kept_text)."""
    spark = docs.sparkSession
    small_batches(spark)
    maybe = spark.sparkContext.broadcast(sketch_windows(docs, length, block))
    id_type = dict(docs.dtypes)["doc_id"]

    def split(batches):
        for batch in batches:
            for at, end, words in _parts(batch.column(1)):
                n_words = np.diff(words.first)
                runs = Runs(words.sums, words.first, length, block)
                hit = maybe.value(runs.hash)
                low, high, owner = runs.low[hit], runs.high[hit], runs.owner[hit]
                hashes = tree_hash(words.hashes, length)
                sizes = high - low + 1
                places = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                keys = hashes[places].view(np.int64)
                edges = np.searchsorted(np.repeat(owner, sizes), np.arange(end - at + 1))
                dirty = np.diff(edges) > 0
                lists = [np.unique(keys[edges[k] : edges[k + 1]]) if dirty[k] else None for k in range(end - at)]
                whole = [None if d else words.joined(k) for k, d in enumerate(dirty.tolist())]
                column = batch.column(1).slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(n_words, pa.int64()),
                     pa.array([None if w is None else hashlib.sha256(w).hexdigest() for w in whole], pa.string()),
                     pa.array([None if w is None or not texts else w.decode() for w in whole], pa.string()),
                     pa.array([t if d else None for t, d in zip(column, dirty.tolist(), strict=True)], pa.string()),
                     pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "kept_sha256", "kept_text", "text", "keys"],
                )

    kept = materialize(docs.select("doc_id", "text").mapInArrow(split, f"doc_id {id_type}, n_words bigint, kept_sha256 string, kept_text string, text string, keys array<bigint>"), "windows")
    # A null id orders after all others. Whole numbers are ranked as such, as rows of numbers take the least room.
    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)) if whole else F.struct(F.col("doc_id").isNull().alias("is_null"), F.col("doc_id").alias("id"))
    suspects = kept.where(F.col("text").isNotNull())
    windows = suspects.select(rank.alias("rank"), F.explode("keys").alias("key"))
    firsts = windows.groupBy("key").agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.count("*").alias("places")).where("least < most")
    firsts = materialize(firsts.select(F.col("key").alias("of"), "least", "places"), "first-windows")
    later = spread_join(windows, firsts, [("key", "of")], "places", F.xxhash64("rank")).where(F.col("rank") > F.col("least"))
    gone = later.groupBy("rank").agg(F.collect_set("key").alias("gone")).withColumnRenamed("rank", "of")
    judged = suspects.drop("keys").withColumn("rank", rank).join(gone, F.col("rank").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "gone")
    out = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"

    def cut(batches):
        for batch in batches:
            lists = batch.column(2)
            for at, end, words in _parts(batch.column(1)):
                hashes = tree_hash(words.hashes, length).view(np.int64)
                rows = []
                for k in range(end - at):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    keep = np.ones(b - a, bool)
                    some = lists[at + k]
                    if some.is_valid and b - a >= length:
                        hit = np.flatnonzero(np.isin(hashes[a : b - length + 1], some.values.to_numpy()))
                        change = np.zeros(b - a + 1, np.int64)
                        np.add.at(change, hit, 1)
                        np.add.at(change, hit + length, -1)
                        keep = np.cumsum(change[:-1]) == 0
                    text = words.joined(k, keep)
                    rows.append((b - a, int((~keep).sum()), hashlib.sha256(text).hexdigest(), text.decode() if texts else None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    clean = kept.where(F.col("text").isNull()).select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", "kept_text")
    result = clean.unionByName(judged.mapInArrow(cut, out))
    return result if texts else result.drop("kept_text")


def op1(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
