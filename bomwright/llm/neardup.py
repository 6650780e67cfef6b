"""SimHash near-duplicates: links between fingerprints at Hamming distance 3 or less, and their components.

Shingles of three words vote on 64 bits. Fingerprints meet in block tables (see
``blocks``): four tables of 16 bits, and more tables of wider blocks the more
fingerprints there are, so that unlike ones rarely meet.

Distances are counted bit-sliced: bit k of 64 fingerprints is one machine word (a
bit plane), so that one exclusive-or compares 64 of them with a query, and a
carry-save counter of three words adds up, for all 64, whether they differ by 0, 1,
2, 3 or more. Blocks whose lanes have all passed the radius are abandoned; the
planes that are left are not read for them.

A block value that very many fingerprints share is dealt to several tasks as pairs
of parts. Tasks give a forest of links, not all pairs, and components are found by
large-star and small-star rounds, until nothing changes. Nodes with very many links,
and fingerprints with very many copies, are dealt to several tasks where rows are
joined (``common.spread_join``).

``grouped(similar=True)`` is the wider search of the pipeline: 128 bits of five-word
shingles, and links at up to 34 differing bits. Texts of a similarity of 0.8 have 19 on
average and never more than 30 in the test tables; copies with a word in twenty
changed, whose similarity is between 0.5 and 0.7, have 24 to 34. At 34 bits a few pairs in
a hundred million are of unlike texts, so a link also needs sketches of the shingles that
agree in half of their 64 bytes, as texts do that share half of their shingles (of both
together). So wide a radius is beyond block
tables that lose nothing: each table looks at randomly drawn bits, and there are as many
as bring together 95 of 100 pairs that differ in 30 bits (999 of 1,000 at 19). With
``exact=True`` all fingerprints meet all in one table, dealt to tasks as pairs of parts:
no pair is missed, at a cost of the square of their number. The planes, counters and
abandoned blocks are the same.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; texts of fewer than three words are one shingle; repeated rows are
copies; ids may be of any type that has an order; null ids are in components without
being named unless a component has no other id; an empty table gives no rows; other
columns, of any name, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import met, table_masks
from .common import materialize, small_batches, spread_join, table
from .fingerprints import SKETCH, fingerprint_texts, hex_of
from .rolling import bit_counts, majority

SEED = 42
SHINGLE = 3
RADIUS = 3
PART = 4096
#: Similar texts: bits of a fingerprint, in how many of them texts may differ, and how many bytes of their sketches agree.
BITS = 128
SIMILAR_RADIUS = 34
AGREE = 32
#: Of pairs that differ in so many bits this share meets in a table at least once; unlike fingerprints that meet in one, on average.
SIMILAR_BITS = 30
FOUND = 0.95
SIMILAR_GROUP = 1024
SKETCHES = tuple(f"s{k}" for k in range(SKETCH // 8))
#: Words of planes compared at a time.
ITEMS = 1 << 15
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().translate(LOWER).split()
        if not words:
            continue
        rows = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, rows, repeat(SEED)), np.uint64)
        hashes.append(h)
        sizes[k] = len(h)
    ends = np.cumsum(sizes)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return majority(bit_counts(flat, ends - sizes, ends), sizes)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, and text_hash if ``docs`` has one."""
    id_type = dict(docs.dtypes)["doc_id"]
    hashed = ["text_hash"] if "text_hash" in docs.columns else []

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fp = text_fingerprints([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *hashed])

    return docs.select("doc_id", "text", *hashed).mapInArrow(run, f"doc_id {id_type}, fp bigint" + ", text_hash bigint" * len(hashed))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of all values, 64 to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differ, n_words: int, radius: int = RADIUS, planes: int = 64, step: int = 8) -> np.ndarray:
    """Which lanes differ in at most ``radius`` planes, as words.

    ``differ(planes, words)`` gives, for a slice of planes and an index of words, the
    bits that differ. ``counter`` is the carry-save counter, lowest digit first; it
    starts so high that it overflows into ``over`` just beyond the radius. A word all of
    whose lanes are over is not looked at again.
    """
    alive = np.arange(n_words)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    counter = [np.full(n_words, full if start >> k & 1 else 0, np.uint64) for k in range(digits)]
    over = np.zeros(n_words, np.uint64)
    for at in range(0, planes, step):
        bits = differ(slice(at, at + step), alive)
        now, past = [digit[alive] for digit in counter], over[alive]
        for carry in bits:
            for k in range(digits):
                now[k], carry = now[k] ^ carry, now[k] & carry
            past |= carry
        for digit, value in zip(counter, now, strict=True):
            digit[alive] = value
        over[alive] = past
        alive = alive[past != full]
        if not len(alive):
            break
    return ~over


def lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def near_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs (left[k], right[k]) are within the radius."""
    planes = planes_of(left ^ right)
    close = within(lambda p, w: planes[p][:, w], planes.shape[1])
    found = lanes(close)
    return found[found < len(left)]


def near_all(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs of two lists, as places in them, for 64 queries of b at a time against the planes of a."""
    planes = planes_of(a)
    width = planes.shape[1]
    for at in range(0, len(b), 64):
        some = b[at : at + 64]
        # For each query and plane: all ones where the query's bit is set.
        flip = np.where((some[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        query = np.repeat(np.arange(len(some)), width)
        word = np.tile(np.arange(width), len(some))
        close = within(lambda p, w: planes[p][:, word[w]] ^ flip[query[w], p].T, len(query))
        found = lanes(close)
        at_word, lane = found // 64, found % 64
        place = word[at_word] * 64 + lane
        keep = place < len(a)
        yield place[keep], query[at_word][keep] + at


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, the least place in each place's component, with the links (i, j) added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _run_links(keys: np.ndarray, values: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among values of equal key; sides: 2 meets all of its key, 0 meets 1 only. Keys are sorted."""
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    out = []
    small = edges[(sizes > 1) & (sizes <= 64)]
    small_size = sizes[(sizes > 1) & (sizes <= 64)]
    for size in np.unique(small_size):
        i, j = np.triu_indices(size, 1)
        begins = small[small_size == size]
        for at in range(0, len(begins), max(1, 1_000_000 // len(i))):
            some = begins[at : at + max(1, 1_000_000 // len(i))]
            left, right = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            keep = (sides[left] == 2) | (sides[left] != sides[right])
            left, right = left[keep], right[keep]
            near = near_pairs(values[left], values[right])
            out.append((left[near], right[near]))
    for at, size in zip(edges[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        side, root = sides[at : at + size], np.arange(size)
        zero, one = (np.flatnonzero(side == k) for k in (0, 1)) if (side != 2).any() else (root, root)
        if len(zero) and len(one):
            for i, j in near_all(values[at + zero], values[at + one]):
                root = forest(root, zero[i], one[j])
        member = np.flatnonzero(root != np.arange(size))
        out.append((root[member] + at, member + at))
    if not out:
        return values[:0], values[:0]
    return values[np.concatenate([a for a, _ in out])], values[np.concatenate([b for _, b in out])]


def links(distinct: DataFrame) -> DataFrame:
    """Links a, b between different fingerprints (column fp) within the radius; they connect all that are near."""

    def found(columns):
        keys, _, side, fp = columns
        a, b = _run_links(keys, fp.view(np.uint64), side)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met(distinct, ["fp"], table_masks(64, RADIUS, distinct.count()), PART, found, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that has a link a, b.

    Large-star and small-star rounds, each written to the shared folder, until
    nothing changes.
    """

    def stars(pairs: DataFrame, both: bool) -> DataFrame:
        down = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        seen = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
        least = materialize(seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree")).withColumnRenamed("u", "w"), "stars")
        joined = spread_join(seen, least, [("u", "w")], "degree", F.xxhash64("v"))
        if both:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).where("a <> b")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, after = None, state(now)
    while after[0] and after != before:
        now = materialize(stars(stars(now, True), False).distinct(), "edges")
        before, after = after, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def sampled_masks(n: int) -> list[int]:
    """The bits that each of the tables for similar texts looks at, for n fingerprints: so many that unlike ones rarely meet, and tables enough for ``FOUND``."""
    size = max(8, math.ceil(math.log2(max(1, n / SIMILAR_GROUP))))
    met_once = (1 - SIMILAR_BITS / BITS) ** size
    draw = np.random.default_rng(11)
    return [sum(1 << int(b) for b in draw.choice(BITS, size, replace=False)) for _ in range(math.ceil(math.log(1 - FOUND) / math.log(1 - met_once)))]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes sketches agree, row by row."""
    return ((a ^ b).view(np.uint8).reshape(len(a), a.shape[1] * 8) == 0).sum(1)


def _similar_links(keys: np.ndarray, sides: np.ndarray, halves: list[np.ndarray], sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, among fingerprints of equal key within the radius for similar texts; sides as in ``_run_links``. Keys are sorted.

    Each group's fingerprints fill whole words of the planes, and each of its queries is
    compared with those of its words that hold fingerprints before it.
    """
    group = np.append(0, np.cumsum(keys[1:] != keys[:-1])) if len(keys) else keys
    n_groups = int(group[-1]) + 1 if len(keys) else 0
    shared = np.bincount(group, minlength=n_groups)[group] > 1
    stored, asked = np.flatnonzero(shared & (sides != 1)), np.flatnonzero(shared & (sides != 0))
    n_stored = np.bincount(group[stored], minlength=n_groups)
    n_words = -(-n_stored // 64)
    first_word, first_stored = np.cumsum(n_words) - n_words, np.cumsum(n_stored) - n_stored
    rank = np.arange(len(stored)) - first_stored[group[stored]]
    row_at = np.full(64 * int(n_words.sum()), -1)
    row_at[64 * first_word[group[stored]] + rank] = stored
    planes = np.concatenate([planes_of(np.where(row_at < 0, np.uint64(0), half[row_at])) for half in halves])
    rank_of = np.zeros(len(keys), np.int64)
    rank_of[stored] = rank
    compared = np.where(sides[asked] == 2, rank_of[asked] // 64 + 1, n_words[group[asked]])
    ends = np.cumsum(compared)
    root = np.arange(len(keys))
    for at in range(0, int(ends[-1]) if len(ends) else 0, ITEMS):
        item = np.arange(at, min(at + ITEMS, int(ends[-1])))
        which = np.searchsorted(ends, item, "right")
        query = asked[which]
        word = first_word[group[query]] + item - (ends - compared)[which]
        values = [half[query] for half in halves]

        def differ(p: slice, w: np.ndarray, values=values, word=word) -> np.ndarray:
            own = [-((values[k // 64][w] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(p.start, p.stop)]
            return planes[p][:, word[w]] ^ np.stack(own)

        found = lanes(within(differ, len(item), SIMILAR_RADIUS, BITS))
        a, b = row_at[word[found // 64] * 64 + found % 64], query[found // 64]
        keep = (a >= 0) & ((sides[b] == 1) | (a < b))
        a, b = a[keep], b[keep]
        if sketches is not None:
            near = alike(sketches[a], sketches[b]) >= AGREE
            a, b = a[near], b[near]
        root = forest(root, a, b)
    member = np.flatnonzero(root != np.arange(len(keys)))
    return root[member], member


def similar_links(distinct: DataFrame, exact: bool = False) -> DataFrame:
    """Links a, b between different 128-bit fingerprints (column fp, 32 hex digits) of similar texts, by sketches too where there are any (columns of ``SKETCHES``)."""
    others = SKETCHES if set(SKETCHES) <= set(distinct.columns) else ()
    half = lambda k: F.conv(F.substring("fp", 16 * k + 1, 16), 16, -10).cast("bigint")
    halves = distinct.select(half(0).alias("low"), half(1).alias("high"), *others)

    def found(columns):
        keys, _, side, low, high, *sketch = columns
        values = np.stack([low.view(np.uint64), high.view(np.uint64)], 1)
        a, b = _similar_links(keys, side, [values[:, 0].copy(), values[:, 1].copy()], np.stack(sketch, 1) if sketch else None)
        yield pa.RecordBatch.from_arrays([pa.array(hex_of(values[x]), pa.string()) for x in (a, b)], names=["a", "b"])

    return met(halves, ["low", "high"], [0] if exact else sampled_masks(distinct.count()), PART, found, "a string, b string", others)


def similar_fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the 128-bit fingerprint of five-word shingles as 32 hex digits, their sketch (``SKETCHES``), and text_hash if ``docs`` has one."""
    id_type = dict(docs.dtypes)["doc_id"]
    hashed = ["text_hash"] if "text_hash" in docs.columns else []

    def run(batches):
        for batch in batches:
            sketches: list[np.ndarray] = []
            fp = hex_of(fingerprint_texts(batch.column(1), alike=True, sketches=sketches))
            sketch = np.concatenate([*sketches, np.zeros((0, len(SKETCHES)), np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.string()), *(pa.array(c) for c in sketch.T), *batch.columns[2:]], names=["doc_id", "fp", *SKETCHES, *hashed])

    return docs.select("doc_id", "text", *hashed).mapInArrow(run, f"doc_id {id_type}, fp string, " + ", ".join(f"{c} bigint" for c in SKETCHES) + ", text_hash bigint" * len(hashed))


def grouped(docs: DataFrame, similar: bool = False, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, fp, text_hash if ``docs`` has one, root (names its group) and component_id (the least doc_id that links reach).

    ``similar``: by the wider links of texts that have most of their five-word shingles in
    common; ``exact``: by all of these, however long it takes.
    """
    small_batches(docs.sparkSession)
    prints = materialize(similar_fingerprinted(docs) if similar else fingerprinted(docs), "simhash")
    sketch = [F.min(F.struct(*SKETCHES)).alias("sketch")] if similar else []
    copies = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *sketch), "simhash-distinct")
    prints = prints.drop(*SKETCHES)
    rooted = components(similar_links(copies.select("fp", "sketch.*"), exact) if similar else links(copies.select("fp")))
    linked = materialize(copies.join(rooted, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), "least", "copies", F.coalesce("root", "fp").alias("root")), "simhash-linked")
    named = materialize(linked.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "simhash-groups")
    of_print = materialize(spread_join(linked, named, [("root", "name")], "members", F.xxhash64("of")).select("of", "copies", "root", "component_id"), "simhash-named")
    return spread_join(prints, of_print, [("fp", "of")], "copies", F.xxhash64("doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id that links reach)."""
    return grouped(docs.select("doc_id", "text")).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
