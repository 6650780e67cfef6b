"""Periodic runs: stretches of words that repeat with a period at least four times, found by counting matches at every lag.

A word q places after an equal one is a match at lag q. A run of period q is an island
of consecutive matches at that lag, at least max(6 - q, 3 * q) of them, so only lags
that have as many matches in the whole text can have one. Matches are counted exactly
for all lags of a text at once: for a frequent word by the autocorrelation of its
places (fast Fourier transforms, whose counts are rounded to whole numbers; the power
spectra of all frequent words are added and transformed back once), for a rare word by
the differences of its places. ``heavy_from`` says which words are frequent, by what
either way costs.

Lags with enough matches are scanned for islands. An island covers three neighbouring
multiples of its lag, so only these are looked at first; around three that match in a
row all words are. Lags are taken in ascending order, so the first that gives a
stretch has its smallest period, and stretches inside a run whose period divides the
lag are that run again.

A text is one row and stays in one task; its runs and what is left of it come back in
one row. Memory is a small multiple of the text (a transform takes 16 bytes a word), so
texts of tens of megabytes work; tasks take texts in chunks of about ``CHUNK`` bytes.

Defined results: null and empty texts have no words and no runs; null ids, repeated
rows and ties change nothing, as each row is judged by itself; an empty table gives no
rows; columns besides the text come along unchanged, unless they are called n_words,
runs or collapsed, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, restored, small_batches, table, words

#: A run has its period so many times, and so many words.
TIMES = 4
LEAST = 6
#: Texts of about so many bytes are taken at a time, and so many differences are kept before they are counted.
CHUNK = 1 << 22
HELD = 1 << 20


def least_matches(q: np.ndarray) -> np.ndarray:
    """How many matches in a row a run of period q has at least."""
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def heavy_from(n: np.ndarray) -> np.ndarray:
    """From how many places on a word of a text of n words goes by Fourier transform: pairs of places cost the square, a transform n log n."""
    return np.maximum(32, np.sqrt(2.0 * n * np.log2(np.maximum(n, 2)))).astype(np.int64)


def _transform_size(n: int) -> int:
    """The least 2 ** k, 3 * 2 ** k or 5 * 2 ** k from n on."""
    return min(m << max(0, int(np.ceil(np.log2(max(1.0, n / m))))) for m in (1, 3, 5))


def lag_counts(ids: np.ndarray, starts: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Matches of each text at each lag up to a quarter of its length, and where each text's counts begin.

    ``ids``: the words of all texts, as numbers; ``starts``: where texts begin, and the end.
    """
    n = np.diff(starts)
    most = n // TIMES
    bases = np.append(0, np.cumsum(most + 1))
    counts = np.zeros(bases[-1], np.int64)
    if not len(ids):
        return counts, bases
    heavy = heavy_from(n) if heavy is None else heavy
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")  # places of each word of each text, ascending
    key, place_of, text_of = key[order], order, text[order]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(edges, len(key)))
    frequent = sizes > heavy[text_of[edges]]

    # Rare words: the differences between each place and the next one, the one after it, and so on, while they are near enough.
    last = np.repeat(edges + sizes - 1, sizes)
    at = np.flatnonzero(~np.repeat(frequent, sizes) & (np.arange(len(key)) < last))
    held: list[np.ndarray] = []
    n_held, step = 0, 1
    while len(at):
        lag = place_of[at + step] - place_of[at]
        near = lag <= most[text_of[at]]
        at, lag = at[near], lag[near]
        held.append(bases[text_of[at]] + lag)
        n_held += len(at)
        step += 1
        at = at[at + step <= last[at]]
        if n_held > HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n_held = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))

    # Frequent words: one spectrum for each text that has any.
    big = np.flatnonzero(frequent)
    for t in np.unique(text_of[edges[big]]):
        size = _transform_size(int(n[t] + most[t] + 1))
        power = np.zeros(size // 2 + 1)
        for g in big[text_of[edges[big]] == t]:
            row = np.zeros(size)
            row[place_of[edges[g] : edges[g] + sizes[g]] - starts[t]] = 1.0
            spectrum = np.fft.rfft(row)
            power += spectrum.real**2 + spectrum.imag**2
        counts[bases[t] : bases[t + 1]] += np.rint(np.fft.irfft(power, size)[: most[t] + 1]).astype(np.int64)
    return counts, bases


def _islands(match: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of at least ``least`` true values begin, and their lengths."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], match.view(np.int8), [0]))))
    begins, lengths = turns[::2], turns[1::2] - turns[::2]
    return begins[lengths >= least], lengths[lengths >= least]


def _scan(w: np.ndarray, q: int, runs: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of lag q that are not among ``runs``, which have smaller periods and are sorted by start."""
    n, least = len(w), int(least_matches(np.int64(q)))
    hit = w[: n - q : q] == w[q::q]
    begins, lengths = _islands(hit, 3)
    if not len(begins):
        return []
    first, last = begins * q, (begins + lengths - 1) * q
    same = runs[q % runs[:, 2] == 0] if len(runs) else runs
    if len(same):
        # The runs that begin before a stretch: does the longest of them hold it all?
        reach = np.append(-1, np.maximum.accumulate(same[:, 1]))[np.searchsorted(same[:, 0], first, "right")]
        first, last = first[reach <= last + q], last[reach <= last + q]
    found = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        low, high = max(0, a - q + 1), min(b + q, n - q)
        some, size = _islands(w[low:high] == w[low + q : high + q], least)
        found += [(low + s, low + s + m + q, q) for s, m in zip(some.tolist(), size.tolist(), strict=True)]
    return found


def runs_of(ids: np.ndarray, starts: np.ndarray, heavy: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text its runs, as rows of start, end and smallest period, by start and then period."""
    counts, bases = lag_counts(ids, starts, heavy)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(bases))
    lag = np.arange(len(counts)) - bases[text]
    some = np.flatnonzero((lag > 0) & (counts >= least_matches(lag)))
    found = [np.zeros((0, 3), np.int64)] * (len(starts) - 1)
    for t, q in zip(text[some].tolist(), lag[some].tolist(), strict=True):
        w, runs = ids[starts[t] : starts[t + 1]], found[t]
        if q == 1:
            begins, lengths = _islands(w[1:] == w[:-1], LEAST - 1)
            new = [(s, s + m + 1, 1) for s, m in zip(begins.tolist(), lengths.tolist(), strict=True)]
        else:
            known = {(s, e) for s, e, _ in runs.tolist()} if len(runs) else set()
            new = [r for r in _scan(w, q, runs) if r[:2] not in known]
        if new:
            runs = np.concatenate([runs, np.array(new, np.int64)])
            found[t] = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return found


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run has after its first period."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 1], -1)
    return np.cumsum(turns[:n]) > 0


def _found(texts: list[str]) -> tuple[list[int], list[np.ndarray], list[str]]:
    split = [(t or "").encode().split() for t in texts]  # bytes are split at ASCII white space
    starts = np.append(0, np.cumsum([len(w) for w in split])).astype(np.int64)
    flat = pa.array([w for some in split for w in some], pa.large_binary()).dictionary_encode()
    runs = runs_of(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts)
    left = []
    for some, r in zip(split, runs, strict=True):
        if len(r):
            gone = dropped(len(some), r)
            some = [w for w, g in zip(some, gone.tolist(), strict=True) if not g]
        left.append(b" ".join(some).decode())
    return np.diff(starts).tolist(), runs, left


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All columns but the text, with n_words, runs (start, length and period in words; by start, then period) and collapsed, the text with each run cut to its first period and words joined by one space."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "n_words", "runs", "collapsed")]
    rows = docs.select("text", packed(keep).alias("carried"))
    schema = StructType(rows.schema.fields[1:] + StructType.fromDDL("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields)

    def run(batches):
        for whole in batches:
            sizes = np.cumsum([len(t) for t in whole.column(0).fill_null("").to_pylist()])
            cuts = np.flatnonzero(np.diff(sizes // CHUNK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                batch = whole.slice(a, b - a)
                n, runs, left = _found(batch.column(0).to_pylist())
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                parts = [pa.array(x) for x in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])]
                offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), lists, pa.array(left, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*restored(keep, keep), "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; of one id in ten, by its crc32, the words from some place on are repeated. A null id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    placed = chosen.withColumns({"g": F.floor(F.col("h") / 10).cast("bigint"), "n": F.size("w")}).withColumn("a", F.expr("try_mod(g, n)"))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("bigint"))
    # Rows of words first, in a step of their own, as a function of each word would make them again for each.
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(planted(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.less") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
