"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a context tree of bytes is counted: for each context of up to
``ORDER`` bytes, which byte follows how often. A byte's probability is that of the
longest known context; with the context's escape probability (method C: distinct
followers / (followers + distinct)) it falls to the next shorter one, whose
followers leave out those already excluded; below the empty context all byte
values are alike. A text's code length is the exact sum under these frozen
statistics, and the language with the shortest code is predicted.

As the statistics are frozen, the code length of a byte depends on the bytes before
it only, so the trees are unrolled into one table of code lengths by context and
byte. Scoring a text is two look-ups a byte, for all languages at once.

Statistics come from a bounded sample: about ``SAMPLE`` documents of each language,
picked by a hash of the id, of those whose crc32(doc_id) mod 4 is not 2.

The table is sent to all tasks. Contexts of three bytes have a row of their own, the most
frequent first, while rows have room in ``TABLE_BYTES``. All others are kept as they are
counted, the bytes seen after them and one escape for each language, and scored from
these: the same code lengths, by a look-up more. These, like all counts, are bounded by the
sample. (Contexts of two bytes always have rows: at most 68 MB for each language, about
1 MB with a hundred different bytes.)

Defined results: null text and text without a letter are ``und`` with score 0; of
languages with equal code lengths the first by name is taken; a NUL byte is read as
the byte 1; documents without language or id are never learned from, but predicted;
repeated rows agree; with nothing to learn from all is ``und``; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .rolling import byte_column, chunks

ORDER = 3
#: Documents of each language that statistics come from, about; and the most characters all of them may have.
SAMPLE = 1_500
SAMPLE_CHARS = 40_000_000
#: Rows for contexts of three bytes are made while they have room in this; it changes the time, not the code lengths.
TABLE_BYTES = 256 << 20
UNKNOWN = "und"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams_of(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its document, as one 32-bit number; before a document there are zeros."""
    padded = np.concatenate([np.zeros(3, np.uint32), np.maximum(text, 1).astype(np.uint32)])
    at = [padded[3 - k : len(padded) - k] for k in range(4)]
    for k in (1, 2, 3):
        at[k] = at[k].copy()
        for j in range(k):
            at[k][starts[starts + j < len(text)] + j] = 0
    return at[0] | at[1] << np.uint32(8) | at[2] << np.uint32(16) | at[3] << np.uint32(24)


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each byte follows each context of three: lang, gram, n."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                part = batch.column(0).filter(pa.array([x == lang for x in langs]))
                text, offsets = byte_column(part)
                if len(text):
                    grams, n = np.unique(grams_of(text, offsets[:-1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """About ``per_language`` documents of each language, fewer if they are long; the same ones in every run."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # One row per language comes to the driver.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    share = {r["lang"]: min(1.0, per_language / r["n"], chars / len(sizes) / max(1, r["chars"])) for r in sizes}
    if not share:
        return known.limit(0)
    odds = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.try_element_at(odds, F.col("lang")) * (1 << 30))


class Statistics:
    """Code lengths, in bits, by context and byte for every language."""

    def __init__(self, langs: list[str], classes: np.ndarray, n_classes: int, states: np.ndarray, by_state: np.ndarray, rare: np.ndarray, sparse: list[tuple[np.ndarray, ...]]):
        self.langs, self.classes, self.n_classes, self.states, self.by_state, self.rare, self.sparse = langs, classes, n_classes, states, by_state, rare, sparse

    def code_lengths(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(text):
            return out
        c = self.classes[np.maximum(text, 1)].astype(np.int32)
        padded = np.concatenate([np.zeros(3, np.int32), c])
        n, starts = len(c), offsets[:-1]
        a = self.n_classes
        context = np.zeros(n, np.int32)
        for k in (3, 2, 1):
            before = padded[3 - k : 3 - k + n].copy()
            for j in range(k):
                before[starts[starts + j < n] + j] = 0
            context = context * a + before
        rows = self.by_state[self.states[context] * a + c]
        at = np.flatnonzero(self.rare[context]) if len(self.rare) else ()
        if len(at):
            # These rows are those of the last two bytes, which is what an escape leads to.
            ctx = context[at].astype(np.int64)
            gram = ctx * a + c[at]
            for j, (grams, bits, contexts, escapes) in enumerate(self.sparse):
                if not len(grams):
                    continue
                seen, k = _among(grams, gram)
                known, m = _among(contexts, ctx)
                fallen = np.where(known, np.minimum(rows[at, j] + escapes[m], LONGEST), rows[at, j])
                rows[at, j] = np.where(seen, bits[k], fallen)
        full = offsets[1:] > starts
        out[full] = np.add.reduceat(rows, starts[full], axis=0, dtype=np.float64)
        return out


#: The longest code of a byte, in bits.
LONGEST = np.float32(-np.log2(1e-9))


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among sorted ``keys``, of which there are some, and where."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], table_bytes: int = TABLE_BYTES) -> Statistics:
    """Unrolls each language's context tree. counts: per language the grams (four bytes each) and how often they occur."""
    langs = sorted(counts)
    seen = np.zeros(256, bool)
    for grams, _ in counts.values():
        seen[np.unique(grams & 255)] = True
    # Class 0 is the start of a document, the last one all bytes that were never seen.
    classes = np.full(256, seen.sum() + 1, np.uint8)
    classes[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 2
    to_class = classes.copy()
    trees = {}
    for lang, (grams, n) in counts.items():
        parts = [(grams >> (8 * k)) & 255 for k in range(4)]
        # A zero byte before the text is the start of the document.
        codes = [np.where((p == 0) & (k > 0), 0, to_class[p]).astype(np.int64) for k, p in enumerate(parts)]
        trees[lang] = (codes, n)
    contexts = np.concatenate([(c[3] * a + c[2]) * a + c[1] for c, _ in trees.values()])
    used, at = np.unique(contexts, return_inverse=True)
    room = max(0, table_bytes // (4 * a * len(langs)) - a * a)
    rare = np.zeros(0, bool)
    if len(used) > room:
        rare = np.zeros(a**3, bool)
        rare[used] = True
        often = np.bincount(at, np.concatenate([n for _, n in trees.values()]).astype(np.float64), len(used))
        used = np.sort(used[np.lexsort((used, -often))[:room]])
        rare[used] = False
    states = np.zeros(a**3, np.int32)
    # Contexts of three that were never seen share the state of their last two bytes.
    every2 = np.arange(a * a)
    states[:] = np.tile(every2, a)
    states[used] = a * a + np.arange(len(used))
    by_state = np.zeros(((a * a + len(used)) * a, len(langs)), np.float32)
    sparse = []
    for j, lang in enumerate(langs):
        by_state[:, j] = _unroll(*trees[lang], a, used)
        if len(rare):
            sparse.append(_kept(*trees[lang], a, rare, by_state[: a**3, j]))
    return Statistics(langs, classes, a, states, by_state, rare, sparse)


def _kept(codes: list[np.ndarray], n: np.ndarray, a: int, rare: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one language the grams of rare contexts with their code lengths, and the contexts with that of an escape. ``shorter``: code lengths after two bytes."""
    context = ((codes[3] * a + codes[2]) * a + codes[1]).astype(np.int64)
    some = rare[context]
    grams, at = np.unique(context[some] * a + codes[0][some], return_inverse=True)
    often = np.bincount(at, n[some].astype(np.float64), len(grams))
    contexts, first = np.unique(grams // a, return_index=True)
    if not len(grams):
        return grams, often, contexts, often
    total, distinct = np.add.reduceat(often, first), np.diff(np.append(first, len(grams)))
    lower = np.exp2(-shorter.astype(np.float64))
    of = contexts % (a * a)
    # What the unseen bytes have after two bytes.
    left = lower.reshape(-1, a).sum(1)[of] - np.add.reduceat(lower[(grams // a) % (a * a) * a + grams % a], first)
    bits = -np.log2(np.maximum(often / np.repeat(total + distinct, distinct), 1e-9))
    return grams, bits.astype(np.float32), contexts, (-np.log2(distinct / (total + distinct) / np.maximum(left, 1e-12))).astype(np.float32)


def _unroll(codes: list[np.ndarray], n: np.ndarray, a: int, used: np.ndarray) -> np.ndarray:
    """Code lengths of one language: first for every context of two, then for every context of three in ``used``."""
    weights = n.astype(np.float64)
    c1, c2 = np.bincount(codes[0], weights, a)[None, :], np.bincount(codes[1] * a + codes[0], weights, a * a).reshape(a, a)
    c3 = np.bincount((codes[2] * a + codes[1]) * a + codes[0], weights, a**3).reshape(a * a, a)
    context = (codes[3] * a + codes[2]) * a + codes[1]
    index = np.searchsorted(used, context)
    own = (used[np.minimum(index, len(used) - 1)] == context) if len(used) else np.zeros(len(context), bool)
    c4 = np.bincount(index[own] * a + codes[0][own], weights[own], len(used) * a).reshape(len(used), a)
    floor = np.full((1, a), 1.0 / 256)
    p1 = _mix(c1, floor)
    p2 = _mix(c2, np.broadcast_to(p1, (a, a)))
    p3 = _mix(c3, p2[np.arange(a * a) % a])
    out = np.empty((a * a + len(used), a), np.float32)
    out[: a * a] = -np.log2(p3)
    for at in range(0, len(used), 2_000):
        some = slice(at, at + 2_000)
        out[a * a + at : a * a + at + len(used[some])] = -np.log2(_mix(c4[some], p3[used[some] % (a * a)]))
    return out.ravel()


def _mix(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Method C with exclusion: seen bytes by count, the escape's share over the others in proportion to the shorter context."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0.0, lower)
    room = rest.sum(1, keepdims=True)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    p = np.where(counts > 0, counts / np.maximum(total + distinct, 1), escape * rest / np.maximum(room, 1e-12))
    return np.maximum(p, 1e-9)


def learn(docs: DataFrame, per_language: int = SAMPLE) -> Statistics | None:
    """Statistics of the documents that are not held out. Grams of a bounded sample come to the driver."""
    import pyarrow.compute as pc

    rows = count_grams(sample(docs, per_language)).toArrow()
    langs = pc.unique(rows["lang"]).to_pylist()
    if not langs:
        return None
    of = lambda lang: rows.filter(pc.equal(rows["lang"], lang))
    return build({lang: (of(lang)["gram"].to_numpy(), of(lang)["n"].to_numpy()) for lang in langs})


def has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False), bool)


def predict(docs: DataFrame, statistics: Statistics | None, chunk_bytes: int = 1 << 20) -> DataFrame:
    """All columns of ``docs`` that are given, with lang_pred, score and bits_per_byte (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    keep = docs.drop("lang_pred", "score", "bits_per_byte")
    out = ("lang_pred string", "score double", "bits_per_byte double")
    if statistics is None:
        return keep.selectExpr("*", f"'{UNKNOWN}' AS lang_pred", "0D AS score", "0D AS bits_per_byte")
    shared = docs.sparkSession.sparkContext.broadcast(statistics)
    place = keep.columns.index("text")

    def run(batches):
        s = shared.value
        for batch in batches:
            texts = batch.column(place)
            text, offsets = byte_column(texts)
            bits = np.zeros((len(texts), len(s.langs)))
            for at, end in chunks(offsets, chunk_bytes):
                bits[at:end] = s.code_lengths(text[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            known = has_letter(texts)
            best = bits.argmin(1) if len(bits) else np.zeros(0, int)
            least = bits.min(1, initial=np.inf) if len(bits) else np.zeros(0)
            chance = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            names = np.where(known, np.array(s.langs, object)[best], UNKNOWN)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, chance, 0.0)), pa.array(np.where(known, least / np.maximum(size, 1), 0.0))],
                names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"],
            )

    from pyspark.sql.types import StructType

    schema = StructType(keep.schema.fields + StructType.fromDDL(", ".join(out)).fields)
    return keep.mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")).select("doc_id", "held_out", "text"), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
