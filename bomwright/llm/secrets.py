"""Secrets in texts: fixed forms, and values in a credential's place that are hard to guess.

Fixed forms are found by three patterns (assignments of long values, access keys, hex
runs). Beside them stand values of any form where a credential is named before them:
``password: x``, ``Kennwort ist x``, ``Authorization: Bearer x``, ``https://user:x@host``.
Such a value is a secret if it takes ``SECRET`` guesses (a power of ten) or more.

Guesses come from a dynamic programme over the value's characters: the cheapest way to
cut it into words, dates, years, repeats of a block, keyboard walks, sequences and
brute-force spans. A part costs the logarithm of its guesses, and each part after the
first ``JOIN`` more. A word's guesses are how often one of its frequency is met: all
words of the corpus by its own, so that a text's own vocabulary, in any language, is
cheap; capitals and figures that stand for letters make it dearer. Words are counted
over all documents, as runs of letters; those inside the values themselves do not
count, or a secret would vouch for itself.

Only distinct values and those of their pieces that are words meet the counts, by joins;
nothing is sent to all tasks. A text is scanned in one task; its length is not limited,
and a value's cost takes time in proportion to its length.

Defined results: null and empty texts have no spans; null ids and repeated rows are
judged like others (each row by itself, though all are counted as words); of values that
overlap, the one that begins first is taken; a value that overlaps a fixed form adds no
span; an empty table gives no rows; columns besides the text come along unchanged,
unless they are called spans, which is replaced.
"""

from __future__ import annotations

import re
from itertools import pairwise
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, packed, restored, small_batches, spread_join, table

KINDS = ("assign", "access", "hex", "guess")
#: The fixed forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12
#: What names a credential, and what may stand between the name and the value.
NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api[_ -]?key", "access[_ -]?key", "private[_ -]?key", "credentials?", "authorization", "passwort", "kennwort", "mot de passe", "contraseña", "clave")
VERBS = ("is", "ist", "lautet", "es", "est")
VALUE = r"""[^\s"'`<>(){}\[\],;|\\]{6,}"""
CONTEXT = re.compile(
    rf"""(?:{"|".join(NAMES)})["']?(?:\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?["'`]?|\x20+(?:{"|".join(VERBS)}):?\x20+["'`]?(?=[^\s]*[0-9!-/@#$%^&*+]\S))(?P<value>{VALUE})"""
    rf"""|\bbearer\x20+(?P<bearer>{VALUE})|://[^\s/:@]+:(?P<url>[^\s/:@]{{6,}})@""",
    re.ASCII | re.IGNORECASE,
)
#: What some part of which every context has, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "kennwort", "contraseña", "clave", "://")
#: A value of so many guesses, as a power of ten, is a secret; what each further part adds.
SECRET = 8.0
JOIN = 0.5
#: Letters of a word, and characters of a repeated block.
WORD_LEAST, WORD_MOST = 3, 24
BLOCK_MOST = 32
#: Keys in rows, each row half a key to the right of the one above, plain and with shift, and figures that stand for letters.
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}", 'ASDFGHJKL:"', "ZXCVBNM<>?")
STANDS_FOR = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "l", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
_PLACE = {c: (r, k) for rows in (KEYS, SHIFTED) for r, row in enumerate(rows) for k, c in enumerate(row)}
_N_KEYS = sum(map(len, KEYS))

DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\3(?:19|20)?\d\d))", re.ASCII)
YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)
#: Guesses of a date (days of two centuries, and how it is written) and of a year.
DATE_COST, YEAR_COST = log10(365 * 200 * 4), log10(200)


def char_cost(c: str) -> float:
    """Brute force: one of the characters of its kind."""
    return log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 100)


def pieces(value: str) -> set[str]:
    """The spans of a value that may be words, in lower case, and with letters for figures that stand for them."""
    low = value.lower()
    out = set()
    for text in {low, low.translate(STANDS_FOR)}:
        for run in re.finditer(r"[^\W\d_]+", text):
            t = run.group()
            out.update(t[i:j] for i in range(len(t)) for j in range(i + WORD_LEAST, min(len(t), i + WORD_MOST) + 1))
    return out


def _maximal(n: int, step) -> list[tuple[int, int]]:
    """Longest stretches [start, end) in each of which step(k, k + 1) holds for all neighbours."""
    edges = [0, *(k + 1 for k in range(n - 1) if not step(k, k + 1)), n]
    return [(a, b) for a, b in pairwise(edges) if b > a]


def _next_key(a: str, b: str) -> tuple[int, int] | None:
    """How far apart two keys that touch are, in rows and places."""
    if a not in _PLACE or b not in _PLACE:
        return None
    (r, k), (q, m) = _PLACE[a], _PLACE[b]
    move = (q - r, m - k)
    return move if move in {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)} else None


def patterns(value: str, words: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """Parts that a value may have: start, end, kind, and the logarithm of its guesses. ``words``: that of each word."""
    n, out = len(value), []
    low = value.lower()
    if len(low) != n:  # a few capitals have two small letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(STANDS_FOR)
    for text in (low,) if plain == low else (low, plain):
        for i in range(n):
            for j in range(i + WORD_LEAST, min(n, i + WORD_MOST) + 1):
                if text[i:j] in words:
                    capitals = sum(c.isupper() for c in value[i:j])
                    figures = sum(a != b for a, b in zip(low[i:j], text[i:j], strict=True))
                    shape = 0.0 if not capitals else log10(2) if capitals == j - i or (capitals == 1 and value[i].isupper()) else capitals * log10(j - i)
                    out.append((i, j, "word", words[text[i:j]] + shape + figures * log10(2)))
    for pattern, kind, cost in ((DATE, "date", DATE_COST), (YEAR, "year", YEAR_COST)):
        out += [(m.start(1), m.end(1), kind, cost) for m in pattern.finditer(value)]
    for block in range(1, min(BLOCK_MOST, n // 2) + 1):
        same = [value[k] == value[k + block] for k in range(n - block)]
        for a, b in _maximal(len(same), lambda k, m, same=same: same[k] and same[m]):
            times = (b - a) // block + 1 if same[a] else 1
            if times * block >= 3 and times > 1:
                once = guess_cost(value[a : a + block], words)[0] if block > 1 else char_cost(value[a])
                out.append((a, a + times * block, "repeat", once + log10(times)))
    for a, b in _maximal(n, lambda k, m: _next_key(value[k], value[m]) is not None):
        if b - a >= 3:
            moves = [_next_key(value[k], value[k + 1]) for k in range(a, b - 1)]
            turns = sum(x != y for x, y in pairwise(moves))  # to one of five other ways
            out.append((a, b, "walk", log10(_N_KEYS * (b - a) * 6) + turns * log10(5)))
    step = lambda k, m: ord(value[m]) - ord(value[k])
    for way in (1, -1):
        for a, b in _maximal(n, lambda k, m, way=way: step(k, m) == way and value[k].isalnum() and value[m].isalnum()):
            if b - a >= 3:
                out.append((a, b, "sequence", char_cost(value[a]) + log10(2 * (b - a))))
    return out


def guess_cost(value: str, words: dict[str, float]) -> tuple[float, list[tuple[int, int, str]]]:
    """The logarithm of the guesses that the cheapest cut of a value takes, and its parts."""
    ends: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in patterns(value, words):
        ends.setdefault(j, []).append((i, kind, cost))
    # For each prefix the cheapest cut that ends in a pattern, and the cheapest that ends in a brute-force span.
    inf = float("inf")
    whole, brute = [0.0], [inf]
    via, since = [(0, "")], [0]
    for j in range(1, len(value) + 1):
        best, how = inf, (0, "")
        for i, kind, cost in ends.get(j, ()):
            c = min(whole[i], brute[i]) + cost + (JOIN if i else 0.0)
            if c < best:
                best, how = c, (i, kind)
        fresh = whole[j - 1] + (JOIN if j > 1 else 0.0)
        on = brute[j - 1]
        since.append(since[j - 1] if on <= fresh else j - 1)
        brute.append(min(on, fresh) + char_cost(value[j - 1]))
        whole.append(best)
        via.append(how)
    parts, j = [], len(value)
    while j:
        i, kind = via[j] if whole[j] <= brute[j] else (since[j], "brute")
        parts.append((i, j, kind))
        j = i
    return min(whole[-1], brute[-1]), parts[::-1]


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Fixed forms (start, end, kind's number) and the values in a credential's place."""
    low = text.lower()
    fixed = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE] if any(k in low for k in ASSIGNED) else []
    if "AKIA" in text:
        fixed += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    fixed += [(*m.span(), 2) for m in HEX_RUN.finditer(text)]
    asked = []
    if any(k in low for k in HINTS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastgroup)
            end = start + len(text[start:end].rstrip(".:"))
            if end - start >= 6:
                asked.append((start, end))
    return sorted(fixed), asked


def scan(docs: DataFrame) -> DataFrame:
    """All columns but the text, with fixed (the fixed forms) and asked (the values to be judged), and row, a number of its own."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    rows = docs.select("text", packed(keep).alias("carried"))
    schema = StructType(rows.schema.fields[1:] + StructType.fromDDL("fixed array<struct<start: bigint, end: bigint, kind: int>>, asked array<struct<start: bigint, end: bigint, value: string>>").fields)
    types = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), (name, kind)])) for name, kind in (("kind", pa.int32()), ("value", pa.string()))]

    def run(batches):
        for batch in batches:
            fixed, asked = [], []
            for text in batch.column(0).to_pylist():
                f, a = spans_of(text or "")
                fixed.append([dict(start=x, end=y, kind=k) for x, y, k in f])
                asked.append([dict(start=x, end=y, value=text[x:y]) for x, y in a])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fixed, types[0]), pa.array(asked, types[1])], names=["carried", "fixed", "asked"])

    return materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "secrets-scan")


def _runs_of_letters(text: Column) -> Column:
    return F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w).between(WORD_LEAST, WORD_MOST)))


def judged(values: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct values (value, n) with log_guesses and parts, by the words of ``docs``."""

    def cut(batches):
        for batch in batches:
            for n, value in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                some = sorted(pieces(value))
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(some), pa.string()), pa.array(some, pa.string())], names=["value", "piece"])

    pairs = materialize(values.mapInArrow(cut, "value string, piece string"), "secrets-pieces")
    corpus = materialize(docs.select(_runs_of_letters(F.col("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "secrets-words")
    own = values.select(_runs_of_letters(F.col("value")).alias("word"), F.col("n").alias("inside")).groupBy("word").agg(F.sum("inside").alias("inside"))
    total = corpus.agg(F.sum("n")).first()[0] or 1  # one number comes to the driver
    asked = pairs.groupBy("piece").agg(F.count("*").alias("places"))
    known = asked.join(corpus, F.col("piece") == F.col("word")).drop("piece").join(own, "word", "left")
    known = known.withColumn("outside", F.col("n") - F.coalesce("inside", F.lit(0))).where("outside > 0")
    known = materialize(known.select("word", "places", F.log10(F.lit(float(total)) / F.col("outside")).alias("cost")), "secrets-known")
    met = spread_join(pairs, known, [("piece", "word")], "places", F.xxhash64("value")).groupBy(F.col("value").alias("of")).agg(F.collect_list(F.struct("piece", "cost")).alias("words"))
    rows = values.join(met, F.col("value") == F.col("of"), "left").select("value", "n", "words")

    def cost(batches):
        for batch in batches:
            found = [guess_cost(v, {w["piece"]: w["cost"] for w in words or ()}) for v, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            parts = [" ".join(f"{kind}:{i}:{j}" for i, j, kind in p) for _, p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.float64()), pa.array(parts, pa.string())], names=["value", "n", "log_guesses", "parts"])

    return materialize(rows.mapInArrow(cost, "value string, n bigint, log_guesses double, parts string"), "secrets-judged")


def find_secrets(docs: DataFrame, least: float = SECRET) -> DataFrame:
    """All columns but the text, with spans: start, end (code points, end exclusive) and kind of each secret, and for a value that was judged log_guesses and parts.

    Fixed forms span the whole match, judged values the value alone.
    """
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    rows = scan(docs)
    asked = rows.select("row", F.explode("asked").alias("a")).select("row", "a.*")
    values = materialize(asked.groupBy("value").agg(F.count("*").alias("n")), "secrets-values")
    costs = judged(values, docs).withColumnRenamed("value", "of").where(F.col("log_guesses") >= least)
    secret = spread_join(asked, costs, [("value", "of")], "n", F.xxhash64("row"))
    by_row = secret.groupBy(F.col("row").alias("of_row")).agg(F.collect_list(F.struct("start", "end", F.lit(KINDS.index("guess")).alias("kind"), "log_guesses", "parts")).alias("found"))
    none = [F.lit(None).cast("double").alias("log_guesses"), F.lit(None).cast("string").alias("parts")]
    fixed = F.transform("fixed", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), *none))
    apart = lambda x: ~F.exists("fixed", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    added = F.filter(F.coalesce("found", F.filter(fixed, lambda x: F.lit(False))), apart)
    # by start, then kind
    order = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["log_guesses"].alias("log_guesses"), x["parts"].alias("parts"))
    ordered = F.array_sort(F.transform(F.concat(fixed, added), order))
    named_spans = F.transform(ordered, lambda x: x.withField("kind", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)))
    return rows.join(by_row, F.col("row") == F.col("of_row"), "left").select("carried", named_spans.alias("spans")).select(*restored(keep, keep), "spans")


def op11(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), counts[3])
