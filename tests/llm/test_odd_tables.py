"""Odd columns, ids and empty tables, for every operator and stage."""

import hashlib

import pytest

import corpus_pipeline
from bomwright.llm import fingerprints, html_text, langid, mixing, neardup, packing, quality, substrings, suffixes, token_files

CLASHING = ["first_id", "n_rows", "component_id", "score", "lang_pred", "bits_per_byte", "carried", "root", "copies", "name", "key", "of", "salt", "size", "weight", "p", "rank", "held_out", "n_words", "a.b", "c`d", "fp", "kept", "anchor"]
SCHEMA = "doc_id {}, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in CLASHING)
LONG = " ".join(f"word{k % 97} of{k % 89}" for k in range(3000))


def rows(kind):
    texts = ["the good dog runs home and sleeps", "der gute Hund rennt nach Hause", LONG, LONG + " tail", None, "", " \t\n", "x", "the good dog runs home and sleeps", "zwei é \U0001f600 \x00 nul", LONG]
    ids = [1, 2, 3, 4, 5, 6, None, None, 1, 9, None]
    out = [(i if kind == "bigint" or i is None else f"id-{i}", t, "en" if k % 2 else "de", None if k == 3 else "s", 7, *range(len(CLASHING))) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return [*out, tuple(None for _ in out[0])]


@pytest.fixture(scope="module", params=["bigint", "string"])
def odd(request, spark):
    return spark.createDataFrame(rows(request.param), SCHEMA.format(request.param))


def same(values):
    return sorted(map(str, values))


def test_stages_keep_odd_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "").collect()
        assert found and found[0].__fields__ == odd.columns, name
        others = {tuple(r[5:]) for r in found}
        assert others <= {tuple(range(len(CLASHING))), (None,) * len(CLASHING)}, name
    assert len(corpus_pipeline.near_dedup(spark, odd, "").collect()) < odd.count()
    assert corpus_pipeline.suffix_dedup(spark, odd, "").count() == odd.count()
    assert corpus_pipeline.pack(spark, odd, "").count() >= odd.count()


def test_stages_of_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0, name


def test_operators_take_odd_tables(spark, odd, tmp_path):
    n, texts = odd.count(), same(r.text or "" for r in odd.collect())
    assert substrings.remove_repeats(odd).count() == n
    assert same(r.n_bytes for r in suffixes.remove_repeats(odd).collect()) == same(len(t.encode()) for t in texts)
    assert neardup.near_duplicates(odd).count() == n
    assert same(r.n_chars for r in fingerprints.fingerprints_with_edits(odd).collect()) == same(map(len, texts))
    assert mixing.pareto_mix(odd).count() == n
    assert quality.weak_supervision(odd).count() == n
    assert langid.predict(odd.select("doc_id", "text"), langid.learn(odd.select("doc_id", "text", "lang"))).count() == n
    assert packing.best_fit_pack(odd).where("piece = 0").count() == n
    folder = f"file://{tmp_path}/files"
    parts = token_files.write_files(odd, folder)
    assert token_files.read_documents(spark, folder, parts, dict(odd.dtypes)["doc_id"]).count() == n
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" + LONG, 3)], "page_id bigint, url string, html string, `a.b` int")
    assert html_text.extract(pages).count() == 3


def test_substrings_of_text_ids_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([("b", text), ("a", text), (None, text), ("c", "q " + text), (None, text)], "doc_id string, text string")
    found = {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert found == {("a", 0), ("b", 60), (None, 60), ("c", 60)}


def test_regular_texts_are_told_apart(spark):
    """Two symbols in the order of Thue and Morse, and the other way round: sums of powers of an odd number agree on these."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    one, other = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    df = spark.createDataFrame([(1, one), (2, other), (3, " ".join(one[:64])), (4, " ".join(other[:64]))], "doc_id bigint, text string")

    def brute(text, texts, length):
        data, gone = text.encode(), set()
        seen = {}
        for t in texts:
            for k in range(len(t) - length + 1):
                seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
        for k in range(len(data) - length + 1):
            if seen[text[k : k + length]] > 1:
                gone |= set(range(k, k + length))
        return len(gone)

    texts = [r.text for r in df.collect()]
    found = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(df).collect()}
    assert found == {k + 1: brute(t, texts, 200) for k, t in enumerate(texts)}
    words = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df.where("doc_id < 3")).collect()}
    assert words[1] == (0, hashlib.sha256(one.encode()).hexdigest()) and words[2][0] == 0
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df.where("doc_id > 2")).collect()}[3] == 0


def test_runs_in_segments(monkeypatch):
    """Texts longer than one segment are ranked as if they were one."""
    import numpy as np

    from bomwright.llm import sketch

    h = np.random.default_rng(3).integers(0, 1 << 62, 1000, dtype=np.uint64)
    whole = sketch.least_places(h, 37)
    assert (whole == [int(k + np.argmin(h[k : k + 37] >> np.uint64(28))) for k in range(len(h) - 36)]).all()
    for segment in (1, 50, 963, 964, 5000):
        assert (sketch.least_places(h, 37, segment) == whole).all()


def test_hot_anchors_are_dealt_to_tasks(spark, monkeypatch):
    """Very many different runs around one short passage, some of them repeated."""
    import random

    r = random.Random(11)
    middle = "".join(r.choices("xyz", k=90))
    noise = lambda k: "".join(r.choices("abcdefgh", k=k))
    texts = [noise(150) + middle + noise(150) for _ in range(60)]
    texts += [t[20:350] for t in texts[:20]] + [noise(30) + t[:260] for t in texts[10:30]]
    monkeypatch.setattr(suffixes, "GROUP", 8)
    monkeypatch.setattr(suffixes, "SORT_BYTES", 2_000)
    from tests.llm.test_dedup import brute_suffixes

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for length, block in ((100, 40), (200, 64)):
        found = [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(df, length, block).collect()]
        assert sorted(found) == brute_suffixes(texts, length)


def test_hot_keys_are_dealt_to_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from bomwright.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    right = left.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = common.spread_join(left, right, [("k", "of")], "n", F.xxhash64("id"))
    assert found.columns == ["k", "id", "least"]
    plain = left.join(right, F.col("k") == F.col("of")).select("k", "id", "least")
    assert sorted(found.collect()) == sorted(plain.collect())
