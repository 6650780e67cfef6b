"""Mixing, language, packing, quality, token files and page text; then the pipeline, stage by stage."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bomwright.llm import common, html_text, langid, mixing, neardup, packing, quality, suffixes, token_files, tokens
from tests.llm.test_dedup import COLUMNS, brute_suffixes, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "Hello world", "Hello  world\n\nagain", "über straße 你好 \U0001f600", "<|endoftext|> end", "word " * 4000, "tail ", "a\tb", "x" * 5000, "Hello world"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), COLUMNS)


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(ids_of):
    for text, ids in zip(TEXTS, tokens.encoder(tokens.default_path()).encode([t or "" for t in TEXTS]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1]


def test_token_files(spark, docs, ids_of, tmp_path):
    folder = f"file://{tmp_path}/files"
    parts = token_files.write_files(docs, folder, row_length=64, parts=3)
    found = sorted(token_files.read_documents(spark, folder, parts).collect())
    start = 0
    for row, text in zip(found, TEXTS, strict=True):
        ids = ids_of(text)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    first, n = parts[0]
    file, _ = token_files.open_part(folder, first)
    ids, mask = token_files.random_row(file, (n - 1) // 64)
    assert len(ids) == 64 and mask.sum() == (n - 1) % 64 + 1
    assert token_files.write_files(docs.limit(0), folder + "-none") == []


def test_packing(docs, ids_of):
    rows = packing.best_fit_pack(docs, capacity=128).collect()
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, text in enumerate(TEXTS):
        ids, at = ids_of(text), 0
        pieces = sorted(by_document[k], key=lambda r: r.piece)
        for n, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, crc(ids[at : at + r.length])) and r.length == (128 if n else r.length)
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > 128)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.best_fit_pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packed_counts_are_whole_and_near_the_least(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 300) if seed % 2 else r.integers(20, 60, 300)
    counts = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    layouts = packing.pack_counts(counts, 100)
    used = {}
    for number, layout in layouts:
        assert sum(layout) <= 100 and sum(3 * n > 100 for n in layout) <= 2
        for n in layout:
            used[n] = used.get(n, 0) + number
    assert used == counts
    least = max(math.ceil(lengths.sum() / 100), int((lengths > 50).sum()))
    assert sum(number for number, _ in layouts) <= 1.25 * least + 1


def test_mixing(spark):
    rows = [(k, "w " * (k % 37), None if k % 11 == 0 else f"s{min(k % 9, 4)}") for k in range(400)] + [(None, "a b", "s1"), (5, None, "s2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, size string")
    first, again = (sorted(map(tuple, mixing.pareto_mix(df).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    out = mixing.pareto_mix(df).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    sums = out.groupby(out.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), source_size=("source_size", "first"))
    assert ((sums.taken - sums.target).abs() <= 37).all() and (out[out.p >= 1].copies >= 1).all() and (sums.target <= 2 * sums.source_size + 1e-9).all()
    assert abs(sums.target.sum() - 1.5 * sums.source_size.sum()) < 1e-6
    many = mixing.BROADCAST_BANDS
    try:
        mixing.BROADCAST_BANDS = 0
        assert sorted(map(tuple, mixing.pareto_mix(df).collect()), key=str) == first
    finally:
        mixing.BROADCAST_BANDS = many
    assert mixing.pareto_mix(df.limit(0)).count() == 0


def test_mixing_draws_by_probability(spark):
    """Over many seeds each document is drawn as often as its p says, and certain ones always."""
    r = np.random.default_rng(8)
    sizes = [int(x) for x in r.choice([2, 5, 20, 90, 400], 4000, p=[0.3, 0.3, 0.2, 0.18, 0.02])]
    df = spark.createDataFrame([(k, "w " * n, "s") for k, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    for share, given in ((0.3, None), (0.7, None), (0.6, F.when(F.col("doc_id") < 10, 50.0).otherwise(F.lit(1.0) + F.col("doc_id") % 3))):
        out = mixing.pareto_mix(df, share=share, weight=given).toPandas()
        assert abs((out.p * out["size"]).sum() - share * sum(sizes)) < 1e-6 * sum(sizes) and out.p.nunique() > 2
        assert (out.copies[out.p >= 1] == 1).all()
        for value in out.p.unique():  # the mean of n draws of p
            some = out.copies[out.p == value]
            assert abs(some.mean() - value) < 4 * math.sqrt(value * (1 - value) / len(some)) + 0.01


def test_mixing_reruns_agree_on_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else 1, f"{k} " + "w " * (k % 37), "ab"[k % 3 > 0]) for k in range(1500)]
    take = lambda some, n: sorted(map(str, mixing.pareto_mix(spark.createDataFrame(some, "doc_id bigint, text string, source string").repartition(n)).collect()))
    assert take(rows, 3) == take(rows[::-1], 5)


def test_mixing_equals_sql(spark, sf_dir):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = duckdb.execute(f"SELECT doc_id, size, source_size, target, taken, copies FROM ({mixing.OP2_SQL})").fetchall()
    assert sorted(map(tuple, mixing.op2(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken", "copies").collect())) == sorted(theirs)


def test_language(spark):
    out = langid.op3(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = out[out.held_out].merge(truth, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_code_lengths_are_those_of_the_context_trees():
    texts = {"x": b"abracadabra abracad", "y": b"zyzzyva zyz zyzyz"}
    counts = {}
    for lang, t in texts.items():
        grams, n = np.unique(langid.grams_of(np.frombuffer(t, np.uint8), np.array([0])), return_counts=True)
        counts[lang] = (grams.astype(np.int64), n)
    statistics = langid.build(counts)
    follow = {}
    for lang, t in texts.items():
        for k, c in enumerate(t):
            for order in range(4):
                context = tuple(t[k - j] if k - j >= 0 else -1 for j in range(order, 0, -1))
                follow.setdefault((lang, context), {}).setdefault(c, 0)
                follow[lang, context][c] += 1

    symbols = len({c for t in texts.values() for c in t}) + 2

    def chance(lang, context, c):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        seen = follow.get((lang, context), {})
        if not seen:
            return chance(lang, shorter, c)
        total, distinct = sum(seen.values()), len(seen)
        if c in seen:
            return seen[c] / (total + distinct)
        every = sorted({x for t in texts.values() for x in t} | {-1, -2})
        assert len(every) == symbols
        room = sum(chance(lang, shorter, x) for x in every if x not in seen)
        return distinct / (total + distinct) * chance(lang, shorter, c) / room

    probe = b"abra zyz cad"
    bits = statistics.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0]
    for lang, found in zip(statistics.langs, bits, strict=True):
        exact = sum(-math.log2(chance(lang, tuple(probe[k - j] if k - j >= 0 else -1 for j in (3, 2, 1)), c)) for k, c in enumerate(probe))
        assert abs(found - exact) < 0.01


def test_language_of_odd_texts(spark, docs):
    learned = langid.learn(spark.createDataFrame([(k, "guten tag und danke" if k % 2 else "good day and thanks", "de" if k % 2 else "en") for k in range(60)], "doc_id bigint, text string, lang string"))
    found = {r.doc_id: r for r in langid.predict(docs, learned).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and found[0].score == 0.0
    assert found[3].lang_pred in ("de", "en") and found[3].rank == 2
    assert langid.learn(docs.limit(0)) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", "a b c", "one two three four five six\n" * 3 + "\n \none two", "#*$%&|<> é x", "k " * 60, " ".join(map(str, range(80))), "same\nsame\n same"]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    found = {r.doc_id: r for r in quality.weak_supervision(df).collect()}
    for k, t in enumerate(texts):
        n, chars, symbols, lines, repeats = brute_counts(t)
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)
    assert quality.weak_supervision(df.limit(0)).count() == 0


def test_quality_estimates_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.7
    truth = [(0.97, 0.6), (0.9, 0.7), (0.95, 0.5), (0.92, 0.65)]
    votes = np.stack([np.where(r.random(len(good)) < 0.2, 0, np.where(np.where(good, r.random(len(good)) < a, r.random(len(good)) > b), 1, -1)) for a, b in truth], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, accuracy = quality.estimate([(tuple(map(int, p)), int(n)) for p, n in zip(patterns, counts, strict=True)], 4, rounds=200)
    assert abs(share - 0.7) < 0.1
    assert all(abs(x - y) < 0.12 for found, true in zip(accuracy, truth, strict=True) for x, y in zip(found, true, strict=True))


def test_quality_follows_the_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    judged = quality.op6(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    assert judged[judged.good].kept.mean() > 0.95, judged.groupby("good").kept.mean()
    assert judged[~judged.good].kept.mean() < 0.5, judged.groupby("good").kept.mean()


def test_main_text_of_unseen_pages():
    weights = html_text.default_weights()
    right = total = 0
    for seed in range(50_000, 50_150):
        blocks, labels = html_text.labelled_blocks(seed)
        right += sum(a == b for a, b in zip(weights.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling():
    weights = html_text.Weights({"size:0": 0.7, "size:1": -0.4, "size:2": 0.2, "own:p": 0.3}, -0.2, np.array([[0.4, -0.3], [-0.5, 0.6]]))
    page = "<p>a</p><div>b c d</div><p>e f g h i j</p><div>k</div><p>l m</p>"
    blocks = html_text.leaf_blocks(page)

    def score(labels):
        total = weights.start * labels[0]
        for (b, t, _), y in zip(blocks, labels, strict=True):
            total += y * (weights.context(b.tags, b.names) + sum(weights.features.get(f, 0.0) for f in html_text.text_features(t, b.linked)))
        return total + sum(weights.steps[a][b] for a, b in zip(labels, labels[1:], strict=False))

    every = [[k >> j & 1 for j in range(len(blocks))] for k in range(1 << len(blocks))]
    assert score([int(x) for x in weights.decode(blocks)]) == pytest.approx(max(map(score, every)))


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>First   long\n paragraph of words that goes on for a while, with a point.</p><script>x<y</script><p>Second one &eacute;&#8364; that says something more, and ends.</p></article><footer>&copy; 2020</footer>"
    rows = spark.createDataFrame([(1, "u", html, "x"), (2, None, None, "x"), (3, "", "", "x")], "page_id bigint, url string, html string, text string")
    found = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert found[1].text == "A & B\n\nFirst long paragraph of words that goes on for a while, with a point.\n\nSecond one é€ that says something more, and ends."
    assert found[1].n_chars == len(found[1].text) and found[2].text == "" and found[3].n_chars == 0
    assert html_text.extract(rows.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = common.materialize(corpus_pipeline.language_id(spark, docs, sf_dir), "test")
    assert kept.columns == columns and kept.count() >= 0.98 * docs.where("text IS NOT NULL").count()
    unique = common.materialize(corpus_pipeline.near_dedup(spark, kept, sf_dir), "test")
    groups = neardup.grouped(kept.select("doc_id", "text"), similar=True).toPandas()
    assert sorted(r.doc_id for r in unique.collect()) == sorted(groups.component_id.unique())
    cut = common.materialize(corpus_pipeline.suffix_dedup(spark, unique, sf_dir), "test")
    assert cut.columns == columns and cut.count() == unique.count()
    whole = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(unique).collect())
    assert whole == brute_suffixes([r.text for r in unique.collect()], suffixes.LENGTH)
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, cut, sf_dir), "test")
    taken = mixing.pareto_mix(cut).toPandas()
    assert mixed.columns == columns and mixed.count() == taken.copies.sum()
    assert mixed.agg({"n_chars": "sum"}).first()[0] == sum(len(r.text) for r in mixed.collect())
    packed = corpus_pipeline.pack(spark, mixed, sf_dir).toPandas()
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and packed.groupby(["doc_id"]).ngroups == mixed.select("doc_id").distinct().count()
    assert len(fill) <= math.ceil(packed.length.sum() / 1024) * 1.02 + 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mix_sources", "pack"]


def test_pipeline_runs_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_kept_hash_is_of_joined_words(spark):
    from bomwright.llm import substrings

    row = substrings.remove_repeats(spark.createDataFrame([(1, " a\tb\n\u00a0 c ")], "doc_id bigint, text string")).first()
    assert row.kept_sha256 == hashlib.sha256("a b \u00a0 c".encode()).hexdigest() and row.n_words == 4


def test_null_column_of_texts():
    assert langid.has_letter(pa.array([None, "1", "é"], pa.string())).tolist() == [False, False, True]


def texts_of(html):
    return [text for _, text, _ in html_text.leaf_blocks(html)]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='tex'>E=m</annotation></math> is known</p>", ["energy E=m is known"]),
        ("<p>a <object data=x><object>inner</object> outer</object> b</p>", ["a inner outer b"]),
        ("<p>a</p><noscript><p>b</p></noscript><p>c</p>", ["a", "b", "c"]),
        ("<p>a <svg><title>t</title> never ended</p><p>b</p>", ["a never ended", "b"]),
        ("<p>a <svg><text>x</text><svg><text>y</text></svg><text>z</text></svg> b</p>", ["a b"]),
        ("<p>a</p><svg/><p>b</p><script>var x = '<p>no</p>'", ["a", "b"]),
        ("<p>a</p><template><p>x</p><template>y</template></template>b", ["a", "b"]),
        ("<p>a<textarea><b>x</textarea>b</p><iframe src=x>", ["a b"]),
        ("<p>" + "long " * 200_000 + "</p>", [("long " * 200_000).strip()]),
    ],
)
def test_text_of_odd_markup(html, expected):
    assert texts_of(html) == expected


def other_site(r):
    """A page of a site unlike the training pages, with what belongs to its article."""
    text = lambda low, high: " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))).capitalize() + "."
    links = lambda n: "".join(f"<td><a href='#'>{text(1, 2)}</a></td>" for _ in range(n))
    body = [f"<h1 class='hl'>{text(3, 8)}</h1>"] + [f"<p class='txt'>{text(15, 90)}</p>" for _ in range(r.randint(3, 9))]
    aside = f"<div class='col-right'><h4>{text(1, 3)}</h4><ul>" + "".join(f"<li><a href='#'>{text(2, 5)}</a></li>" for _ in range(6)) + "</ul></div>"
    before = f"<table class='topnav'><tr>{links(7)}</tr></table><div class='promo-box'><a href='#'>{text(2, 6)}</a></div>"
    after = f"{aside}<div class='comments-area'><div class='comment-body'>{text(5, 30)}</div></div><footer><div>© 2021 {text(2, 5)}</div></footer>"
    return f"<body><div id='root'>{before}<div class='col-main'>{''.join(body)}</div>{after}</div></body>", len(body)


def test_main_text_of_other_templates():
    import random

    r, weights, right, total = random.Random(9), html_text.default_weights(), 0, 0
    for _ in range(60):
        html, n = other_site(r)
        blocks = html_text.leaf_blocks(html)
        truth = ["col-main" in html[max(0, at - 60) : at] or b.tags[-1] == "p" or b.tags[-1] == "h1" for b, _, at in blocks]
        assert sum(truth) == n
        right += sum(a == b for a, b in zip(weights.decode(blocks), truth, strict=True))
        total += len(blocks)
    assert right / total > 0.85, right / total


def test_contexts_without_rows_have_the_same_code_lengths():
    """Rows for all contexts of three bytes, for some and for none: no context is dropped."""
    r = np.random.default_rng(4)
    counts = {}
    for lang, letters in (("a", b"abcdefgh "), ("b", b"aeiou xyz"), ("c", b"abc"), ("d", bytes(range(32, 127)))):
        text = np.array([letters[k] for k in r.integers(0, len(letters), 6000)], np.uint8)
        grams, n = np.unique(langid.grams_of(text, np.array([0, 2000, 4000])), return_counts=True)
        counts[lang] = (grams.astype(np.int64), n)
    text = r.integers(30, 130, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 1, 700, 5000])
    full = langid.build(counts).code_lengths(text, offsets)
    a = langid.build(counts).n_classes
    for rows in (0, 1, 50, 2000):
        found = langid.build(counts, 4 * a * len(counts) * (a * a + rows))
        assert len(found.by_state) == (a * a + rows) * a and found.rare.any()
        assert np.allclose(found.code_lengths(text, offsets), full, rtol=1e-5)
