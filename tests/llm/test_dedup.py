"""Substring, suffix and SimHash dedup, fingerprints, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from bomwright.llm import fingerprints, neardup, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, key string, name string, low int, rank int, of string, fp string, source string"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "k", "n", 1, 2, "o", "f", None) for i, t in zip(ids, texts, strict=True)]


def sample(seed=3):
    r = random.Random(seed)
    vocabulary = ["alpha", "b", "é", "delta", "eps", "zeta"]
    shared = " ".join(r.choices(vocabulary, k=30))
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(40)]
    texts += [texts[3] + "  " + shared, shared + "\n" + texts[5], shared, shared, None, "", "x", "\t \n", "w " * 3000 + shared]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = sample()
    return spark.createDataFrame(rows_of(texts, [None, *range(1, len(texts))]), COLUMNS)


def brute_substrings(rows, length):
    rank = lambda i: float("inf") if i is None else i
    words = [(rank(i), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, float("inf")), i)
    out = []
    for (i, w), (doc, _) in zip(words, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "block"), [(6, 3), (12, 5), (50, 25)])
def test_substrings(docs, length, block):
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, length, block).collect()]
    assert sorted(found, key=str) == brute_substrings([(r.doc_id, r.text) for r in docs.collect()], length)


def test_substrings_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(map(str, range(80)))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(twice).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert substrings.remove_repeats(twice.limit(0)).count() == 0


def brute_suffixes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        rest = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "block"), [(17, 6), (40, 16), (200, 64)])
def test_suffixes(docs, length, block):
    found = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, length, block).collect()]
    assert sorted(found) == brute_suffixes([r.text for r in docs.collect()], length)


def test_suffixes_keep_columns_and_repeats_in_one_text(spark):
    text = "abc" * 100
    rows = spark.createDataFrame(rows_of([text, "q" * 199, None]), COLUMNS)
    found = {r.doc_id: r for r in suffixes.remove_repeats(rows, kept_bytes=True).collect()}
    assert found[0].n_removed == 300 and found[0].n_spans == 1 and bytes(found[0].kept) == b""
    assert bytes(found[1].kept) == b"q" * 199 and found[1].carried.c0 == "en" and found[2].n_bytes == 0
    assert suffixes.remove_repeats(rows.limit(0)).count() == 0


def fingerprint(text):
    words = (text or "").encode().translate(neardup.LOWER).split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates(spark):
    r = random.Random(5)
    base = [" ".join(r.choices("abcdefghij", k=400)) for _ in range(12)]
    texts = list(base)
    for t in base:
        for _ in range(6):
            w = t.split(" ")
            w[r.randrange(len(w))] = "Z"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "ONE  two", base[0], base[0].upper()] + [f"{k} {k} {k}" for k in range(300)]
    rows = list(enumerate(texts, 10)) + [(None, base[1])]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, component_id string, root string")
    found = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in neardup.near_duplicates(df).collect()), key=str)
    assert found == brute_components(rows)


def test_parts_of_a_shared_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 16)
    r = random.Random(2)
    values = list({(r.getrandbits(10) << 16) | 7 for _ in range(200)})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {row.node: row.root for row in neardup.components(neardup.links(df)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_bit_sliced_distances():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    b = np.concatenate([a[:70] ^ (np.uint64(1) << r.integers(0, 63, 70, dtype=np.uint64)), r.integers(0, 1 << 63, 30, dtype=np.uint64), a[:3] ^ np.uint64(15), a[:3] ^ np.uint64(7)])
    i, j = map(np.concatenate, zip(*neardup.near_all(a, b), strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(len(a)) for y in range(len(b)) if int(np.bitwise_count(a[x] ^ b[y])) <= 3}


def five_word_shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_similar_texts_are_grouped(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    texts, kinds = [], []
    for kind in range(30):
        base = r.choices(vocabulary, k=r.choice([60, 300, 900]))
        for copy in range(8):
            words = list(base)
            for k in r.sample(range(len(words)), len(words) // 60 if copy else 0):
                words[k] = "changed"
            texts.append(" ".join(words).upper() if copy == 3 else " ".join(words))
            kinds.append(kind)
    texts += [None, "", "one two", "ONE  two", "one two three"] + [f"{k} a b c d e" for k in range(40)] + ["De " * 400 + f"tail {k} of one long text" for k in range(3)]
    kinds += ["none", "none", "short", "short", "other"] + list(range(100, 140)) + ["tail"] * 3
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, component_id string")
    group = {row.doc_id: row.component_id for row in neardup.grouped(df.select("doc_id", "text"), similar=True).collect()}
    assert len(group) == len(texts)
    shingles = [five_word_shingles(t or "") for t in texts]
    alike = apart = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(shingles[a] | shingles[b])
            if both == 0 or len(shingles[a] & shingles[b]) >= 0.8 * both:
                alike += 1
                apart += group[a] != group[b]
            assert group[a] != group[b] or kinds[a] == kinds[b]
    assert alike > 200 and apart <= 0.05 * alike


@pytest.mark.parametrize("part", [neardup.PART, 16])
def test_similar_links_connect_all_that_meet(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(25)]
    values = list({x ^ sum(1 << b for b in r.sample(range(128), r.randrange(15))) for x in base for _ in range(8)})
    df = spark.createDataFrame([(f"{v:032x}",) for v in values], "fp string")
    root = {row.node: row.root for row in neardup.components(neardup.similar_links(df)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    masks = neardup.sampled_masks(len(values))
    # hex_of writes the lower half first
    swapped = {v: v >> 64 | (v & (1 << 64) - 1) << 64 for v in values}
    for a in values:
        for b in values:
            differ = swapped[a] ^ swapped[b]
            if a < b and differ.bit_count() <= neardup.SIMILAR_RADIUS and any(not differ & m for m in masks):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {v: int(root.get(f"{v:032x}", f"{v:032x}"), 16) for v in values} == {v: find(v) for v in values}


def test_fingerprints_with_edits(spark):
    texts = ["Ünïcode " * 9, None, "", "abc", "abcdefgh", "one two three four five six seven eight nine ten " * 40, "one two three four five six seven eight nine ten " * 40]
    df = spark.createDataFrame(rows_of(texts, range(0, 70, 10)), COLUMNS)
    found = {r.doc_id: r for r in fingerprints.fingerprints_with_edits(df, parts=3).collect()}
    clean = [t or "" for t in texts]
    for k, t in enumerate(clean):
        row, after = found[k * 10], clean[(k + 1) % len(clean)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert (row.n_chars, row.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert found[50].fingerprint == found[60].fingerprint and found[50].near_next == 1.0 and found[10].near_next == 1.0
    assert fingerprints.fingerprints_with_edits(df.limit(0)).count() == 0


def test_fingerprint_is_the_weighted_majority():
    import pyarrow as pa

    text = "a b c d e f a b c d e f g"
    single = {w: fingerprints.fingerprint_texts(pa.array([w]))[0] for w in {" ".join(text.split()[k : k + 5]) for k in range(9)}}
    terms = [" ".join(text.split()[k : k + 5]) for k in range(9)]
    for half in (0, 1):
        votes = [int(single[t][half]) for t in terms]
        expected = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))
        assert int(fingerprints.fingerprint_texts(pa.array([text]))[0][half]) == expected


def brute_neighbours(values, radius):
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    out = {}
    for a in set(values):
        near = [apart(a, b) for b in set(values) if b != a and apart(a, b) <= radius]
        out[a] = (values.count(a), len(near), min(near, default=None))
    return out


@pytest.mark.parametrize(("radius", "part"), [(3, 4096), (3, 4), (1, 4096), (5, 8)])
def test_neighbours(spark, monkeypatch, radius, part):
    monkeypatch.setattr(fingerprints, "PART", part)
    r = random.Random(4)
    flip = lambda v, n: v ^ sum(1 << b for b in r.sample(range(128), n))
    values = [r.getrandbits(128) for _ in range(40)]
    values += [flip(v, r.randrange(1, 5)) for v in values[:30]] + [flip(values[0], 1 + k % 2) for k in range(40)] + [values[0]] * 5 + [0, 0]
    hexed = [f"{v:032x}" for v in values]
    df = spark.createDataFrame([(h,) for h in hexed] + [(None,)], "fingerprint string")
    found = {x.fingerprint: (x.copies, x.n_near, x.nearest) for x in fingerprints.neighbours(df, radius).collect()}
    assert found == brute_neighbours(hexed, radius)


@pytest.mark.parametrize("n", [10, 1 << 26, 1 << 36])
def test_tables_bring_all_within_the_radius_together(n):
    from bomwright.llm.blocks import table_masks

    masks = table_masks(64, 3, n)
    assert len(masks) == {10: 4, 1 << 26: 10, 1 << 36: 20}[n]
    r = random.Random(1)
    for _ in range(2_000):
        apart = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not apart & m for m in masks)


def test_fingerprint_query_on_small_tables(spark, tmp_path):
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, "else " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in fingerprints.op4(spark, str(tmp_path)).collect()}
    assert len(found) == 4 and found[1].fingerprint == found[2].fingerprint and found[1].n_near == 0 and found[1].nearest is None
    spark.createDataFrame(rows, "doc_id bigint, text string").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op4(spark, f"{tmp_path}/none").count() == 0


def test_recall_and_precision_of_similar_groups(spark):
    """Whole documents: of pairs of similar texts, by brute force over their five-word shingles, in three bands of similarity."""
    rows = {r.doc_id: five_word_shingles(r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = [k for k, s in sorted(rows.items()) if s]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    holding = {}
    for k in ids:
        for s in rows[k]:
            holding.setdefault(s, []).append(k)
    shared = {}
    for some in holding.values():
        for x, a in enumerate(some):
            for b in some[x + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    likeness = {(a, b): n / len(rows[a] | rows[b]) for (a, b), n in shared.items()}
    for exact in (False, True):
        group = {r.doc_id: r.component_id for r in neardup.grouped(docs, similar=True, exact=exact).collect()}
        # Tables are drawn so as to find 95 of 100 pairs; the fifty or so pairs of a band here are of few groups.
        for low, high, sampled, whole in ((0.8, 1.01, 0.9, 1.0), (0.65, 0.8, 0.8, 0.9), (0.5, 0.65, 0.7, 0.8)):
            least = whole if exact else sampled
            pairs = [p for p, j in likeness.items() if low <= j < high]
            found = sum(group[a] == group[b] for a, b in pairs)
            assert found >= least * len(pairs), (low, exact, found, len(pairs))
        best = {}
        for (a, b), j in likeness.items():
            if group[a] == group[b]:
                best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
        sizes = {}
        for k in ids:
            sizes[group[k]] = sizes.get(group[k], 0) + 1
        members = [k for k in ids if sizes[group[k]] > 1]
        assert sum(best.get(k, 0) < 0.4 for k in members) <= 0.01 * len(members)
