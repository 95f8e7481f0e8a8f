"""SimHash groups against brute force."""

import random

import pytest
import xxhash

from tonewright.llm import simhash
from tonewright.llm.graph import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    data = (text or "").encode().translate(LOWER)
    ws, cur = [], b""
    for b in data:
        if b in b" \t\n\x0b\x0c\r":
            ws += [cur] if cur else []
            cur = b""
        else:
            cur += bytes([b])
    ws += [cur] if cur else []
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_fingerprints(spark, docs):
    texts = [None, "", " \n", "One", "one two", "Ä ä Å words", "a b c a b c a b c", "x\x0by\x0cz\x1cw", *[" ".join(random.Random(i).choices("abcdefgh", k=i * 9)) for i in range(1, 9)]]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.with_fingerprints(docs(list(enumerate(texts)))).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("pairwise", [32, 1])
def test_links_are_whole(spark, pairwise):
    """pairwise 1 sends every shared key through the exact way for crowded keys."""
    rng = random.Random(pairwise)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.randrange(4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p - (1 << 64) if p >> 63 else p)
    prints |= {0, -1, 1, 3}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(df, pairwise=pairwise)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    assert {p: got.get(p, p) for p in prints} == slow_roots(sorted(prints))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1050)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1050)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_the_stage(spark, docs):
    words = " ".join(random.Random(3).choices([f"w{i}" for i in range(500)], k=400))
    other = " ".join(random.Random(4).choices([f"w{i}" for i in range(500)], k=400))
    rows = [(7, words), (3, words), (5, words.upper()), (9, other), (2, None), (4, ""), (9, other), (None, other), (8, "unlike any of these texts")]
    df = docs(rows)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 3), (3, 3), (5, 3), (9, 9), (9, 9), (None, 9), (2, 2), (4, 2), (8, 8)], key=repr)
    stage = simhash.one_of_each(df)
    assert stage.columns == df.columns
    assert sorted((r.doc_id for r in stage.collect()), key=repr) == sorted([3, 9, None, 2, 8], key=repr)
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0


def test_unlike_texts_of_one_id_stay(docs):
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=200))
    a, b, c = text(1), text(2), text(3)
    rows = [(1, a), (2, a), (2, b), (2, b.upper()), (2, c), (2, c), (3, c), (None, a), (None, b)]
    got = simhash.one_of_each(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, a), (2, b.upper()), (2, c), (None, a), (None, b)], key=repr)


def slow_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def slow_alike(a, b):
    x, y = slow_shingles(a), slow_shingles(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.8


def slow_word_prints(text, prints=3):
    ws = (text or "").lower().split()
    out = []
    for seed in range(prints):
        sums = [0] * 64
        for w in set(ws):
            weight, h = round(256 * ws.count(w) ** 0.5), xxhash.xxh64_intdigest(w.encode(), seed)
            for k in range(64):
                sums[k] += weight if h >> k & 1 else -weight
        out.append(sum(1 << k for k in range(64) if sums[k] > 0))
    return out


def slow_without_alike(rows):
    """Rows (doc_id, text) that stay, each pair looked at."""
    prints = [slow_word_prints(t) for _, t in rows]
    root = list(range(len(rows)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and any((p ^ q).bit_count() <= 4 for p, q in zip(prints[i], prints[j], strict=True)) and slow_alike(rows[i][1], rows[j][1]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [r for i, r in enumerate(rows) if r[0] is None or least[top(i)] == r[0]]


def edited(rng, ws, n):
    ws = list(ws)
    for at in rng.sample(range(len(ws)), n):
        ws[at] = f"x{rng.randrange(10**6)}"
    return ws


def corpus(seed, n, copies):
    """Texts of 60 to 300 words and copies of them with up to 4 percent of the words changed."""
    rng, vocabulary, rows = random.Random(seed), [f"w{i}" for i in range(3000)], []
    for _ in range(n):
        ws = rng.choices(vocabulary, weights=[1 / (i + 5) for i in range(3000)], k=rng.randrange(60, 300))
        rows.append(ws)
        rows += [edited(rng, ws, rng.randrange(0, len(ws) // 25)) for _ in range(rng.randrange(copies + 1))]
    rng.shuffle(rows)
    return [(i, " ".join(ws)) for i, ws in enumerate(rows)]


def test_word_prints_by_bits():
    for text in (None, "", "a", "b a b", " ".join(f"v{i % 700}" for i in range(9000))):
        assert [p & (1 << 64) - 1 for p in simhash.word_prints(text)] == slow_word_prints(text)


def test_alike_documents_against_all_pairs(spark, docs):
    rows = corpus(1, 60, 3) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b"), (None, "one two three four five"), (1004, "one two three four five"), (None, None)]
    df = docs(rows)
    got = simhash.without_alike(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(slow_without_alike(rows), key=repr)
    assert simhash.without_alike(docs([])).count() == 0


def test_recall_and_precision_of_alike_documents(docs):
    rows = corpus(2, 150, 1)
    kept = {r.doc_id for r in simhash.without_alike(docs(rows, extra=False)).collect()}
    pairs = [(i, j) for i, a in rows for j, b in rows if i < j and slow_alike(a, b)]
    assert len(pairs) > 30 and sum(j not in kept for _, j in pairs) >= 0.9 * len(pairs)
    assert {i for i, _ in rows} - kept <= {j for _, j in pairs}


@pytest.mark.parametrize("unlike", [0, 40])
def test_crowded_keys_leave_one_of_each(docs, unlike):
    """Hundreds of near copies in one key, and texts of equal words in another order, which no similarity joins."""
    rng = random.Random(5)
    base = [f"w{i % 190}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, i % 4))) for i in range(150)]
    rows += [(1000 + i, " ".join(rng.sample(base, 300))) for i in range(unlike)]
    got = {r.doc_id for r in simhash.without_alike(docs(rows, extra=False), pairwise=8).collect()}
    assert got == {0, *range(1000, 1000 + unlike)}


def test_unlike_documents_of_one_key_meet_by_rare_shingles_only(spark):
    """120 texts of one vocabulary and a common passage, all within d bits, joined no pairs but those that can be alike."""
    rng = random.Random(6)
    passage, rows = [f"p{i}" for i in range(30)], []
    for i in range(120):
        own = [f"w{i}x{k}" for k in range(60)]
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(passage + edited(rng, own, 1))))
    each = spark.createDataFrame([(i, i, [0, 0, 0]) for i, _ in rows], "no long, key long, fps array<long>")
    texts = spark.createDataFrame(rows, "key long, text string")
    got = {(r.a, r.b) for r in simhash._by_rare_shingles(each.select("no"), each, texts, 5, 0.8, 4).collect()}
    alike = {(i, j) for i, a in rows for j, b in rows if i < j and slow_alike(a, b)}
    assert len(alike) == 12 and alike <= got and len(got) <= 2 * len(alike)
