"""Ranked search, edit fingerprints and alignment of tokens against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tonewright.llm import alignment, edit_print, lexical
from tonewright.llm.storage import settled

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOKENIZERS = "/opt/tokenizers"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k=20):
    """Every item against every document."""
    words = [(d, TERM.findall(lowered(t))) for d, t in docs]
    full = [(d, Counter(w), len(w)) for d, w in words if w]
    n, total = len(full), sum(x[2] for x in full)
    df = Counter(t for _, c, _ in full for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in full:
            m = 100 - 25 + 25 * size * n // total
            s = 0
            for t in TERM.findall(lowered(text)):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_against_every_pair(spark, docs):
    draw = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "é", "ÉÉ", "x1", "日本", "it's", "a_b", "Ω"]
    text = lambda: " ".join(draw.choices(vocabulary, [8, 5, 3, 2, 1, 1, 1, 1, 1, 1], k=draw.randint(0, 30)))
    rows = [(k, text()) for k in range(120)] + [(3, "alpha x1"), (None, "alpha x1"), (None, "gamma"), (500, None), (501, ""), (502, " .,;! "), (7, "Beta " * 9)]
    rows += [(600 + k, "gamma é") for k in range(40)]
    items = [(1, "alpha BETA beta x1"), (2, "é gamma ÉÉ"), (2, "it's a_b"), (3, None), (4, "..."), (None, "日本 nowhere"), (5, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc", "1 AS term", "2 AS bucket")
    assert found(lexical.search(lexical.postings(docs(rows)), asked)) == ranked(rows, items)
    few = lexical.search(lexical.postings(docs(rows), buckets=3), asked, k=2, buckets=3, spread=1)
    assert found(few) == ranked(rows, items, 2)


def test_search_of_nothing_and_of_long_texts(spark, docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert found(lexical.search(lexical.postings(docs([])), items)) == []
    assert found(lexical.search(lexical.postings(docs([(1, "word")])), items.limit(0))) == []
    rows = [(1, "other " * 400_000 + "word"), (2, "word"), (3, "x" * 3_000_000), (4, "z"), (5, "z")]
    assert found(lexical.search(lexical.postings(docs(rows)), items)) == ranked(rows, [(1, "word")])


def test_search_in_a_written_index(spark, docs, tmp_path):
    rows = [(k, f"word{k % 7} common more{k}") for k in range(200)]
    items = spark.createDataFrame([(1, "word3 common"), (2, "more9")], "item_id long, text string")
    lexical.write_index(docs(rows), f"file://{tmp_path}/index", buckets=8)
    index = spark.read.parquet(f"file://{tmp_path}/index")
    assert index.filter("term <> ''").count() == 600
    assert found(lexical.search(index, items, buckets=8)) == ranked(rows, [(1, "word3 common"), (2, "more9")])


# Edit fingerprints


def slow_print(text):
    """The walk step by step, with the steps of all lanes looked up at the end."""
    heads = np.random.default_rng(edit_print.SEED).random((edit_print.PERIOD, edit_print.CLASSES)) < 0.5
    seen, at = [], 0
    while at < len(text):
        mixed = ord(text[at]) * 2654435761 & 0xFFFFFFFF
        mixed ^= mixed >> 15
        seen.append(mixed)
        at += int(heads[(len(seen) - 1) % edit_print.PERIOD, mixed % edit_print.CLASSES])
    places, lanes = edit_print._places(edit_print.SEED)
    salts = edit_print._salts(edit_print.SEED)
    out = np.zeros(edit_print.LANES, np.uint8)
    for lane in range(edit_print.LANES):
        own = [p for p in places[lanes == lane].tolist() if p < len(seen)]
        if own:
            out[lane] = (seen[own[-1]] * int(salts[lane]) & 0xFFFFFFFF) >> 28
    return out


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa" * 50, "naïve 日本語 🎧 " * 40, "".join(random.Random(1).choices("abcdefgh ", k=6000))])
def test_the_walk_by_automaton_is_the_walk_step_by_step(text, monkeypatch):
    assert (edit_print.fingerprint(text) == slow_print(text)).all()
    monkeypatch.setattr(edit_print, "PIECE", 7)
    assert (edit_print.fingerprint(text) == slow_print(text)).all()


def slow_neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        p, q, r = (edit_print.fingerprint(x) for x in (t, e, after))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), edit_print.as_hex(p), edit_print.as_hex(q), float((p == q).mean()), float((p == r).mean())))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_neighbours_in_descending_order(docs):
    draw = random.Random(5)
    rows = [(k * 7 % 1009, "".join(draw.choices("abc de", k=draw.randint(0, 80)))) for k in range(300)] + [(2000, None), (2001, ""), (2002, "é" * 10), (None, "last of all")]
    for blocks in (1, 5, 64):
        got = edit_print.neighbours(docs(rows), blocks).select(*NAMES)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_neighbours(rows)


def test_neighbours_of_repeated_rows_of_one_and_of_none(docs):
    one = edit_print.neighbours(docs([(4, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_edited < 1 and one[0].near_next == 1
    assert edit_print.neighbours(docs([])).collect() == []
    # A third of all rows is one row: they follow each other, in any number of ranges.
    rows = [(9, "the same text again")] * 50 + [(k, f"text {k}") for k in range(10, 110)]
    got = edit_print.neighbours(docs(rows).repartition(7), 16).filter("doc_id = 9").collect()
    assert len(got) == 50 and len({r.fingerprint for r in got}) == 1 and sum(r.near_next == 1 for r in got) == 49


def test_long_texts_walk_to_their_end():
    draw = random.Random(2)
    text = "".join(draw.choices("abcdefghij ", k=1_500_000))
    whole, cut, tail = (edit_print.fingerprint(x) for x in (text, text[:750_000], text[:-1] + "X"))
    assert 0.4 < edit_print.likeness(whole, cut) < 0.75 and edit_print.likeness(whole, tail) > 0.9
    assert edit_print.likeness(whole, edit_print.fingerprint(text[::-1])) < 0.3


def test_edited_texts_stay_near_and_others_do_not(spark):
    from tonewright.llm.text import table

    got = edit_print.neighbours(table(spark, "/root/testdata/sf0.001", "documents")).filter("n_chars >= 30").toPandas()
    assert (got.near_edited > 0.55).mean() > 0.99 and got.near_edited.median() > 0.68
    assert (got.near_next[got.near_next < 1] < 0.4).mean() > 0.97
    assert (got.shared_bands > 0).mean() > 0.9


def test_near_pairs_lose_no_alike_pair_of_a_crowd(spark):
    base = edit_print.fingerprint("a base text to be changed " * 20)
    draw = np.random.default_rng(4)
    all_ = []
    for _ in range(150):
        p = base.copy()
        p[draw.choice(edit_print.LANES, 6, replace=False)] = draw.integers(0, 16, 6)
        all_.append(p)
    texts = sorted({edit_print.as_hex(p) for p in all_})
    df = spark.createDataFrame([(t,) for t in texts * 2], "fingerprint string")
    got = {(r.a, r.b): r.likeness for r in edit_print.near_pairs(df, 0.85, crowd=16).collect()}
    digits = {t: np.array(list(t)) for t in texts}
    want = {(x, y): float((digits[x] == digits[y]).mean()) for x in texts for y in texts if x < y and (digits[x] == digits[y]).mean() >= 0.85}
    assert got == want and len(want) > 5000


def test_near_documents_are_verified_by_edit_distance(docs):
    draw = random.Random(8)
    text = lambda: "".join(draw.choices("abcdefghijklmnop ", k=600))
    rows = [(k, text()) for k in range(60)]
    planted = []
    for k in range(20):
        own = list(rows[k][1])
        for _ in range(6):
            own[draw.randrange(len(own))] = "#"
        del own[draw.randrange(len(own))]
        planted.append((k, 1000 + k))
        rows.append((1000 + k, "".join(own)))
    rows += [(2000, rows[0][1]), (2001, None), (2002, "")]
    pairs, members = edit_print.near_documents(docs(rows))
    of = {r.doc_id: r["class"] for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert of[0] == of[2000] and of[2001] == of[2002]
    hit = sum(frozenset((of[a], of[b])) in got for a, b in planted)
    assert hit >= 18 and len(got) == hit


# Alignment


def tables():
    from tokenizers import Tokenizer

    import sentencepiece

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")


def slow_alignment(rows):
    """Whole texts through both tokenizers, token by token."""
    a, b = tables()
    letters = alignment._byte_letters()
    names = {k: t for t, k in a.get_vocab().items()}
    told, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(letters[c] for c in names[k]) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xb) != b" " + text.encode() or b"".join(yb) != b" " + text.encode():
            told.append((doc_id, [], [], [], ""))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(xb), ends(yb)
        links, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            step_a, step_b = ea[i] <= eb[j], eb[j] <= ea[i]
            i, j = i + step_a, j + step_b
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            k, m = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        told.append((doc_id, x, y, links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (d, len(x), len(y), g.count(";") + 1 if g else 0, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for d, x, y, ls, g in told
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", "plain words here", " leading and trailing ", "two  spaces", "tab\there", "a b c d", "日本語 text", "🎧 emoji 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ lower one eighth ▁", "x ▁y", "it's we'll 1234 5,678", "é é", "\x00\x1f \x1c a \x85 b", "ﬁ ligature ½", "﷽", "​ zero", " 　 x", "a\r\n b", "..." * 30, "a b" * 40, " \n \n x",
]


def test_alignment_of_odd_texts_in_blocks_of_any_size(spark, docs):
    draw = random.Random(11)
    pool = "ab cé日\n\t .,'19🎧▁   "
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "".join(draw.choices(pool, k=draw.randint(1, 60)))) for k in range(150)]
    rows += [(7, "repeated id"), (5, ODD[5]), (None, "no id"), (None, None)]
    want = slow_alignment(rows)
    for size in (1, 300, 10**6):
        got = alignment.alignment(docs(rows), alignment.pair_of(TOKENIZERS), size).select(*COLUMNS)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_alignment_of_documents(spark):
    from tonewright.llm.text import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("n_chars < 3000")
    want = slow_alignment([(r.doc_id, r.text) for r in docs.collect()])
    got = alignment.alignment(docs, alignment.pair_of(TOKENIZERS), 100_000).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_alignment_of_nothing_and_of_long_texts(docs):
    assert alignment.alignment(docs([]), alignment.pair_of(TOKENIZERS)).collect() == []
    rows = [(1, "word and more " * 60_000), (2, " " * 60_000 + "x"), (3, "y" * 40_000), (4, "\n" * 30_000)]
    got = {r.doc_id: r for r in alignment.alignment(docs(rows), alignment.pair_of(TOKENIZERS)).collect()}
    assert got[1].n_links >= got[1].n_groups >= 180_000 and all(got[k].n_a > 0 for k in (2, 3, 4))
    assert slow_alignment(rows[1:])[0][1] == got[2].n_a


def test_blocks_hold_each_pair_once(docs):
    blocks = settled(alignment.encoded(docs([(k, "the same words again") for k in range(90)]).coalesce(1), alignment.pair_of(TOKENIZERS), 500), "blocks")
    rows = blocks.collect()
    assert len(rows) > 1 and all(len(set(r.pairs)) == len(r.pairs) for r in rows)
    assert sum(sum(r.linked) for r in rows) == sum(sum(r.n_links) for r in rows)
