"""Line dedup against brute force."""

import random

import pytest

from tonewright.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, hashes, edits=1):
    """(text, lines, exact, near) of each row, in order."""
    first = {}
    for doc_id, text in set(rows):
        for no, line in enumerate((text or "").split("\n")):
            if s := line.strip(BLANK):
                place = (doc_id is None, doc_id or 0, hashes[text], no)
                first[s] = min(first.get(s, place), place)
    out = []
    for doc_id, text in rows:
        keep, n, exact, close = [], 0, 0, 0
        for no, line in enumerate((text or "").split("\n")):
            s = line.strip(BLANK)
            place = (doc_id is None, doc_id or 0, hashes[text], no)
            n += bool(s)
            if s and first[s] != place:
                exact += 1
            elif s and edits and any(first[o] < place and o != s and near(o, s) for o in first):
                close += 1
            else:
                keep.append(line)
        out.append(("\n".join(keep) if exact + close else text, n, exact, close))
    return out


def table(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(k)).strip() + "x" for k in (0, 1, 3, 10, 15, 16, 17, 20, 30, 31, 40, 41, 60, 100)]

    def edited(s):
        i, kind, c = rng.randrange(len(s) + 1), rng.randrange(3), rng.choice("abcdéf😀")
        return s[:i] + c + s[i:] if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + c + s[i + 1 :]

    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                s = edited(s)
            lines.append(rng.choice(("", " ", "\t")) + s + rng.choice(("", "  ")))
        rows.append((None if d % 9 == 0 else d // 2, None if d % 11 == 5 else "\n".join(lines + [""] * (d % 3 == 0))))
    return rows + rows[:4] + [(1000, ""), (1001, " \n\t\n")]


@pytest.mark.parametrize("window", [256, 8])
def test_against_brute_force(docs, monkeypatch, window):
    """Windows of 8 take several passes."""
    monkeypatch.setattr(line_dedup, "WINDOW", window)
    rows = table(window, 120)
    df = docs(rows)
    hashes = {r.text: r.x for r in df.selectExpr("text", "xxhash64(text) AS x").distinct().collect()}
    same = {(r.text, r._lines, r._exact) for r in line_dedup.dedup_lines(df, edits=0).collect() if not r._near}
    assert {(t, n, e) for t, n, e, c in expected(rows, hashes) if not c} <= same and len(same) == len({(e[0], e[1], e[2]) for e in expected(rows, hashes, 0)})
    got = sorted(((r.doc_id, r.text, r._lines, r._exact, r._near) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    want = sorted(((d, *e) for (d, _), e in zip(rows, expected(rows, hashes), strict=True)), key=repr)
    assert got == want and sum(w[4] for w in want) > 5


def test_long_lines_and_columns(docs):
    long = "".join(chr(97 + i * i % 23) for i in range(5000))
    rows = [(1, long), (2, long[:2500] + "#" + long[2501:]), (3, long[:700] + long[701:]), (4, long[:10] + "##" + long[12:])]
    df = docs(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: long, 2: "", 3: "", 4: rows[3][1]}
    stage = line_dedup.corpus_without_repeats(df)
    assert stage.columns == df.columns and sorted(r.doc_id for r in stage.collect()) == [1, 4]


def test_stage_keeps_empty_documents_and_counts_characters(docs):
    df = docs([(1, "same line here and now\nown"), (2, "same line here and now\nother"), (3, "same line here and now"), (4, ""), (5, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.corpus_without_repeats(df).collect()}
    assert got == {1: ("same line here and now\nown", 26), 2: ("other", 5), 4: ("", 0), 5: (None, 0)}


def test_empty(docs):
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_no_python(docs):
    plan = line_dedup.dedup_lines(docs([(1, "a line that is long enough"), (2, "a line that is long enouGh")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_user_columns_are_kept(docs):
    df = docs([(1, "one line of a text\nand its own"), (2, "one line of a text\nand another one"), (None, "one line of a text"), (None, "unlike the rest")])
    got = line_dedup.dedup_lines(df.withColumnRenamed("near", "_exact")).collect()
    assert {(r.doc_id, r.text, r.first, r._key, r._ls, r._exact, r._exact_, r["a.b"].text, r.tags["a"]) for r in got} == {
        (d, t, "first", "_key", "_ls", "near", n, 7, d) for d, t, n in ((1, "one line of a text\nand its own", 0), (2, "and another one", 1), (None, "", 1), (None, "unlike the rest", 0))
    }
