"""Decontamination, licence scans and secret scans against brute force."""

import random
import re
import time

import pytest

from tonewright.llm import decontaminate, licenses, secret_scan
from tonewright.llm.queries import op6_secrets

TOKEN = re.compile(r"\w+")


def slow_containment(docs, items, least=0.8):
    out = []
    for item_id, text in items:
        ws = TOKEN.findall((text or "").lower())
        own = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        for doc_id, body in docs:
            have = TOKEN.findall((body or "").lower())
            if 0 < len(ws) < 5:
                out += [(doc_id, item_id, 1, 1, 1.0)] if have == ws else []
                continue
            got = {tuple(have[i : i + 5]) for i in range(len(have) - 4)} & own
            if own and len(got) >= least * len(own) - 1e-9:
                out.append((doc_id, item_id, len(own), len(got), len(got) / len(own)))
    return sorted(out, key=repr)


def leaky_table(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=3))
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 5, 6, 20, 60, 150))))) for i in range(60)] + [(None, "nobody knows this item at all"), (31, None), (1, "twice the id"), (90, "the")]
    rows = []
    for d in range(200):
        ws = [word() for _ in range(rng.choice((0, 3, 50, 400, 4000)))]
        body = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.randrange(4)):
            if body:
                body[rng.randrange(len(body)) : rng.choice((None, 1))] and body.insert(rng.randrange(len(body)), word())
        rows.append((d, rng.choice((" ", "\n", ", ")).join(ws + body + [word() for _ in range(20 * (d % 3))])))
    return items, rows + [(None, "Nobody knows, this item; at all!"), (500, None), (501, ""), (3, rows[5][1]), (502, "The"), (503, "the the"), (504, "The twice, the id the")]


@pytest.mark.parametrize("block_chars", [10**6, 200])
def test_containment(spark, docs, block_chars):
    items, rows = leaky_table(block_chars)
    df, bench = docs(rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in decontaminate.contained(df, bench, block_chars=block_chars).collect()), key=repr)
    want = slow_containment(rows, items)
    assert got == want and len(want) > 60
    clean = decontaminate.without_leaks(df, bench)
    leaky = {r[1] for r in rows if slow_containment([r], items)}
    assert clean.columns == df.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(((d, t) for d, t in rows if t not in leaky), key=repr)


def test_recall_of_the_minhash_search():
    """Candidates before verification, of items with a fifth of their shingles lost, in pieces, in long documents."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = [" ".join(word() for _ in range(n)) for n in (5, 6, 7, 9, 12, 17, 24, 33, 40, 65, 90, 129, 200, 400) for _ in range(6)]
    items = []
    for i, t in enumerate(texts):
        hashes = decontaminate.np.unique(decontaminate.shingle_hashes(decontaminate.word_hashes(t), 5))
        u = decontaminate.partition_of(len(hashes))
        items.append((i, t, len(hashes), u, decontaminate.signature(hashes, decontaminate.n_hashes(u, 0.8, decontaminate.MISS)).tobytes()))
    index = decontaminate.Index(items, 5, 0.8)
    docs, due = [], []
    for i, t in enumerate(texts):
        ws = t.split()
        for kind in range(3):
            own = list(ws)
            if kind == 1:  # as many single words changed as leave 80 %
                for k in range(2, len(ws), 26):
                    own[k] = word()
            if kind == 2 and len(ws) > 60:  # in two pieces far from each other
                own[len(ws) // 2 : len(ws) // 2] = [word() for _ in range(700)]
            doc = [word() for _ in range(rng.randrange(3000))] + own + [word() for _ in range(rng.randrange(3000))]
            if slow_containment([(0, " ".join(doc))], [(i, t)]):
                docs.append(doc)
                due.append(i)
    hits = index.candidates([decontaminate.shingle_hashes(decontaminate.word_hashes(" ".join(d)), 5) for d in docs])
    recall = sum(i in h for i, h in zip(due, hits)) / len(due)
    assert len(due) > 180 and recall >= 0.99  # 0.9 is asked for
    others = sum(len(h - {i}) for i, h in zip(due, hits)) / len(due)
    assert others < 1  # few are verified in vain


def test_clean_rows_stay_beside_leaks_of_their_id(spark, docs):
    leak, bench = "so Nobody knows this item, at all", spark.createDataFrame([(1, "nobody knows this item at all")], "item_id long, text string")
    rows = [(None, leak), (None, "clean one"), (None, None), (4, leak), (4, "clean two"), (4, "clean two"), (5, leak)]
    got = decontaminate.without_leaks(docs(rows), bench)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, "clean one"), (None, None), (4, "clean two"), (4, "clean two")], key=repr)


def test_words_by_array_are_those_of_the_pattern(monkeypatch):
    texts = ["", "one", "Ünï_cödé x²½ ٣四 ᾼ", "a.b,c\n\nd--e", "😀e\u0301 \ud800x", "z" * 5000 + " y", " lead and trail "]
    low = [t.lower() for t in texts]
    hashes, counts = decontaminate._words(low)
    words = [w for t in low for w in TOKEN.findall(t)]
    assert counts.tolist() == [len(TOKEN.findall(t)) for t in low] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    long = " ".join(words * 50)
    whole = decontaminate.word_hashes(long)
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 700)
    assert (decontaminate.word_hashes(long) == whole).all() and whole.tolist() == hashes.tolist() * 50


def test_containment_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs([(1, "a b")]), none).count() == 0
    assert decontaminate.contained(docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def slow_license(unit):
    ws = licenses.tokens(unit)
    have, best = set(zip(ws, ws[1:])), None
    for name, text in licenses.TEMPLATES.items():
        t = licenses.tokens(licenses.COPYRIGHT.sub(" ", text))
        grams = set(zip(t, t[1:]))
        dice = 2 * len(have & grams) / (len(have) + len(grams)) if have else 0
        if dice >= licenses.LEAST and (best is None or (-dice, name) < (-best[0], best[1])):
            best = dice, name
    return best


def test_licenses(docs):
    mit = licenses.TEMPLATES["mit"]
    rng = random.Random(2)
    cut = mit.split()
    for _ in range(3):
        cut[rng.randrange(len(cut))] = "word"
    texts = ["Copyright (c) 2020 A\n\n" + mit, " ".join(cut), "prose\nReleased under the MIT License.\nprose", "text\n\n" + licenses.TEMPLATES["isc"] + "\n\n" + " ".join(f"w{i}" for i in range(90)), "Licensed under CC BY-NC 4.0.", None, "", "one", mit * 3, "no licence in here at all"]
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST)
    for text in texts:
        body = licenses.COPYRIGHT.sub(" ", text or "")
        for unit in (body, *re.split(r"\n\s*\n", body), *body.split("\n")):
            got, want = scanner.best(unit), slow_license(unit)
            assert (got and got[:2]) == want
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.license, r.unit, r.unit_no) for r in licenses.scan(docs([*rows, rows[4], (None, texts[4])])).collect()}
    assert got == {(0, "mit", "text", 0), (1, "mit", "text", 0), (2, "mit-line", "line", 1), (3, "isc", "paragraph", 1), (8, "mit", "text", 0), (4, "cc-by-nc-line", "text", 0), (None, "cc-by-nc-line", "text", 0)}
    assert licenses.scan(docs([])).count() == 0 and licenses.scan(docs(rows), {}).count() == 0


def prose(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def slow_windows(text, name):
    """The best Dice of any run of words."""
    ws, t = licenses.tokens(text), licenses.tokens(licenses.TEMPLATES[name])
    grams, pairs = set(zip(t, t[1:])), list(zip(ws, ws[1:]))
    return max((2 * len(grams & set(pairs[i:j])) / (len(grams) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)), default=0)


def test_licenses_that_are_no_unit():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST).scan
    told = lambda text: [(x[0], x[2], x[3]) for x in scan(text)]
    apache, mit = (re.sub(r"\s+", " ", licenses.TEMPLATES[x]) for x in ("apache-2.0", "mit"))
    parts = apache.replace(" You may", "\n\nYou may", 1).replace(" Unless", "\n\nUnless", 1)
    assert parts.count("\n\n") == 2
    assert told(f"{prose('a', 300)}\n\n{parts}\n\n{prose('b', 300)}") == [("apache-2.0", "window", 300)]
    wrapped = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, 200, 9))
    assert told(f"{prose('a', 300)}\n{wrapped}\n{prose('b', 300)}") == [("mit", "window", 300)]
    assert told(prose("a", 40) + " Released under the MIT License. " + prose("b", 40) + " licensed under CC BY 4.0, " + prose("c", 40)) == [("mit-line", "window", 40), ("cc-by-line", "window", 85)]
    assert told(f"{mit} Licensed under CC BY 4.0.") == [("mit", "text", 0), ("cc-by-line", "window", len(licenses.tokens(mit)))]
    assert told(f"{prose('a', 300)} {mit} x {mit} {prose('b', 300)}") == [("mit", "window", 300), ("mit", "window", 301 + len(licenses.tokens(mit)))]


def test_license_windows_are_the_best():
    rng = random.Random(9)
    names = ["mit-line", "cc-by-sa", "cc-by", "mpl-2.0"]
    for _ in range(60):
        name = rng.choice(names)
        ws = licenses.tokens(licenses.TEMPLATES[name])
        for _ in range(rng.randrange(5)):
            ws.insert(rng.randrange(len(ws)), rng.choice(["x", "the", "license", ws[0]]))
        text = " ".join([*rng.choices(ws, k=15), *ws, *rng.choices(ws, k=15)])
        scanner = licenses.Scanner({name: licenses.TEMPLATES[name]}, licenses.LEAST)
        got = max((x[1] for x in scanner.windows([(licenses.tokens(text), list(range(400)))], [])), default=0)
        want = slow_windows(text, name)
        assert bool(got) == (want >= licenses.LEAST) and got <= want
        assert bool(scanner.scan(text)) == bool(got)


def test_licenses_after_copyright_notices():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST).scan
    told = lambda text: [x[0] for x in scan(text)]
    mit, bsd = (re.sub(r"\s+", " ", licenses.TEMPLATES[x]) for x in ("mit", "bsd-2-clause"))
    assert told("Copyright 2020 Foo. Licensed under the Apache License, Version 2.0.") == ["apache-2.0-line"]
    assert told(f"{prose('a', 9)}\n// Copyright (c) 2021 X. Released under the MIT License.\n{prose('b', 9)}") == ["mit-line"]
    assert told(f"Copyright (c) 2020 A {mit} {prose('a', 300)}") == ["mit"]
    assert told(bsd.replace("above copyright notice", "above\ncopyright notice")) == ["bsd-2-clause"]
    assert told(f"{mit[:300]}\n(c) 2020 {prose('a', 90)}\n© 2021 {prose('b', 90)}\n{mit[300:]}") == ["mit"]


def slow_scan(text):
    """Units by the definition; windows as the best from each bigram of a template, found by sets, then those that don't overlap by their order."""
    grams = {n: set(zip(t, t[1:])) for n, x in licenses.TEMPLATES.items() for t in [licenses.tokens(licenses.COPYRIGHT.sub(" ", x))]}
    body, found, told, seen = licenses.COPYRIGHT.sub(" ", text), [], [], {}
    for kind, units in (("text", [body]), ("paragraph", re.split(r"\n\s*\n", body)), ("line", body.split("\n"))):
        at = 0
        for no, unit in enumerate(units):
            n = len(licenses.tokens(unit))
            if hit := slow_license(unit):
                told.append((at, at + n, hit[1]))
                if seen.setdefault(" ".join(unit.split()), kind) == kind:
                    found.append((hit[1], hit[0], kind, no, n))
            at += n
    ws = licenses.tokens(body)
    pairs, hits = list(zip(ws, ws[1:])), []
    for name, own in grams.items():
        if any((0, len(ws), name) == x for x in told):
            continue
        best = []
        for i, p in enumerate(pairs):
            if p not in own:
                continue
            stop = next((j for j in range(i + 1, len(pairs)) if pairs[j] == p), len(pairs))
            tops = [(2 * len(set(pairs[i:j]) & own) / (len(set(pairs[i:j])) + len(own)), -j) for j in range(i + 1, stop + 1)]
            dice, j = max(tops)
            if dice >= licenses.LEAST:
                best.append((3 * len(set(pairs[i:-j]) & own) - len(set(pairs[i:-j])) - len(own), i, -j - 1, dice))
        apart = []
        for score, i, j, dice in sorted(best, key=lambda x: (-x[0], x[1])):
            if all(j + 1 < a or b + 1 < i for _, a, b, _ in apart):
                apart.append((score, i, j, dice))
        hits += [(-s, name, i, j + 2, d, set(pairs[i : j + 1]) & own) for s, i, j, d in apart]
    told = list(told)
    windows = []
    for _, name, start, end, dice, shared in sorted(hits, key=lambda x: x[:4]):
        if not any(a < end and start < b and (name == x or 2 * len(shared & grams[x]) >= len(shared)) for a, b, x in told):
            told.append((start, end, name))
            windows.append((name, dice, "window", start, end - start))
    return found + sorted(windows, key=lambda x: x[3:])


def test_scan_against_brute_force():
    rng, scanner = random.Random(5), licenses.Scanner(licenses.TEMPLATES, licenses.LEAST)
    names, total = ["mit-line", "cc-by-sa", "cc-by", "mpl-2.0", "gpl-2-line", "lgpl-line", "cc0", "epl-2.0", "agpl-line", "cc-by-nd"], 0
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            ws = licenses.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randrange(3)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["x", "the", "license"]))
            parts += [" ".join(ws), prose("a", rng.randrange(12))]
        text = rng.choice((" ", "\n", "\n\n")).join(parts)
        assert scanner.scan(text) == slow_scan(text)
        total += len(slow_scan(text))
    assert total > 40


def test_every_template_is_told_by_name():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST).scan
    for name, text in licenses.TEMPLATES.items():
        assert (name, "text") in [(x[0], x[2]) for x in scan(text)]


@pytest.mark.parametrize("mark", ["Copyright (c) 2020 A", "(c) 2020 A Corp", "© 2020 A Corp", "// (C) me", " * Copyright 1999"])
def test_copyright_lines_are_left_out(mark):
    assert licenses.COPYRIGHT.sub("", mark) == "" and licenses.COPYRIGHT.sub("", "x\n" + mark + "\ny") == "x\n\ny"


@pytest.mark.parametrize("unit", ["\n", "-\n", "-" * 40 + "\n", "\n   ", "word\n", "(c) x\n", "the license of software ", "Copyright\n"])
def test_long_texts_are_scanned_in_linear_time(unit):
    scan, text = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST).scan, unit * (1_000_000 // len(unit))
    began = time.process_time()
    scan(text)
    assert time.process_time() - began < 5  # well under one second on a free core; quadratic time would be minutes


# Secrets


def slow_spans(text):
    out = []
    for k, r in enumerate(secret_scan.BASE + secret_scan.MORE):
        pattern = r"[0-9a-f]+" if r.kind == "hex" else r.pattern
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def secret_texts():
    rng = random.Random(6)
    pieces = ["password=abcdef1", "token: token: abcdefgh", "secret='x", "API_KEY = \"aB/+9_.=-zz\"", "apikey:12345", "AKIA" + "A1" * 9, "AKIAX", "deadbeef" * 3, "deadbeef" * 2, "ä😀ö", "passwd=ÄÖ", "token==abcdef", "tok en", "secret\n=\nabcdef", "ghp_" + "a" * 36, "xoxb-1234567890-ab", "AIza" + "b" * 35, "sk_live_" + "c" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJ9.eyJzdWIiOiIx.abcdefghij", "Secret:" + "f" * 30]
    return [None, "", *[" ".join(rng.choices(pieces, k=k)) for k in range(40)], *pieces, "token=abcdef " * 1500]


def test_secrets(docs):
    rows = list(enumerate(secret_texts()))
    rows += [(None, "password=abcdef1"), rows[10], rows[10]]
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.spans(docs(rows)).collect()), key=repr)
    assert got == sorted(((d, slow_spans(t)) for d, t in rows), key=repr)
    assert secret_scan.spans(docs([])).count() == 0


def holds(query, grams):
    if query is True or isinstance(query, str):
        return query is True or query in grams
    return (all if query[0] == "and" else any)(holds(q, grams) for q in query[1])


def test_trigram_queries_are_necessary():
    for rule in secret_scan.BASE + secret_scan.MORE:
        query = secret_scan.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex")
        for text in secret_texts():
            low = (text or "").lower()
            if re.search(rule.pattern, text or ""):
                assert holds(query, {low[i : i + 3] for i in range(len(low) - 2)})
    assert secret_scan.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secret_scan.trigram_query("abc|xyz") == ("or", ("abc", "xyz"))
    assert secret_scan.trigram_query("(abc)*") is True and secret_scan.trigram_query("(abc)+x") == "abc"
    assert secret_scan.trigram_query("a[bc]d") == ("or", ("abd", "acd"))


def test_secret_query_is_native(spark):
    plan = op6_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
