"""Mixing, chat, archives, quality rules and toxicity."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tonewright.llm import chat, mixing, quality, toxicity, warc
from tonewright.llm.storage import fresh
from tonewright.llm.text import row_key

# Mixing


def slow_targets(sizes):
    """By filling step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = {s for s in open_ if target[s] + share[s] >= 3 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share[s]
            break
        for s in full:
            left -= 3 * sizes[s] - target[s]
            target[s] = float(3 * sizes[s])
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(docs, seed):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "c", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 50, 200)))), "en", rng.choices(names, [50, 5, 5, 5, 3, 3, 1])[0], 0) for i in range(400)]
    rows += [(400, None, "en", "void", 0), rows[3], rows[3], (None, "x y", "en", "a", 0)]
    sizes, total = {}, 0
    for r in rows:
        n = len((r[1] or "").split())
        sizes[r[3]] = sizes.get(r[3], 0) + n
        total += n
    got = mixing.schedule(docs(rows)).collect()
    again = mixing.schedule(docs(rows).repartition(5)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    want = slow_targets(sizes)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    source = {i: s for i, _, _, s, _ in rows}
    for r in got:
        s = source[r.doc_id]
        assert math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[s]
        by_source[s] = by_source.get(s, 0) + r.taken
    assert sum(by_source.values()) <= total
    for s, taken in by_source.items():
        assert abs(taken - want[s]) <= 200 * 2


def test_mix_of_documents(docs):
    df = docs([(i, "w " * (i % 7), "en", "ab"[i % 2], 0) for i in range(50)])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copies_", "start_"] and all(1 <= r.copies_ <= 3 and r.copies == "copies" for r in out.collect())
    plain = df.select("doc_id", "text", "source")
    assert mixing.mix(plain).columns == [*plain.columns, "copies", "start"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix(docs([])).count() == 0 and mixing.schedule(docs([])).count() == 0
    assert [r.taken for r in mixing.schedule(docs([(1, None), (2, "")])).collect()] == [0, 0]


# Chat


def slow_chat(turns):
    order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    out = {}
    for who in dict.fromkeys(t[1] for t in order if t[1] != "system"):
        text, mask = "", []
        for _, role, body in order:
            name = re.sub(r"[^\w-]", "_", role)
            text += f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == who else 'user name=' + name}\n"
            start = len(text)
            text += body + "<|im_end|>"
            if role == who:
                mask.append((start, len(text)))
            text += "\n"
        out[who] = text, mask
    return out


def test_perspectives(spark):
    talk = {1: [(0, "system", "be kind"), (1, "ann b", "hi 😀"), (2, "bob", "yes\nno"), (2, "bob", "yes\nno"), (None, "ann b", "first"), (3, "cé", "")], 2: [(0, "system", "alone")], 3: [(k, "user" if k % 2 else "assistant", "t" * k) for k in range(700)]}
    rows = [(c, t, r, x, 9) for c, turns in talk.items() for t, r, x in turns] + [(4, 1, None, None, 9), (4, 2, " ", "a <|im_end|> b <|im_start|>", 9), (None, 1, "x", "y", 9), (None, 1, "x", "y", 9), (None, 2, "z", "y", 9)]
    talk[4] = [(1, "unknown", ""), (2, "unknown", "a < |im_end|> b < |im_start|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker int")
    rows = chat.perspectives(df).collect()
    assert sorted((r.speaker, r.text) for r in rows if r.conv_id is None) == sorted((w, x[0]) for w in "xxz" for x in slow_chat([(1, w, "y")]).values())
    got = {(r.conv_id, r.speaker): (r.text, [tuple(m) for m in r["mask"]]) for r in rows if r.conv_id is not None}
    assert got == {(c, who): x for c, turns in talk.items() for who, x in slow_chat(turns).items()}
    plan = chat.perspectives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.perspectives(df.limit(0)).count() == 0


# Archives


def test_archive(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (5, "http://b", big), (None, "u", other), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.archive(spark, pages).collect()), key=repr)
    last = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, p), p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h) if len(raw) >= 1000 else None
        again = to is not None and p != to
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive(spark, pages.limit(0)).count() == 0


def test_bundles_are_read_in_parallel(spark):
    rows = [(i, "u", f"{i} " * 400) for i in range(64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, fresh(spark, "many"), bundle_bytes=4000)
    bundles = index.select("bundle").distinct().count()
    read = warc.read_bundles(index).selectExpr("page_id", "spark_partition_id() AS task").collect()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert bundles >= 16 and len({r.task for r in read}) == bundles and len(read) == 64


def test_single_records_by_seek(spark):
    rows = [(i, f"http://{i}", random.Random(i).choice(("ab", "cd")) * (i * 37 % 900)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, fresh(spark, "one"), bundle_bytes=20_000, frame_bytes=3000)
    places = index.collect()
    assert len(places) == 60 and len({p.bundle for p in places}) > 2 and max(p.frame for p in places) > 1
    for p in places:
        head, block = warc.read_record(p)
        payload = block.partition(b"\r\n\r\n")[2]
        html = rows[p.page_id][2].encode()
        assert head["x-page-id"] == str(p.page_id) and (head["warc-type"] == "revisit" or payload == html)
    assert {tuple(r) for r in warc.read_bundles(index).select("page_id", "payload_bytes").collect()} == {(i, len(h.encode())) for i, _, h in rows}
    with open(places[0].bundle.removeprefix("file://"), "rb") as f:
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert sum(1 for _ in warc.parse(raw)) == sum(p.bundle == places[0].bundle for p in places)


# Quality


def slow_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = {t: three.count(t) for t in set(three)}
    in_repeat = {j for i, t in enumerate(three) if seen[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(in_repeat)


def test_counts(docs):
    rng = random.Random(8)
    texts = [None, "", " \n\x0b", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\n\nx y z", "ä#*$%&|<>😀 \x1c z", *[" ".join(rng.choices(["a", "b", "cc", "dé", "\n"], k=rng.randrange(80))) for _ in range(60)]]
    got = quality.counts(docs(list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: slow_counts(t) for i, t in enumerate(texts)}


def slow_mcd(x, share=0.75):
    """Many random starts; the subset of least determinant of the floored scatter."""
    rng, floor, best = np.random.default_rng(0), np.diag(np.square(quality.FLOORS)), None
    h = math.ceil(share * len(x))
    for _ in range(60):
        own = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(30):
            m, c = own.mean(0), np.cov(own.T, bias=True) * quality.CONSISTENCY + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d)[:h]]
        det = np.linalg.slogdet(np.cov(own.T, bias=True) * quality.CONSISTENCY + floor)[1]
        if best is None or det < best[0]:
            best = det, own
    own = best[1]
    m, c = own.mean(0), np.cov(own.T, bias=True) * quality.CONSISTENCY + floor
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    own = x[d <= quality.REWEIGHT_AT]
    return own.mean(0), np.cov(own.T, bias=True) * quality.REWEIGHT_BY + floor


def test_robust_estimates_match_a_search(spark):
    rng = np.random.default_rng(4)
    good = rng.multivariate_normal([6, 1.6, 0, 0.3, 0.02], np.diag([0.5, 0.01, 0.002, 0.05, 0.001]) + 0.0005, 400)
    bad = rng.normal([6, 2.2, 0.6, 0.3, 0.4], 0.05, (90, 5))
    x = np.concatenate([good, bad])
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "g long, x0 double, x1 double, x2 double, x3 double, x4 double")
    row = quality.estimates(df).first()
    m, c = slow_mcd(x)
    assert np.allclose(row.m, m, atol=0.05)
    k = np.zeros((5, 5))
    k[np.tril_indices(5)] = row.k
    ours = np.einsum("ij,ij->i", (x - row.m) @ k.T, (x - row.m) @ k.T)
    theirs = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert np.corrcoef(ours, theirs)[0, 1] > 0.99 and ((ours > quality.CUTOFF) == (theirs > quality.CUTOFF)).mean() > 0.98
    assert (ours[400:] > quality.CUTOFF).mean() > 0.95 and (ours[:400] <= quality.CUTOFF).mean() > 0.99


def test_verdicts_match_a_search(docs):
    """The same verdicts as exact quantiles from many starts, for every document that isn't near the cutoff."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    rows = []
    for i in range(420):
        lang, source = ("en", "a") if i < 200 else ("en", None) if i < 320 else (None, "b")
        ws = [word(rng.choice((2, 4, 6, 9))) for _ in range(rng.choice((70, 120, 300)))]
        odd = i % 12
        if odd == 0:
            ws = [w + "%%" for w in ws]
        if odd == 1:
            ws = [w * 4 for w in ws]
        if odd == 2:
            ws += ["and so", "on it", "goes"] * 9
        rows.append((i, "\n".join(" ".join(ws[k : k + 8]) for k in range(0, len(ws), 8)), lang, source, 0))
    got = {r.doc_id: r for r in quality.verdicts(docs(rows)).collect()}
    wrong = near = gone = 0
    for group in ({i for i, *_ in rows[:200]}, {i for i, *_ in rows[200:320]}, {i for i, *_ in rows[320:]}):
        own = sorted(i for i in group if not got[i].base_failed)
        c = np.array([slow_counts(rows[i][1]) for i in own], float)
        n, chars = c[:, 0], c[:, 1]
        x = np.column_stack([np.log1p(n), np.log(chars / n), np.sqrt(c[:, 2] / chars), np.log1p(c[:, 3]), c[:, 4] / n])
        m, s = slow_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        for i, far in zip(own, d, strict=True):
            close = 0.6 < far / quality.CUTOFF < 1.7
            near += close
            gone += not got[i].kept
            wrong += got[i].kept != (far <= quality.CUTOFF) and not close
    assert wrong == 0 and near < 25 and gone > 40


def test_nulls_in_other_columns_have_verdicts_of_their_own(docs):
    """lang and source swapped about a null don't share a verdict."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", None, 0), (1, text, None, "en", 0), (1, None, "en", None, 0)]
    keys = {tuple(r.k) for r in docs(rows).select(row_key("doc_id", "text", "lang", "source").alias("k")).collect()}
    assert len(keys) == 3


def test_verdicts(docs):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.choice((2, 4, 6, 9)))) for _ in range(n))
    rows = [(i, prose(rng.choice((80, 150, 300))), "en", "s" if i % 9 else None, 0) for i in range(300)]
    rows += [(900, " ".join(w + "%%%" for w in prose(200).split()), "en", "s", 0), (901, "short", "en", "s", 0), (902, "a b c " * 100, "en", "s", 0), (903, None, None, None, 0), (904, prose(100), "xx", "only", 0), rows[0], rows[0]]
    got = {r.doc_id: r for r in quality.verdicts(docs(rows)).collect()}
    assert not got[900].kept and not got[900].base_failed
    assert [got[k].base_failed for k in (901, 902, 903, 904)] == [True, True, True, False] and got[904].kept
    assert sum(got[i].kept for i in range(300)) >= 297
    kept = quality.keep_good(docs(rows))
    assert kept.columns == docs([]).columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows if got[i].kept)
    assert quality.keep_good(docs([])).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Toxicity


def toxic_rows(n=400):
    rng = random.Random(7)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        ws = rng.choices(clean, k=rng.randrange(20, 120)) + (rng.choices(["vile", "scum", "filth"], k=4) if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i for i, t in rows if re.search("vile|scum|filth", t)}


def test_toxicity_on_held_out_documents(spark, docs):
    rows, labels, bad = toxic_rows()
    rows += [(1000, None), (1001, ""), rows[0], (None, "vile scum filth vile")]
    labels += [(5, 1, None), (None, 1, 1)]
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, known)).collect()}
    assert set(got) == {r[0] for r in rows} and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    held = [i for i, _ in rows if i is not None and i < 400 and toxicity.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i in bad) for i in held]) >= 0.97


def test_held_out_labels_are_not_read(spark, docs):
    rows, labels, _ = toxic_rows()
    df = docs(rows)
    model = lambda x: toxicity.train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))
    changed = [(i, q, 1 - t if toxicity.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert model(labels) == model(changed)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs([(1, "a"), (2, None)])
    assert [r.score for r in toxicity.score(df, toxicity.train(df, none)).collect()] == [0, 0]
    assert toxicity.score(docs([]), toxicity.train(docs([]), none)).count() == 0


def test_risk_against_plain_loops():
    """The risk and its gradient, by the definition and by differences."""
    rng = np.random.default_rng(3)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):  # the second one drives the negative part below zero
        zp, zu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 11)
        loss = lambda z, y: math.log1p(math.exp(-y * z))
        negative = lambda p, u: sum(loss(z, -1) for z in u) / len(u) - prior * sum(loss(z, -1) for z in p) / len(p)
        whole = lambda p, u: prior * sum(loss(z, 1) for z in p) / len(p) + negative(p, u)
        got, gp, gu = toxicity.risk(zp, zu, prior)
        assert math.isclose(got, negative(zp, zu), rel_tol=1e-9) and (got < 0) == (shift > 0)
        aim = (lambda p, u: -0.5 * negative(p, u)) if got < 0 else whole
        for g, which in ((gp, 0), (gu, 1)):
            for k in range(len(g)):
                step = [zp.copy(), zu.copy()]
                step[which][k] += 1e-6
                assert math.isclose(g[k], (aim(*step) - aim(zp, zu)) / 1e-6, abs_tol=1e-5)


def test_training_is_bounded_by_words(spark, docs):
    rows, labels, _ = toxic_rows()
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.train(df, known, most_words=2000) != toxicity.train(df, known) == toxicity.train(df, known, most_words=10**7)


def test_toxicity_sample_takes_an_id_once_and_goes_on_behind_a_huge_document(spark, docs):
    rows, labels, bad = toxic_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = toxicity.train(docs(rows, extra=False), known, most_unlabelled=200)
    first = min((i for i, _ in rows if i is not None and toxicity.crc32(str(i).encode()) % 5), key=lambda i: (-signed_hash(spark, i), i))
    text = dict(rows)[first]
    again = docs(rows, extra=False).unionByName(docs([(first, text)], extra=False).crossJoin(spark.range(20_000)).drop("id"))
    assert toxicity.train(again, known, most_unlabelled=200) == want
    # A document above the bound on words is left out, not all that come behind it.
    huge = docs([(i, " ".join(f"w{k}" for k in range(60_000)) if i == first else t) for i, t in rows], extra=False)
    without = docs([(i, t) for i, t in rows if i != first], extra=False)
    got = toxicity.train(huge, known, most_words=50_000)
    assert len(got[0]) > 0 and got == toxicity.train(without, known.filter(f"doc_id <> {first}").unionByName(known.filter(f"doc_id = {first}")), most_words=50_000)


def signed_hash(spark, i):
    return spark.sql(f"SELECT xxhash64('sample', {i}L) AS h").first().h


def test_risk_ignores_toxic_rows_among_the_unlabelled():
    """Half of the toxic rows hide in the unlabelled sample; they must still score high."""
    rng = np.random.default_rng(1)
    row = lambda bad: np.unique(np.concatenate([rng.integers(10, 200, 30), [1, 2] if bad else []]).astype(np.int64))
    w, b = toxicity.fit([row(True) for _ in range(100)], [row(k % 5 == 0) for k in range(500)], 0.2)
    z = lambda bad: b + sum(w.get(int(x), 0) for x in row(bad))
    assert np.mean([z(True) > 0 for _ in range(100)]) > 0.95 and np.mean([z(False) > 0 for _ in range(100)]) < 0.05
