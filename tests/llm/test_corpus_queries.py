"""Registered corpus queries against their SQL, and the pipeline against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from oracle import DATA, database, rows_of, rows_of_sql
from test_lines import expected
from test_rest import slow_counts, slow_mcd, slow_targets
from test_scans import slow_containment
from test_simhash import slow_fingerprint, slow_roots, slow_without_alike

import corpus_pipeline
from tonewright.llm import quality
from tonewright.llm.queries import oracle_sql, queries
from tonewright.llm.text import table


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    names, rows = rows_of(queries()[name](spark, DATA))
    assert rows
    if name in oracle_sql():
        assert (names, rows) == rows_of_sql(database(), oracle_sql()[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_pipeline_of_nothing(spark, tmp_path):
    table(spark, DATA, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, DATA, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# The whole pipeline in plain Python


def slow_quality(rows):
    """Rows whose verdict is plain: exact quantiles and many starts; none may lie near the cutoff."""
    kept = []
    for group in sorted({r[2:4] for r in rows}, key=repr):
        own = [(r, np.array(slow_counts(r[1]), float)) for r in rows if r[2:4] == group]
        own = [(r, c) for r, c in own if c[0] >= 50 and 100 * c[4] <= 50 * c[0]]
        if not own:
            continue
        c = np.array([c for _, c in own])
        x = np.column_stack([np.log1p(c[:, 0]), np.log(c[:, 1] / c[:, 0]), np.sqrt(c[:, 2] / c[:, 1]), np.log1p(c[:, 3]), c[:, 4] / c[:, 0]])
        m, s = slow_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        assert not any(0.6 < v / quality.CUTOFF < 1.7 for v in d)
        kept += [r for (r, _), v in zip(own, d, strict=True) if v <= quality.CUTOFF]
    return kept


def slow_lines(rows):
    out = []
    for r, (text, n, exact, near) in zip(rows, expected([r[:2] for r in rows], {r[1]: 0 for r in rows}), strict=True):
        if n == 0 or n > exact + near:
            out.append((r[0], text, *r[2:4], len(text) if exact + near else r[4]))
    return out


def slow_one_of_each(rows):
    prints = [slow_fingerprint(r[1]) for r in rows]
    root = slow_roots(sorted(set(prints)))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    linked = [r for r, p in zip(rows, prints, strict=True) if r[0] is None or least[root[p]] == r[0]]
    stay = set(slow_without_alike([r[:2] for r in linked]))
    return [r for r in linked if r[:2] in stay]


def slow_mix(rows):
    size = lambda r: len((r[1] or "").split())
    key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
    sizes = {s: sum(size(r) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    target = slow_targets(sizes)
    rank = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    queue = []
    for s in sizes:
        upto = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (key(r), -1 if r[0] is None else r[0], size(r))):
            upto += size(r)
            queue += [((copy * sizes[s] + upto) / target[s], rank[s], key(r), -1 if r[0] is None else r[0], size(r), copy, r) for copy in range(3)]
    taken, total = {}, 0
    for *_, n, _, r in sorted(queue, key=lambda q: q[:6]):
        total += n
        if total <= sum(sizes.values()):
            taken[r] = taken.get(r, 0) + 1
    return sorted(((*r, k) for r, k in taken.items()), key=repr)


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 5, 6))))
    line = lambda n=12: " ".join(word() for _ in range(n))
    shared, items = [line() for _ in range(6)], [(k, line(n)) for k, n in enumerate((30, 18, 12, 3))]
    rows = []
    for i in range(260):
        lines = [line() for _ in range(rng.choice((9, 10, 11)))]
        lang, source = (("en", "a"), ("en", None), ("fr", "b"))[i % 13 % 3]
        if i % 7 == 1:
            lines[rng.randrange(9)] = shared[i % 6]
        if i % 7 == 2:
            lines[3] = shared[i % 6][:5] + "X" + shared[i % 6][6:]
        if i % 17 == 3:
            lines[4] = items[i % 4][1].upper()
        if i % 20 == 4:
            lines = [x.replace(" ", "%%% ") for x in lines]
        if i % 23 == 5:
            lines = lines[:2]
        text = "\n".join(lines)
        rows.append((None if i == 50 else i, text, lang, source, len(text)))
    copy = lambda i, r: (i, rows[r][1].upper(), *rows[r][2:])
    rows += [copy(300, 0), copy(301, 6), (302, rows[7][1], *rows[7][2:]), (303, None, "en", "a", 0), (304, "", None, None, 0), (rows[9][0], line(110), "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = slow_quality(rows)
    lines = slow_lines(good)
    single = slow_one_of_each(lines)
    clean = [r for r in single if not slow_containment([r[:2]], items)]
    want = slow_mix(clean)
    assert len(rows) > len(good) > len(lines) > len(single) > len(clean) > 150 and {r[5] for r in want} == {1, 2}
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "start"]
    got = done.select("doc_id", "text", "lang", "source", "n_chars", "copies").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
