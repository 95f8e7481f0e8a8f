"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived (after Cox,
2012): a text that the expression matches satisfies it. The index holds postings (trigram, document)
for the trigrams of the queries; the postings of a document are brought together, each query is
evaluated on them, and only documents that satisfy it are verified by the expression itself.
Documents that hold a rule's trigrams by chance cost a verification and nothing else. Rules whose
expression has no mandatory trigram are scanned over all texts.

Documents are named in the index by a hash of doc_id and text, so repeated rows share postings and
a collision only adds candidates. Null texts are empty and have no spans. Spans count code points,
ends are exclusive; matches are the leftmost non-overlapping ones of each rule, and a match whose
group is too short is dropped after it has consumed its text. Other columns are ignored. No Python
runs on the executors. Long texts are scanned whole. Spans of several rules that start at one place go in the order of the
rules; they may overlap. An empty table gives an empty one.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled, small
from tonewright.llm.text import running_sums


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in order, then further public token formats.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
MOST_STRINGS = 64
MOST_CHARS = 8

#: A query is True (any text), a trigram, or ("and" | "or", tuple of queries).
Query = bool | str | tuple


def _all(queries: list[Query]) -> Query:
    parts = tuple(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(queries: list[Query]) -> Query:
    parts = tuple(dict.fromkeys(queries))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _piece(op, arg) -> tuple[set[str] | None, Query]:
    """The strings that a piece matches, if few, else a query that its matches satisfy."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN and all(o is sre.LITERAL or o is sre.RANGE for o, _ in arg):
        chars = {c for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], min(a[1], a[0] + MOST_CHARS) + 1))}
        return ({chr(c).lower() for c in chars}, True) if len(chars) <= MOST_CHARS else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST_STRINGS:
            return set().union(*(e for e, _ in found)), True
        return None, _any([q if e is None else _of_strings(e) for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if high == 1 and exact is not None:
            return (exact | {""}) if low == 0 else exact, True
        if low == 0:
            return None, True
        return None, query if exact is None else _of_strings(exact)
    return None, True


def _sequence(parsed) -> tuple[set[str] | None, Query]:
    now, queries, whole = {""}, [], True
    for op, arg in parsed:
        exact, query = _piece(op, arg)
        if exact is not None and len(now) * len(exact) <= MOST_STRINGS:
            now = {a + b for a in now for b in exact}
            continue
        queries += [_of_strings(now), query]
        whole, now = False, {""} if exact is None else exact
    return (now, True) if whole else (None, _all([*queries, _of_strings(now)]))


def trigram_query(pattern: str) -> Query:
    """A query over lower-cased trigrams that every text with a match satisfies; True if there is none."""
    exact, query = _sequence(sre_parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings: trigram and key of the documents whose lower-cased text holds it."""
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(held).alias("trigram"))


def _holds(query: Query, have: str) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    parts = [_holds(q, have) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def candidates(postings: DataFrame, rules: dict[int, Query]) -> DataFrame:
    """key and found, the bits of the rules (by number) whose query its postings satisfy."""
    own = postings.groupBy("key").agg(F.collect_set("trigram").alias("have"))  # at most the queries' trigrams
    bits = reduce(lambda a, b: a + b, [F.when(_holds(q, "have"), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in rules.items()])
    return own.select("key", bits.alias("found")).filter("found > 0")


def _placed(k: int, rule: Rule) -> Column:
    """The spans of rule k, from lengths of pieces (p), matches (m) and groups (g) and the sums before (b)."""
    each = F.transform(
        f"_b{k}",
        lambda b, i: F.struct(
            (b + F.get(f"_p{k}", i)).alias("start"),
            F.lit(k).alias("kind_no"),
            (b + F.get(f"_p{k}", i) + F.get(f"_m{k}", i)).alias("end"),
            F.get(f"_g{k}", i).alias("g"),
        ),
    )
    fit = F.transform(F.filter(each, lambda x: x["g"] >= rule.least), lambda x: F.struct(x["start"], x["kind_no"], x["end"]))
    return F.coalesce(fit, F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans, an array of (start, kind_no, end) sorted, kind_no being the rule's place."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    by_index = {k: q for k, q in queries.items() if q is not True}
    cur = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key().alias("_key"))
    if by_index:
        found = settled(candidates(index(docs, sorted(set().union(*map(trigrams, by_index.values())))), by_index), "candidates")
        cur = cur.join(small(found.withColumnRenamed("key", "_key")), "_key", "left")
    else:
        cur = cur.withColumn("found", F.lit(0))
    for k, r in enumerate(rules):
        hit = F.col("found").bitwiseAND(F.lit(1 << k)) > 0 if k in by_index else F.col("text").rlike(r.pattern)
        pattern = F.lit(r.pattern)
        cur = cur.withColumns(
            {
                f"_m{k}": F.when(hit, F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda x: F.length(x).cast("long"))),
                f"_g{k}": F.when(hit, F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), lambda x: F.length(x).cast("long"))),
                f"_p{k}": F.when(hit, F.transform(F.split("text", r.pattern, -1), lambda x: F.length(x).cast("long"))),
            }
        )
    cur = cur.drop("text")
    for k in range(len(rules)):
        cur = cur.withColumn(f"_d{k}", F.zip_with(F.slice(f"_p{k}", F.lit(1), F.size(f"_m{k}")), f"_m{k}", lambda p, m: p + m))
    for k in range(len(rules)):
        cur = cur.withColumn(f"_b{k}", F.when(F.col(f"_m{k}").isNotNull(), running_sums(F.col(f"_d{k}"))))
    return cur.select("doc_id", F.sort_array(F.concat(*[_placed(k, r) for k, r in enumerate(rules)])).alias("spans"))


def as_text(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
