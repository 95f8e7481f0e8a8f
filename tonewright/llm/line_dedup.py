"""Line dedup over the whole corpus by a deletion-neighbourhood join.

Lines are compared without white space at their ends. Of equal lines, and of lines within one
character edit (insertion, deletion or substitution), the earliest is kept; a line goes if any
earlier line is within the bound, even if that one goes too. Earlier is by doc_id (null last), then
by hashes of the text, then by the line's number. Lines without a word stay: they carry no content.
The bound is the parameter edits, one or none (equal lines only); it holds for lines of any length.

The neighbourhood of a line are its variants with one character deleted, each as a hashed key.
Substitutions meet at the same deleted position in lines of one length; an insertion meets the
longer line's variant with the whole shorter line. Typed in this way, all that meet are within the
bound, so each key's earliest line is a witness for the others and no pairs within a key are needed.
Hashes only find witnesses: each is verified by Levenshtein distance on the text.

Few lines need variants. One edit lies in one half of a line, so only lines that share the other half
with another line of their length or one more are looked at. These are cut into sixteenths, again
and again until short: only windows around which another line agrees are kept, and the variants are
those of the windows, keyed with all that is around them. These filters lose none and their work is
linear in a line's length.

Null and empty texts have no lines with words and stay as they are; an empty table gives an empty
one. Long texts and lines are like any other: nothing is cut off. Ties can't be, as no two lines have
one place; repeated rows (same doc_id and text) get the same lines: both keep what one would. Other
columns, of whatever name or type, are kept as they are. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled, small
from tonewright.llm.text import free_names, lines, trimmed

COARSE, FINE = 2, 16
WINDOW = 256


def _h(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("g"), text)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h and g (hashes of the text), no, line, a and b (hashes of the line), n; lines with a word."""
    h, g = _text_hashes(F.col("text"))
    return (
        docs.select("doc_id", h.alias("h"), g.alias("g"), F.posexplode(lines(F.col("text"))).alias("no", "raw"))
        .select("doc_id", "h", "g", "no", trimmed(F.col("raw")).alias("line"))
        .filter("line <> ''")
        .select("doc_id", "h", "g", "no", "line", _h(F.lit("a"), F.col("line")).alias("a"), _h(F.lit("b"), F.col("line")).alias("b"), F.length("line").alias("n"))
    )


def _place() -> Column:
    """Sorts by doc_id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g", "no")


def _cut(n: Column, number: Column, m: int) -> tuple[Column, Column, Column]:
    """Size, and characters left and right of one of m pieces: for the text's own length (numbers below m) or one more.

    A piece is cut from both ends. Two texts within one edit agree left and right of some piece at
    the longer one's length.
    """
    size, k = n + F.floor(number / m).cast("int"), number % m
    left = F.least(F.greatest(F.floor(size * k / m).cast("int") - 1, F.lit(0)), n)
    right = F.least(F.greatest(size - F.floor(size * (k + 1) / m).cast("int") - 1, F.lit(0)), n - left)
    return size, left, right


def _piece(text: Column, n: Column, number: Column, m: int, *outer: Column) -> Column:
    """Hash of the text around a piece."""
    size, left, right = _cut(n, number, m)
    return _h(*outer, number % m, size, F.substring(text, F.lit(1), left), F.when(right > 0, F.substring(text, n - right + 1, right)).otherwise(""))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """a, b, n, p (place of the first) and keys of the distinct lines with a word; settled."""
    each = _lines(docs)
    keys = F.array(*[_piece(F.col("line"), F.col("n"), F.lit(k), COARSE) for k in range(2 * COARSE)])
    return settled(
        each.withColumn("keys", keys).groupBy("a", "b").agg(F.min(_place()).alias("p"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "distinct-lines",
    )


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """The rows (a, key, ...) whose key is also that of another line."""
    both = keyed.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select("key")
    return keyed.join(small(settled(both, name)), "key")


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows (a, outer, w) to the windows in which lines with equal surroundings differ; settled.

    outer stands for all that is around w. Each pass cuts the windows into FINE pieces and keeps
    those whose surroundings another line shares, until they are short; work is linear in the text.
    """
    done = None
    while True:
        rows = rows.withColumn("n", F.length("w"))
        n, numbers = F.col("n"), F.sequence(F.lit(0), F.lit(2 * FINE - 1))
        keys = F.transform(numbers, lambda k: _piece(F.col("w"), n, k, FINE, F.col("outer")))
        keyed = settled(rows.select("a", "outer", F.posexplode(keys).alias("number", "key")), "keyed-pieces")
        found = settled(_shared(keyed, "piece-keys"), "pieces")
        _, left, right = _cut(n, F.col("number"), FINE)
        cut = rows.join(small(found), ["a", "outer"]).select("a", F.col("key").alias("outer"), F.substring("w", left + 1, n - left - right).alias("w"))
        rows = settled(cut.distinct(), "windows")
        short = rows.filter(F.length("w") <= WINDOW)
        done = short if done is None else done.unionByName(short)
        rows = rows.filter(F.length("w") >= WINDOW)  # a window of just that length may pair with either side
        if rows.isEmpty():
            return done


def _variants(windows: DataFrame) -> DataFrame:
    """outer, key, length, at (0: insertion), whole (the window itself), place, a, b."""
    own, w, n = ["place", "a", "b", "outer"], F.col("w"), F.length("w")
    cuts = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("at"), _h(F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n))).alias("key"))
    )
    cuts = F.when(n > 0, cuts).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))
    rows = windows.select(*own, n.alias("n"), F.explode(F.concat(cuts, F.array(F.struct(F.lit(0).alias("at"), _h(w).alias("key"))))).alias("v"))
    rows = rows.select(*own, "n", "v.at", "v.key")
    # A deletion stands for a substitution at its place and for an insertion into a text one shorter.
    kinds = F.when(F.col("at") == 0, F.array(F.struct(F.col("n").alias("length"), F.col("at")))).otherwise(
        F.array(F.struct(F.col("n").alias("length"), F.col("at")), F.struct((F.col("n") - 1).alias("length"), F.lit(0).alias("at")))
    )
    return rows.select(*own, "key", (F.col("at") == 0).alias("whole"), F.explode(kinds).alias("k")).select(*own, "key", "whole", "k.length", "k.at").distinct()


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """a, b of the distinct lines that have an earlier, different line within one edit."""
    keyed = distinct.select("a", F.explode("keys").alias("key"))
    ids = settled(_shared(keyed, "halves").select("a").distinct(), "line-ids")
    texts = settled(_lines(docs).join(small(ids), "a", "left_semi").groupBy("a", "b").agg(F.first("line").alias("line")), "lines")
    windows = _narrowed(texts.select("a", F.lit(0).cast("long").alias("outer"), F.col("line").alias("w")))
    placed = distinct.join(small(settled(windows.select("a").distinct(), "window-ids")), "a", "left_semi").select("a", "b", F.col("p").alias("place"))
    seen = settled(_variants(windows.join(placed, "a")), "variants")
    who = lambda w: F.min(F.when(w, F.struct("place", "a", "b")))
    met = seen.groupBy("outer", "key", "length", "at").agg(
        who(F.lit(True)).alias("first"), who(F.col("whole")).alias("full"), who(~F.col("whole")).alias("cut"), F.count("*").alias("k")
    ).filter("k > 1")
    found = (
        seen.join(met, ["outer", "key", "length", "at"])
        .withColumn("w", F.when(F.col("at") > 0, F.col("first")).when(F.col("whole"), F.col("cut")).otherwise(F.col("full")))
        .filter("w.place < place")
        .select("a", "b", F.col("w.a").alias("wa"), F.col("w.b").alias("wb"))
        .distinct()
    )
    text = texts.select("a", "b", "line")
    other = texts.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("line").alias("witness"))
    return (
        found.join(text, ["a", "b"])
        .join(other, ["wa", "wb"])
        .filter(F.levenshtein("line", "witness", 1).between(0, 1))
        .select("a", "b")
        .distinct()
    )


def kept_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """doc_id, h, g, first (numbers of the lines that are the earliest of their equals) and kept (those without an earlier neighbour too).

    One row for each text that has any; the earliest lines are the groups' minima, so no line is joined back to a hot group.
    """
    if edits not in (0, 1):
        raise ValueError("the bound is no edit or one edit")
    first = distinct_lines(docs)
    near = settled((near_lines(docs, first) if edits else first.select("a", "b").limit(0)).withColumn("near", F.lit(True)), "near-lines")
    marked = first.join(small(near), ["a", "b"], "left")
    return (
        marked.groupBy(*[F.col(f"p.{c}").alias(c) for c in ("doc_id", "h", "g")])
        .agg(
            F.sort_array(F.collect_list("p.no")).alias("first"),
            F.sort_array(F.collect_list(F.when(F.col("near").isNull(), F.col("p.no")))).alias("kept"),
        )
    )


def _deduped(docs: DataFrame, edits: int) -> DataFrame:
    """row (all of the document's columns), text (of what stays), lines, exact and near (counts)."""
    kept = kept_lines(docs, edits).select(F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h"), F.col("g").alias("k_g"), "first", "kept")
    h, g = _text_hashes(F.col("row.text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("k_doc")) & (h == F.col("k_h")) & (g == F.col("k_g"))
    none = F.array().cast("array<int>")
    joined = docs.select(F.struct("*").alias("row")).join(kept, same, "left")
    joined = joined.select("row", lines(F.col("row.text")).alias("all"), F.coalesce("kept", none).alias("stays"), F.coalesce("first", none).alias("firsts"))
    wordy = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: trimmed(F.get("all", i)) != "")
    joined = joined.withColumn("wordy", wordy).withColumn("gone", F.array_except("wordy", "stays"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    left = F.array_join(F.transform(rest, lambda i: F.get("all", i)), "\n")
    return joined.select(
        "row",
        F.when(F.size("gone") == 0, F.col("row.text")).otherwise(left).alias("text"),
        F.size("wordy").alias("lines"),
        (F.size("wordy") - F.size("firsts")).alias("exact"),
        (F.size("firsts") - F.size("stays")).alias("near"),
    )


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The document's columns out of row, some of them replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The documents with all columns, their text without the lines that go; adds the numbers of lines with a word, of repeats and of neighbours gone.

    These are named _lines, _exact and _near, with underscores appended where a column has that name.
    """
    names = free_names(docs.columns, "_lines", "_exact", "_near")
    counts = [F.col(c).alias(n) for c, n in zip(("lines", "exact", "near"), names, strict=True)]
    return _deduped(docs, edits).select(*_columns(docs, text=F.col("text")), *counts)


def corpus_without_repeats(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The documents with repeats of lines gone; those that lose their last line with a word go. n_chars follows the text."""
    clean = _deduped(docs, edits).filter("lines = 0 OR lines > exact + near")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("exact") + F.col("near") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.select(*_columns(docs, **new))
