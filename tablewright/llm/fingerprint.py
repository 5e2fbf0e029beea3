"""Document fingerprints from closed syncmers of words.

A k-mer is ``k`` consecutive words, its inner substrings are the runs of ``s``
words in it. A k-mer is a closed syncmer if the substring with the least hash
is the first or the last of them. That depends on the k-mer alone, so an edit
moves no anchor outside the k-mers it touches, and every window of
``k - s + 1`` k-mers holds an anchor. About ``2 / (k - s + 1)`` of all k-mers are
anchors.

The fingerprint of a text is the sequence of its anchors, eight hex digits
each; its likeness to another is the share of distinct anchors they have in
common (Jaccard). ``anchors`` also gives their word positions and
``positional_matches`` the places where two sets of texts agree.

A text of ``k`` words or some more may hold no syncmer; its fingerprint is
empty. Two such texts are as alike as their runs of ``s`` words, of which
``positional_matches`` also gives the places.

Everything is a DataFrame expression: no Python runs in tasks.

Defined results: null is the empty text. A text with words, but fewer than
``k``, has one anchor made of all its words; one without words has none. Two
texts without words are alike (1), one with and one without anchors are not
(0). Rows that share a key keep a row each; as somebody's next text the smallest of their
texts counts. Rows with a null key have no next text, which counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.ordering import global_index


@dataclass(frozen=True)
class Settings:
    k: int = 10
    s: int = 2
    #: Rows of a run of neighbouring keys that are handled together.
    run: int = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(text: Column, settings: Settings = Settings()) -> Column:
    """Array of (pos, code): word position and hash of every closed syncmer, in order."""
    k, s = settings.k, settings.s
    last = k - s

    def inner(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[h[i + d] for d in range(s)]))

    def closed(m: Column) -> Callable[[Column], Column]:
        if last < 2:
            return lambda i: F.lit(True)
        between = lambda i: [m[i + d] for d in range(1, last)]
        least = lambda x: F.least(*x) if len(x) > 1 else x[0]
        return lambda i: F.least(m[i], m[i + last]) <= least(between(i))

    # Inner substrings that cover the k-mer without a gap.
    steps = sorted({*range(0, last + 1, s), last})

    def found(m: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(m) - 1 - last), closed(m))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[m[i + d] for d in steps]).alias("code")))

    whole = lambda h: F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("code")))
    none = F.array().cast("array<struct<pos:int,code:bigint>>")
    return let(word_hashes(text), lambda h: F.when(F.size(h) >= k, let(inner(h), found)).when(F.size(h) > 0, whole(h)).otherwise(none))


def runs(text: Column, settings: Settings = Settings()) -> Column:
    """Array of (pos, code): position and hash of every run of ``s`` words, of all words if there are fewer."""
    s = settings.s

    def each(h: Column) -> Column:
        # Marked, so that no run has the code of a k-mer or of a whole text.
        code = lambda i: F.xxhash64(F.lit("run"), *[h[i + d] for d in range(s)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.struct(i.alias("pos"), code(i).alias("code")))

    whole = lambda h: F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.lit("run"), h).alias("code")))
    none = F.array().cast("array<struct<pos:int,code:bigint>>")
    return let(word_hashes(text), lambda h: F.when(F.size(h) >= s, each(h)).when(F.size(h) > 0, whole(h)).otherwise(none))


def all_anchors(text: Column, settings: Settings = Settings()) -> Column:
    """The syncmers of a text, or its runs of words where it has none."""
    return let(anchors(text, settings), lambda a: F.when(F.size(a) > 0, a).otherwise(runs(text, settings)))


def codes(text: Column, settings: Settings = Settings()) -> Column:
    return F.transform(anchors(text, settings), lambda a: a["code"])


def as_text(code_array: Column) -> Column:
    """The fingerprint: low 32 bits of every anchor as hex, in the order of the text."""
    return F.array_join(F.transform(code_array, lambda c: F.substring(F.hex(c.bitwiseAND(0xFFFFFFFF) + (1 << 32)), 2, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct anchors that two arrays of codes have in common, 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))

    both = let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: share(x, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(both)


def text_likeness(a: Column, a_text: Column, b: Column, b_text: Column, settings: Settings = Settings()) -> Column:
    """Likeness of two texts by their codes, or by their runs of words if neither has an anchor."""
    short = [F.transform(runs(t, settings), lambda x: x["code"]) for t in (a_text, b_text)]
    return F.when((F.size(a) > 0) | (F.size(b) > 0), likeness(a, b)).otherwise(likeness(*short))


def positional_matches(left: DataFrame, right: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Where texts agree: left_key, right_key, left_pos, right_pos, code of every common anchor."""

    def exploded(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col(key).alias(f"{side}_key"), F.explode(all_anchors(F.col(text), settings)).alias("a"))
        return rows.select(f"{side}_key", F.col("a")["pos"].alias(f"{side}_pos"), F.col("a")["code"].alias("code"))

    return exploded(left, "left").join(exploded(right, "right"), "code")


def with_next(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """id, text, codes of every row, and next: text and codes of the next key downwards, round from the last to the first.

    Keys are numbered by ranges; a run of ``settings.run`` numbers, and a copy
    of the row after it, form a window partition of bounded size.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = global_index(rows.select("id").where("id is not null").distinct(), [F.desc("id")], "place", "total")
    size = settings.run
    own = F.struct((F.col("place") / size).cast("long").alias("run"), F.col("place").alias("at"), F.lit(False).alias("copy"))
    before = F.struct((F.col("place") / size - 1).cast("long").alias("run"), F.col("place").alias("at"), F.lit(True).alias("copy"))
    around = F.struct(((F.col("total") - 1) / size).cast("long").alias("run"), F.col("total").alias("at"), F.lit(True).alias("copy"))
    spots = F.when(F.col("place") == 0, F.array(own, around)).when(F.col("place") % size == 0, F.array(own, before)).otherwise(F.array(own))
    # The places grow with the documents: they are shuffled at every size, never broadcast.
    placed = rows.join(order.hint("merge"), "id").select("id", "text", F.explode(spots).alias("spot")).select("id", "text", "spot.*")
    # Dealt by run first, so that codes are made after the shuffle and never sent.
    placed = placed.repartition("run").withColumn("codes", codes(F.col("text"), settings))
    following = Window.partitionBy("run").orderBy("at").rangeBetween(1, 1)
    placed = placed.withColumn("next", F.min(F.struct("text", "codes")).over(following)).where(~F.col("copy"))
    alone = rows.where("id is null").withColumn("codes", codes(F.col("text"), settings))
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("codes"))
    return placed.select("id", "text", "codes", "next").unionByName(alone.withColumn("next", empty))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) characters replaced by the first as many of another."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Fingerprint of every row, and how like it are its edited text and the next document."""
    rows = with_next(docs, key, text, settings)
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next")["text"]))
    rows = rows.withColumn("edit_codes", codes(F.col("edit"), settings))
    own, edit, following = (F.col("codes"), F.col("text")), (F.col("edit_codes"), F.col("edit")), (F.col("next")["codes"], F.col("next")["text"])
    rows = rows.select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        "codes", "edit_codes",
        text_likeness(*own, *edit, settings).alias("near_edited"), text_likeness(*own, *following, settings).alias("near_next"),
    )
    return rows.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edit_codes")).alias("edited_fingerprint"), "near_edited", "near_next", F.size("codes").alias("n_anchors"),
    )
