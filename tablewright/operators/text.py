"""Text statistics per row, and term statistics over a whole corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text as tx
from tablewright.functions.numeric import clean_ratio, ratio
from tablewright.functions.stem import russian_stem
from tablewright.operators.joins import attach, fits_broadcast
from tablewright.operators.phrases import covered_tokens
from tablewright.session import materialize

SMOOTHING = 0.01  # fixed value: added to both polarity counts of the ratio


def add_tokens(df: DataFrame, text: str, stop_words: Sequence[str], suffix: str) -> DataFrame:
    """Columns ``tokens_<suffix>`` and ``words_<suffix>`` (clean words)."""
    return df.withColumn(f"tokens_{suffix}", tx.tokens(text)).withColumn(
        f"words_{suffix}", tx.clean_words(f"tokens_{suffix}", stop_words)
    )


def basic_statistics(text: str, stop_words: Sequence[str], suffix: str) -> dict[str, Column]:
    """Counts and shares; needs the columns of :func:`add_tokens`."""
    toks, words = F.col(f"tokens_{suffix}"), F.col(f"words_{suffix}")
    n_words, n_unique = F.size(words), F.size(F.array_distinct(words))
    n_stop = tx.count_tokens(toks, lambda t: tx.is_stop_word(t, stop_words))
    # What is neither a word nor a stop word is punctuation, unless a stop word is both.
    apart = not any(w in tx.PUNCTUATION for w in stop_words)
    return {
        f"CNT_stopwords_{suffix}": n_stop,
        f"CNT_puncs_{suffix}": F.size(toks) - n_words - n_stop if apart else tx.count_tokens(toks, tx.is_punctuation),
        f"CNT_numerics_{suffix}": tx.count_numeric(text),
        f"CNT_word_{suffix}": n_words,
        f"CNT_unique_word_{suffix}": n_unique,
        f"PCENT_unique_word_{suffix}": clean_ratio(ratio(n_unique, n_words)),
        f"CNT_char_{suffix}": F.length(F.coalesce(F.col(text), F.lit(""))),
        f"AVG_word_len_{suffix}": tx.average_length(words),
    }


def mark_statistics(suffix: str, combined: bool = False) -> dict[str, Column]:
    """Counts of ``!``, ``?`` and ``:`` apart, or their total for a title."""
    toks = F.col(f"tokens_{suffix}")
    if combined:
        return {f"CNT_special_{suffix}": tx.count_marks(toks, (":", "?", "!"))}
    return {
        f"CNT_exclamation_{suffix}": tx.count_marks(toks, ("!",)),
        f"CNT_question_{suffix}": tx.count_marks(toks, ("?",)),
        f"CNT_colon_{suffix}": tx.count_marks(toks, (":",)),
    }


def text_features(
    df: DataFrame, key: str, text: str, suffix: str, stop_words: Sequence[str], title: bool = False
) -> DataFrame:
    """Key, all row-wise statistics, and the clean words of one text column."""
    prepared = add_tokens(df.select(key, text), text, stop_words, suffix)
    columns = {**basic_statistics(text, stop_words, suffix), **mark_statistics(suffix, combined=title)}
    return prepared.select(key, f"tokens_{suffix}", f"words_{suffix}", *[c.alias(n) for n, c in columns.items()])


def _explode_fields(
    df: DataFrame, key: str, arrays: Mapping[str, str], name: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, *keep, field, name) for the elements of several array columns.

    A row whose arrays are all empty keeps one row of nulls.
    """
    def tagged(field: str, column: str) -> Column:
        return F.transform(column, lambda w: F.struct(F.lit(field).alias("field"), w.alias(name)))

    both = F.concat(*[tagged(f, c) for f, c in arrays.items()])
    each = df.select(key, *keep, F.explode_outer(both).alias("_e"))
    return each.select(key, *keep, "_e.field", f"_e.{name}")


def polarity(df: DataFrame, key: str, words: Mapping[str, str], lexicon: DataFrame) -> DataFrame:
    """Positive and negative words by a (word, polarity) table.

    ``words`` maps a suffix to a word column; all columns share one pass. The
    words of a row are counted in its own task before the counts are shuffled
    by key. A short lexicon is part of the plan; a longer one is joined, and
    broadcast when it is measured to be small.
    """
    small = _small_lexicon(lexicon)
    if small is not None:
        return _polarity_shares(_counted_in_place(df, key, words, *small), key, words)
    each = _explode_fields(df, key, words, "word")
    matched = attach(each, lexicon.select("word", "polarity"), "word", store=False)
    here = {s: F.col("field") == s for s in words}
    counts = matched.groupBy(key).agg(*[
        c
        for s in words
        for c in (
            F.count_if(here[s] & (F.col("polarity") > 0)).alias(f"CNT_Pos_Words_{s}"),
            F.count_if(here[s] & (F.col("polarity") < 0)).alias(f"CNT_Neg_Words_{s}"),
            F.count_if(here[s]).alias(f"_n_{s}"),
        )
    ])
    return _polarity_shares(counts, key, words)


#: A lexicon of at most so many words is part of the expressions that count them.
LEXICON_WORDS = 1000


def _small_lexicon(lexicon: DataFrame) -> tuple[list[str], list[str]] | None:
    """Positive and negative words; None for a lexicon with many words, or with one that comes twice."""
    rows = lexicon.select("word", "polarity").where("word is not null").limit(LEXICON_WORDS + 1).collect()
    if len(rows) > LEXICON_WORDS or len({r.word for r in rows}) < len(rows):
        return None
    signs = [(r.word, r.polarity or 0) for r in rows]
    return [w for w, p in signs if p > 0], [w for w, p in signs if p < 0]


def _counted_in_place(df: DataFrame, key: str, words: Mapping[str, str], positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """The counts of a row where it is; only counts are added up by key."""
    every = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in words.values()])

    def found(c: str, listed: Sequence[str]) -> Column:
        return F.size(F.filter(c, lambda w: w.isin(*listed))) if listed else F.lit(0)

    here = df.select(key, *[
        F.when(every, n).otherwise(0).alias(name)
        for s, c in words.items()
        for name, n in ((f"CNT_Pos_Words_{s}", found(c, positive)), (f"CNT_Neg_Words_{s}", found(c, negative)), (f"_n_{s}", F.size(c)))
    ])
    return here.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in here.columns if c != key])


def _polarity_shares(counts: DataFrame, key: str, words: Mapping[str, str]) -> DataFrame:
    def shares(s: str) -> list[Column]:
        pos, neg, n = f"CNT_Pos_Words_{s}", f"CNT_Neg_Words_{s}", f"_n_{s}"
        return [
            F.col(pos), F.col(neg),
            ((F.col(pos) + F.lit(SMOOTHING)) / (F.col(neg) + F.lit(SMOOTHING))).alias(f"RATIO_PosNeg_Word_{s}"),
            clean_ratio(ratio(pos, n)).alias(f"PCENT_Pos_Word_{s}"),
            clean_ratio(ratio(neg, n)).alias(f"PCENT_Neg_Word_{s}"),
        ]

    return counts.select(key, *[c for s in words for c in shares(s)])


#: Between the phrases of one first token; no token holds it.
PHRASE_END = "\u0001"


def entity_words(df: DataFrame, key: str, tokens: Mapping[str, str], entities: DataFrame) -> DataFrame:
    """Number of tokens inside phrases of an entity table (column ``phrase``), whatever their length.

    A token covered by several phrases counts once. A table whose measured
    size may be broadcast becomes an automaton in every worker, and the rows are
    not shuffled. A larger one is joined by the first token of its phrases.
    """
    listed = materialize(entities.select("phrase").where("phrase <> ''").distinct(), "phrases")
    if fits_broadcast(listed):
        phrases = sorted(r.phrase for r in listed.collect())
        return df.select(key, *[covered_tokens(df.sparkSession, phrases, c).alias(f"CNT_Named_Entity_{f}") for f, c in tokens.items()])
    return _entity_join(df, key, tokens, listed)


def _entity_join(df: DataFrame, key: str, tokens: Mapping[str, str], entities: DataFrame) -> DataFrame:
    """The same by a join: only tokens that begin a phrase are looked up, the rest of it is compared in place.

    The positions of a row meet in one aggregate, which a task that holds the
    row whole has already done before the shuffle.
    """
    max_len = entities.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = F.split("phrase", " ")
    heads = entities.groupBy(words[0].alias("token")).agg(
        F.array_join(F.sort_array(F.collect_list("phrase")), PHRASE_END).alias("phrases")
    )

    def tagged(field: str, column: str) -> Column:
        return F.transform(column, lambda w, i: F.struct(
            F.lit(field).alias("field"), i.alias("pos"), w.alias("token"), F.slice(F.col(column), i + 1, max_len).alias("rest"),
        ))

    every = F.concat(*[tagged(f, c) for f, c in tokens.items()])
    each = df.select(key, F.explode_outer(every).alias("_s")).select(key, "_s.*")
    found = attach(each, heads, "token", salt_by=[key])
    fits = F.filter(
        F.split("phrases", PHRASE_END), lambda p: F.array_join(F.slice("rest", F.lit(1), F.size(F.split(p, " "))), " ") == p
    )
    ends = F.array_max(F.transform(fits, lambda p: F.size(F.split(p, " "))))
    covered = F.sequence(F.col("pos"), F.col("pos") + ends - 1)
    hits = found.select(key, "field", covered.alias("_at"))
    counts = hits.groupBy(key).agg(*[F.collect_list(F.when(F.col("field") == f, F.col("_at"))).alias(f"_{f}") for f in tokens])
    return counts.select(
        key, *[F.size(F.array_distinct(F.flatten(f"_{f}"))).cast("long").alias(f"CNT_Named_Entity_{f}") for f in tokens]
    )


def stem_table(df: DataFrame, words: Mapping[str, str], override: DataFrame | None = None) -> DataFrame:
    """(word, stem) of every different word of the columns ``words``, by rule; ``override`` (word, stem) goes first."""
    found = _explode_fields(df.select(*words.values()).withColumn("_k", F.lit(1)), "_k", words, "word")
    found = found.select(F.lower("word").alias("word")).where("word is not null").distinct()
    ruled = found.withColumn("stem", russian_stem("word"))
    if override is None:
        return ruled
    given = override.groupBy("word").agg(F.min("stem").alias("_given"))
    return attach(ruled, given, "word").select("word", F.coalesce("_given", "stem").alias("stem"))


def normalise_terms(
    df: DataFrame, key: str, words: Mapping[str, str], stems: DataFrame | None = None, keep: Sequence[str] = (),
    distinct: bool = False,
) -> DataFrame:
    """One row (key, *keep, field, term) for each word: lower case, then its stem.

    ``distinct`` gives each different word of a row once, for steps that need no counts.

    ``words`` maps a field name to a word column; ``keep`` names columns of the
    row, such as its target, to carry along. A word that ``stems``, a
    (word, stem) table, does not list stays as it is. A row without any words
    keeps one row with a null term.
    """
    if distinct:
        once = {f: F.array_distinct(F.transform(c, F.lower)) for f, c in words.items()}
        words = {f: f"_once_{f}" for f in once}
        df = df.select(key, *keep, *[c.alias(words[f]) for f, c in once.items()])
    each = _explode_fields(df, key, words, "term", keep).withColumn("term", F.lower("term"))
    if stems is None:
        return each
    table = stems.select(F.col("word").alias("term"), "stem")
    return attach(each, table, "term", store=False).withColumn("term", F.coalesce("stem", "term")).drop("stem")


def term_pool(terms: DataFrame, target: str) -> DataFrame:
    """Count and share of each term among rows with a zero or non-zero target.

    ``terms`` has one row (field, term, target) for each occurrence. There are
    two class totals for each field.
    """
    flagged = terms.where(F.col("term").isNotNull() & F.col(target).isNotNull())
    counts = flagged.groupBy("field", (F.col(target) != 0).alias("nonzero"), "term").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("field", "nonzero").agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(totals), ["field", "nonzero"]).select(
        "field", "nonzero", "term", "count", (F.col("count") / F.col("_total")).alias("freq")
    )


def term_contrast(pool: DataFrame) -> DataFrame:
    """``freq(non-zero) - freq(zero)`` of each term; absent counts as 0."""
    def side(flag: bool) -> Column:
        return F.coalesce(F.max(F.when(F.col("nonzero") == flag, F.col("freq"))), F.lit(0.0))

    return pool.groupBy("field", "term").agg(
        (side(True) - side(False)).alias("freq_diff"), F.sum("count").alias("count")
    )


def ranking_score(
    terms: DataFrame, key: str, ranking: DataFrame, names: Mapping[str, str], distinct: str = "score"
) -> DataFrame:
    """Sum of the contrast scores of a row's terms; unknown terms add 0.

    ``distinct="score"`` adds each distinct score value once; ``"term"`` adds
    each distinct term once. ``ranking`` is (field, term, freq_diff, count),
    its count tells which terms are frequent enough to be salted. ``names``
    maps a field to the name of its score column.
    """
    if distinct not in ("score", "term"):
        raise ValueError(f"unknown distinct: {distinct}")
    scored = attach(
        terms.select(key, "field", "term"), ranking.select("field", "term", "freq_diff", "count"), ["field", "term"],
        weight="count", salt_by=[key],
    )
    # The different values of a row meet in one aggregate and one shuffle.
    what = F.struct("freq_diff") if distinct == "score" else F.struct("freq_diff", "term")
    known = F.col("freq_diff").isNotNull()
    sets = scored.groupBy(key).agg(*[
        F.collect_set(F.when(known & (F.col("field") == f), what)).alias(f"_{f}") for f in names
    ])

    def total(values: Column) -> Column:
        # In order, so that the sum does not depend on how rows arrive.
        return F.aggregate(F.sort_array(values), F.lit(0.0), lambda acc, x: acc + x["freq_diff"])

    return sets.select(key, *[total(F.col(f"_{f}")).alias(name) for f, name in names.items()])


def word_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table (lexicon, entities, stems) as a DataFrame."""
    return spark.createDataFrame(list(rows), T._parse_datatype_string(schema))
