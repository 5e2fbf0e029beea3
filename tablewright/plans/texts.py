"""Queries: text statistics, term contrast, n-grams, TF-IDF and its SVD."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import stem as st
from tablewright.functions import text as tx
from tablewright.operators import lsa as ls
from tablewright.operators import ordering as o
from tablewright.operators import text as ot
from tablewright.plans.registry import Tables, query, r, rounded
from tablewright.plans.wordlists import ENTITIES, LEXICON, STEMS, STOP_WORDS
from tablewright.session import materialize


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


PUNCT = "'" + tx.PUNCTUATION.replace("'", "''") + "'"
STOP = _list(STOP_WORDS)
HIT = f"(x IN {STOP})"


def token_sql(table: str, key: str, text: str, name: str = "tok") -> str:
    """CTE with the token and clean word lists of a text column."""
    return f"""{name}_t AS (SELECT {key}, coalesce({text}, '') AS txt,
  regexp_extract_all(coalesce({text}, ''), '{tx.TOKEN_PATTERN}') AS toks FROM {table}),
{name} AS (SELECT *, [x FOR x IN toks IF NOT {HIT} AND NOT contains({PUNCT}, x)] AS words FROM {name}_t)"""


def basic_sql(s: str) -> str:
    return f"""CAST(len([x FOR x IN toks IF {HIT}]) AS INTEGER) AS CNT_stopwords_{s},
CAST(len([x FOR x IN toks IF contains({PUNCT}, x)]) AS INTEGER) AS CNT_puncs_{s},
CAST(length(regexp_replace(txt, '[^\\p{{N}}]', '', 'g')) AS INTEGER) AS CNT_numerics_{s},
CAST(len(words) AS INTEGER) AS CNT_word_{s}, CAST(len(list_distinct(words)) AS INTEGER) AS CNT_unique_word_{s},
round(coalesce(len(list_distinct(words)) / nullif(len(words), 0), 0), 6) AS PCENT_unique_word_{s},
CAST(length(txt) AS INTEGER) AS CNT_char_{s},
round(coalesce(list_sum([length(x) FOR x IN words]) / nullif(len(words), 0), 0), 6) AS AVG_word_len_{s}"""


def marks_sql(s: str, combined: bool = False) -> str:
    if combined:
        return f"CAST(len([x FOR x IN toks IF x IN (':', '?', '!')]) AS INTEGER) AS CNT_special_{s}"
    return ",\n".join(
        f"CAST(len([x FOR x IN toks IF x = '{m}']) AS INTEGER) AS CNT_{n}_{s}"
        for m, n in (("!", "exclamation"), ("?", "question"), (":", "colon"))
    )


DOCS = token_sql("documents", "doc_id", "text")


def lexicon(t: Tables):
    return ot.word_table(t.spark, LEXICON, "word string, polarity int")


def entities(t: Tables):
    return ot.word_table(t.spark, [(p,) for p in ENTITIES], "phrase string")


def stems(t: Tables):
    return ot.word_table(t.spark, STEMS, "word string, stem string")


@query("text_tokens", f"""WITH {DOCS}
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5,
CAST(len(words) AS INTEGER) AS n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM tok""")
def text_tokens(t: Tables):
    prepared = ot.add_tokens(t.texts, "text", STOP_WORDS, "desc")

    def digest(c):
        return F.md5(F.array_join(c, " ").cast("binary"))

    return prepared.select(
        "doc_id", F.size("tokens_desc").alias("n_tokens"), digest("tokens_desc").alias("tokens_md5"),
        F.size("words_desc").alias("n_words"), digest("words_desc").alias("words_md5"),
    )


@query("text_basic", f"WITH {DOCS} SELECT doc_id, {basic_sql('desc')} FROM tok")
def text_basic(t: Tables):
    prepared = ot.add_tokens(t.texts, "text", STOP_WORDS, "desc")
    columns = ot.basic_statistics("text", STOP_WORDS, "desc")
    return rounded(prepared.select("doc_id", *[c.alias(n) for n, c in columns.items()]))


@query("text_marks", f"WITH {DOCS} SELECT doc_id, {marks_sql('desc')}, {marks_sql('title', True)} FROM tok")
def text_marks(t: Tables):
    prepared = t.texts.select("doc_id", tx.tokens("text").alias("tokens_desc"))
    columns = {**ot.mark_statistics("desc")}
    special = tx.count_marks("tokens_desc", (":", "?", "!")).alias("CNT_special_title")
    return prepared.select("doc_id", *[c.alias(n) for n, c in columns.items()], special)


@query("text_title", f"""WITH {token_sql('part', 'p_partkey', 'p_name')}
SELECT p_partkey, {basic_sql('title')}, {marks_sql('title', True)} FROM tok""")
def text_title(t: Tables):
    out = ot.text_features(t.part, "p_partkey", "p_name", "title", STOP_WORDS, title=True)
    return rounded(out.drop("tokens_title", "words_title"))


def polarity_sql(key: str, s: str, source: str = "tok", name: str = "pol") -> str:
    return f"""{name}_w AS (SELECT {key}, unnest(words) AS word FROM {source}),
{name}_c AS (SELECT {key}, count(*) FILTER (polarity > 0) AS p, count(*) FILTER (polarity < 0) AS n, count(*) AS c
  FROM {name}_w LEFT JOIN (VALUES {_values(LEXICON)}) AS lex(word, polarity) USING (word) GROUP BY {key}),
{name} AS (SELECT {key}, coalesce(p, 0) AS CNT_Pos_Words_{s}, coalesce(n, 0) AS CNT_Neg_Words_{s},
  round((coalesce(p, 0) + 0.01e0) / (coalesce(n, 0) + 0.01e0), 6) AS RATIO_PosNeg_Word_{s},
  round(coalesce(p / nullif(c, 0), 0), 6) AS PCENT_Pos_Word_{s}, round(coalesce(n / nullif(c, 0), 0), 6) AS PCENT_Neg_Word_{s}
  FROM {source} LEFT JOIN {name}_c USING ({key}))"""


@query("text_polarity", f"WITH {DOCS}, {polarity_sql('doc_id', 'desc')} SELECT * FROM pol")
def text_polarity(t: Tables):
    prepared = ot.add_tokens(t.texts, "text", STOP_WORDS, "desc")
    return rounded(ot.polarity(prepared, "doc_id", {"desc": "words_desc"}, lexicon(t)))


def entity_sql(key: str, s: str, source: str = "tok", name: str = "ent") -> str:
    return f"""{name}_p AS (SELECT {key}, toks, unnest(range(1, len(toks) + 1)) AS p FROM {source}),
{name}_n AS (SELECT {key}, p, n, array_to_string(toks[p:p + n - 1], ' ') AS phrase, len(toks) AS m
  FROM {name}_p, (VALUES (1), (2), (3)) AS len_(n) WHERE p + n - 1 <= len(toks)),
{name}_h AS (SELECT DISTINCT {key}, unnest(range(p, p + n)) AS covered FROM {name}_n WHERE phrase IN {_list(ENTITIES)}),
{name} AS (SELECT {key}, count(covered) AS CNT_Named_Entity_{s} FROM {source} LEFT JOIN {name}_h USING ({key}) GROUP BY {key})"""


@query("text_entities", f"WITH {DOCS}, {entity_sql('doc_id', 'desc')} SELECT * FROM ent")
def text_entities(t: Tables):
    prepared = t.texts.select("doc_id", tx.tokens("text").alias("tokens_desc"))
    return ot.entity_words(prepared, "doc_id", {"desc": "tokens_desc"}, entities(t))


# Term contrast. The terms of all documents; the target of those with labels.

TERMS = f"""{DOCS},
each AS (SELECT doc_id, lower(unnest(words)) AS word FROM tok),
terms AS (SELECT doc_id, coalesce(stem, word) AS term FROM each LEFT JOIN (VALUES {_values(STEMS)}) AS s(word, stem) USING (word)),
labelled AS (SELECT term, quality <> 0 AS nonzero FROM terms JOIN labels USING (doc_id)),
pool AS (SELECT nonzero, term, count(*) AS count FROM labelled GROUP BY ALL),
freqs AS (SELECT nonzero, term, count, count / (sum(count) OVER (PARTITION BY nonzero))::DOUBLE AS freq FROM pool),
contrast AS (SELECT term, coalesce(max(freq) FILTER (nonzero), 0) - coalesce(max(freq) FILTER (NOT nonzero), 0) AS freq_diff,
  CAST(sum(count) AS BIGINT) AS count FROM freqs GROUP BY term)"""


def _terms(t: Tables):
    words = t.texts.select("doc_id", tx.clean_words(tx.tokens("text"), STOP_WORDS).alias("words"))
    return ot.normalise_terms(words, "doc_id", {"desc": "words"}, stems(t), distinct=True)


def _pool(t: Tables):
    # Labels before words: only labelled texts are split, one row each.
    docs = t.texts.join(t.labels.select("doc_id", "quality"), "doc_id")
    words = docs.select("doc_id", "quality", tx.clean_words(tx.tokens("text"), STOP_WORDS).alias("words"))
    terms = ot.normalise_terms(words, "doc_id", {"desc": "words"}, stems(t), keep=["quality"])
    return ot.term_pool(terms, "quality")


@query("term_pool", f"WITH {TERMS} SELECT nonzero, term, count, round(freq, 10) AS freq FROM freqs")
def term_pool(t: Tables):
    return rounded(_pool(t).drop("field"), 10)


@query("term_contrast", f"WITH {TERMS} SELECT term, round(freq_diff, 10) AS freq_diff, count FROM contrast")
def term_contrast(t: Tables):
    return rounded(ot.term_contrast(_pool(t)).drop("field"), 10)


@query("term_top_k", f"""WITH {TERMS} SELECT term, round(freq_diff, 10) AS freq_diff FROM
(SELECT * FROM contrast ORDER BY freq_diff DESC, term LIMIT 50)""")
def term_top_k(t: Tables):
    top = o.rank_terms(ot.term_contrast(_pool(t)).drop("field", "count"), "freq_diff", "term", 50)
    return rounded(top, 10)


@query("ranking_score", f"""WITH {TERMS},
s AS (SELECT DISTINCT doc_id, coalesce(freq_diff, 0) AS score FROM terms LEFT JOIN contrast USING (term)),
d AS (SELECT doc_id, sum(score) AS a FROM s GROUP BY doc_id)
SELECT doc_id, round(coalesce(a, 0), 8) AS RankingScore_desc FROM documents LEFT JOIN d USING (doc_id)""")
def ranking_score(t: Tables):
    scored = ot.ranking_score(_terms(t), "doc_id", ot.term_contrast(_pool(t)), {"desc": "RankingScore_desc"})
    return rounded(scored, 8)


@query("ranking_score_terms", f"""WITH {TERMS},
s AS (SELECT doc_id, freq_diff AS score FROM (SELECT DISTINCT doc_id, term FROM terms) JOIN contrast USING (term)),
d AS (SELECT doc_id, sum(score) AS a FROM s GROUP BY doc_id)
SELECT doc_id, round(coalesce(a, 0), 8) AS RankingScore_desc FROM documents LEFT JOIN d USING (doc_id)""")
def ranking_score_terms(t: Tables):
    ranking = ot.term_contrast(_pool(t))
    return rounded(ot.ranking_score(_terms(t), "doc_id", ranking, {"desc": "RankingScore_desc"}, distinct="term"), 8)


# LSA

GRAMS = f"""w AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(coalesce(text, 'NA')), '{tx.WORD_PATTERN}')
  IF NOT {HIT}] AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)"""
IDF = f"""{GRAMS},
idf AS (SELECT term, count(*) AS df, ln((1.0e0 + (SELECT count(*) FROM documents)) / (1.0e0 + count(*))) + 1 AS idf
  FROM tf GROUP BY term)"""
TFIDF = f"""{IDF},
x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, w / norm AS weight FROM x JOIN norms USING (doc_id))"""


@query("ngram_counts", f"WITH {GRAMS} SELECT doc_id, term, tf FROM tf")
def ngram_counts(t: Tables):
    return ls.ngram_counts(t.documents, "doc_id", "text", STOP_WORDS)


@query("idf_weights", f"WITH {IDF} SELECT term, df, round(idf, 8) AS idf FROM idf")
def idf_weights(t: Tables):
    counts = ls.ngram_counts(t.documents, "doc_id", "text", STOP_WORDS)
    return rounded(ls.fit_idf(counts, t.documents), 8)


@query("tfidf_weights", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 8) AS weight FROM tfidf")
def tfidf_weights(t: Tables):
    return rounded(ls.lsa_weights(t.documents, "doc_id", "text", STOP_WORDS), 8)


FIXED_DIMS = 4


def _fixed_loading(i: int):
    pair = F.substring(F.md5(F.col("term").cast("binary")), 2 * i + 1, 2)
    return F.conv(pair, 16, 10).cast("double") / F.lit(255.0) - F.lit(0.5)


@query("lsa_project_fixed", f"""WITH {TFIDF},
v AS (SELECT term, {', '.join(f"CAST('0x' || substr(md5(term), {2 * i + 1}, 2) AS BIGINT) / 255.0e0 - 0.5e0 AS v{i}" for i in range(FIXED_DIMS))} FROM idf),
p AS (SELECT doc_id, {', '.join(f'sum(weight * v{i}) AS s{i}' for i in range(FIXED_DIMS))} FROM tfidf JOIN v USING (term) GROUP BY doc_id)
SELECT doc_id, {', '.join(f'round(coalesce(s{i}, 0), 6) AS SVD_text_{i + 1}' for i in range(FIXED_DIMS))}
FROM documents LEFT JOIN p USING (doc_id)""")
def lsa_project_fixed(t: Tables):
    blocks = ls.lsa_blocks(t.documents, "doc_id", "text", STOP_WORDS)
    terms = blocks.terms.select("term").distinct()
    loadings = terms.select("term", F.array(*[_fixed_loading(i) for i in range(FIXED_DIMS)]).alias("loadings"))
    return rounded(ls.project(blocks, t.documents, loadings, "doc_id", FIXED_DIMS, "SVD_text"))


COMPONENTS = 100


@query("lsa_project")
def lsa_project(t: Tables):
    return rounded(ls.lsa(t.documents, "doc_id", "text", STOP_WORDS, k=COMPONENTS, n_iter=2))


def _title_points(t: Tables):
    return ls.lsa(t.part, "p_partkey", "p_name", STOP_WORDS, k=COMPONENTS, prefix="SVD_title")


@query("lsa_project_title")
def lsa_project_title(t: Tables):
    return rounded(_title_points(t))


# Part names have fewer different values than there are components, so nothing is cut off and products are exact.
TITLE_TFIDF = TFIDF.replace("documents", "part").replace("doc_id", "p_partkey").replace("coalesce(text,", "coalesce(p_name,")


@query("lsa_title_products", f"""WITH {TITLE_TFIDF},
p AS (SELECT a.p_partkey, sum(a.weight * b.weight) AS s FROM tfidf a JOIN tfidf b ON b.p_partkey = a.p_partkey - 1 AND a.term = b.term GROUP BY ALL),
l AS (SELECT p_partkey, sum(weight * weight) AS s FROM tfidf GROUP BY ALL)
SELECT p_partkey, round(coalesce(l.s, 0), 6) AS squared_length, round(coalesce(p.s, 0), 6) AS with_previous
FROM part LEFT JOIN l USING (p_partkey) LEFT JOIN p USING (p_partkey)""")
def lsa_title_products(t: Tables):
    """Each projected title's squared length and product with the title of the part numbered one less."""
    vector = F.array(*[F.col(f"SVD_title_{i + 1}") for i in range(COMPONENTS)])
    points = materialize(_title_points(t).select("p_partkey", vector.alias("v")), "points")
    before = points.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("v").alias("w"))

    def product(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    paired = points.join(before, "p_partkey", "left")
    return paired.select(
        "p_partkey", r(product("v", "v") + 0.0).alias("squared_length"),
        r(F.coalesce(product("v", "w"), F.lit(0.0)) + 0.0).alias("with_previous"),
    )


def _title_values(t: Tables):
    blocks = ls.lsa_blocks(t.part, "p_partkey", "p_name", STOP_WORDS, ls.SVD_BYTES)
    values, _ = ls.fit_svd(blocks, "p_partkey", k=COMPONENTS)
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    return t.spark.createDataFrame(rows, "component int, singular_value double")


@query("lsa_singular_values")
def lsa_singular_values(t: Tables):
    return _title_values(t).select("component", r("singular_value").alias("singular_value"))


@query("lsa_singular_moments", f"""WITH {TITLE_TFIDF},
gram AS (SELECT a.term AS x, b.term AS y, sum(a.weight * b.weight) AS s FROM tfidf a JOIN tfidf b USING (p_partkey) GROUP BY ALL)
SELECT round((SELECT sum(weight * weight) FROM tfidf), 4) AS squares, round((SELECT sum(s * s) FROM gram), 2) AS fourth_powers""")
def lsa_singular_moments(t: Tables):
    """All singular values, by their sums of squares and of fourth powers."""
    s = F.col("singular_value")
    return _title_values(t).agg(r(F.sum(s * s), 4).alias("squares"), r(F.sum(F.pow(s, 4.0)), 2).alias("fourth_powers"))


# A Cyrillic letter for each Latin one, so that the rules meet words of the given texts.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопюрстувшщыя"


def _stem_sql(word: str) -> str:
    """The stem rules step by step; ``word`` names a table with a column word."""
    def cut(c: str, pattern: str, keep: str = "") -> str:
        return f"regexp_replace({c}, '{pattern}', '{keep}')"

    one = r"\1"
    return f"""
a AS (SELECT word, regexp_extract(word, '{st.HEAD_PATTERN}') AS head, length(regexp_extract(word, '{st.SECOND_PATTERN}')) AS start FROM {word}),
b AS (SELECT *, substr(word, length(head) + 1) AS rest FROM a),
c AS (SELECT *, {cut('rest', st.GERUND_PATTERN, one)} AS gerund, {cut('rest', '(ся|сь)$')} AS bare FROM b),
d AS (SELECT *, {cut('bare', st.ADJECTIVE_PATTERN)} AS adjective, {cut('bare', st.VERB_PATTERN, one)} AS verb FROM c),
e AS (SELECT *, CASE WHEN gerund <> rest THEN gerund WHEN adjective <> bare THEN {cut('adjective', st.PARTICIPLE_PATTERN, one)}
  WHEN verb <> bare THEN verb ELSE {cut('bare', st.ending(st.NOUN))} END AS first FROM d),
f AS (SELECT *, {cut('first', 'и$')} AS second FROM e),
g AS (SELECT *, {cut('second', st.ending(st.DERIVED))} AS derived FROM f),
h AS (SELECT *, CASE WHEN start > 0 AND length(head) + length(derived) >= start THEN derived ELSE second END AS third FROM g),
i AS (SELECT *, {cut('third', st.ending(st.SUPERLATIVE))} AS superlative FROM h),
j AS (SELECT *, CASE WHEN superlative <> third THEN {cut('superlative', 'нн$', 'н')} WHEN ends_with(third, 'нн') THEN {cut('third', 'нн$', 'н')}
  ELSE {cut('third', 'ь$')} END AS last FROM i)
SELECT word, CASE WHEN head = '' THEN word ELSE head || last END AS stem FROM j"""


@query("rule_stems", f"""WITH w AS (
SELECT DISTINCT translate(lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))), '{LATIN}', '{CYRILLIC}') AS word FROM documents),{_stem_sql('w')}""")
def rule_stems(t: Tables):
    """Stems by rule of every different word of the texts, its letters read as Cyrillic ones."""
    words = t.texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    read = words.select(F.translate(F.lower("w"), LATIN, CYRILLIC).alias("word")).distinct()
    return read.withColumn("stem", st.russian_stem("word"))
