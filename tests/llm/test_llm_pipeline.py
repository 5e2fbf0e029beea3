import os

import duckdb
import llm_fixtures as fixtures
import pytest
import sentencepiece
import test_llm_language as test_language
import test_llm_neardup as test_neardup
import zstandard

import __spark_entry__ as contract
import corpus_pipeline
from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import language, mixing, pieces, quality

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mix_sources", "sentencepiece"]
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    packer, limits = zstandard.ZstdCompressor(level=3), quality.Limits()
    rows = []
    for r in docs.collect():
        lang, score = model.predict(r.text)
        if lang != "und" and score >= 0.5 and quality.judge(r.text, limits, packer)[-1]:
            rows.append((r.doc_id, r.text))
    first = test_neardup.brute(rows, 5)
    judge = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {d: judge.encode(t) for d, t in rows if first[d] == d}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_the_mixture_reaches_the_last_stage(spark, odd, none):
    mixed = corpus_pipeline.mix_sources(spark, odd, "")
    # Another layout of the files must not matter.
    got = corpus_pipeline.encode_pieces(spark, mixed.repartition(5), "").collect()
    units = {r.source: r.units for r in mixing.units_by_size(odd).collect()}
    rows = [(r.doc_id, r.source or "") for r in odd.collect()]
    place = {(r.doc_id, r.source or ""): (r.slot, r.place) for r in mixing.schedule(odd).collect()}
    assert sorted(((r.doc_id or 0), r.slot, r.place) for r in got) == sorted(((d or 0), *place[d, s]) for d, s in rows)
    assert len(got) == len(rows) and len({r.slot for r in got}) >= len(units) > 1
    empty = corpus_pipeline.encode_pieces(spark, none, "")
    assert empty.columns[-2:] == ["slot", "place"] and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op6_near_duplicates", "op7_mix_sources", "op9_warc"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    want = sorted((tuple(dict(zip([d[0] for d in found.description], r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    df = contract.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_corpus_has_languages(spark):
    assert language.identify(test_language.corpus(spark, 30)).count() == 30 and fixtures.odd_rows()
