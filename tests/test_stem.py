"""Stems against published pairs of a word and its stem."""

from pyspark.sql import functions as F

from tablewright.functions.stem import russian_stem
from tablewright.operators.text import normalise_terms, stem_table

# Pairs from the published sample vocabulary of the algorithm.
PAIRS = """
в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон
важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн важное важн важной важн
важном важн важному важн важности важност важностию важност важность важност важностью важност важную важн важны важн
важные важн важный важн важным важн важных важн вазах ваз вазы ваз вакса вакс вакханка вакханк вал вал валандался валанда
валентина валентин валериановых валерианов валерию валер валетами валет
п п па па пава пав павел павел павильон павильон павильонам павильон павла павл павлиний павлин павлиньи павлин павлиньим павлин
павлович павлович павловна павловн павловне павловн павловной павловн павловну павловн павловны павловн павловцы павловц
павлыч павлыч павлыча павлыч пагубная пагубн падает пада падай пада падал пада падала пада падаль падал падать пада падаю пада
падают пада падающего пада падающие пада падеж падеж падение паден падением паден паденье паден паденья паден падет падет
падут падут падучая падуч падчерицей падчериц падчерицы падчериц
""".split()


def test_published_pairs(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    df = spark.createDataFrame(pairs, "word string, want string").withColumn("got", russian_stem("word"))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []


def test_other_words(spark):
    df = spark.createDataFrame([(w,) for w in ("", "table", "123", "ёлка", "ель", None, "взъерошившись")], "word string")
    got = [r[0] for r in df.select(russian_stem("word")).collect()]
    assert got == ["", "table", "123", "елк", "ел", None, "взъерош"]


def test_terms_take_the_rules_and_the_table_first(spark):
    df = spark.createDataFrame([(1, ["Вагоны", "вагонов", "Table"]), (2, ["вагон", "мыши"]), (3, [])], "k int, w array<string>")
    override = spark.createDataFrame([("мыши", "mouse")], "word string, stem string")
    terms = normalise_terms(df, "k", {"title": "w"}, stem_table(df, {"title": "w"}, override))
    got = sorted((r.k, r.term) for r in terms.collect() if r.term)
    assert got == [(1, "table"), (1, "вагон"), (1, "вагон"), (2, "mouse"), (2, "вагон")]
    assert terms.where("term IS NULL").count() == 1
    # Each different word is stemmed once.
    assert stem_table(df, {"title": "w"}).count() == 5
    assert stem_table(df, {"title": "w"}).where(F.col("word") == "мыши").first().stem == "мыш"
