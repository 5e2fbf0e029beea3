"""Records in byte ranges against the reader that takes a file to a task."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources import records as sr
from tablewright.sources import tables as st

SCHEMA = T.StructType().add("id", "long").add("text", "string").add("word", "string")


def body(n, header=True, end="\n"):
    """Quoted breaks, doubled quotes, quotes and breaks at the ends of fields, blank lines, Windows breaks inside quotes."""
    texts = ['a\nb', 'say ""x""', '"\n"', '\n\n', 'plain', '""', 'é\n日本\n"" ""\n', 'x' * 37, '\r\nwin', '']
    rows = ["id,text,word"] if header else []
    for i in range(n):
        text = texts[i % len(texts)].replace('""', '\0').replace('"', '').replace('\0', '""')
        rows.append(f'{i},"{text}",w{i % 7}')
        if i % 11 == 0:
            rows.append("")
    return end.join(rows) + end


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("parts", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n"), (7, "\n"), (19, "\n"), (50, "\r\n")])
def test_equals_the_multi_line_reader(spark, tmp_path, parts, end):
    path = os.path.join(tmp_path, "a.csv")
    data = body(120, end=end).encode()
    with open(path, "wb") as file:
        file.write(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-len(data) // parts)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        n = sr._lines(spark, path).select("start").distinct().count()
        assert n == parts or parts > 30 and n > 25
        found = got(sr.read_records(spark, path, SCHEMA))
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    want = got(st.read_items(spark, path, SCHEMA, multiline=True))
    assert len(want) == 120 and found == want


def test_one_record_over_many_ranges_and_many_files(spark, tmp_path, join_mode):
    long = "line\n" * 400
    for name, rows in (("a", f'id,text,word\n1,"{long}",x\n2,short,y\n'), ("b", 'id,text,word\n3,"p\nq",z'), ("c", "id,text,word\n"), ("d", "")):
        with open(os.path.join(tmp_path, f"{name}.csv"), "w") as file:
            file.write(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sr.read_records(spark, str(tmp_path), SCHEMA, columns=["word", "text"]).orderBy("word").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in rows] == [("x", long), ("y", "short"), ("z", "p\nq")]


def test_malformed_and_headless(spark, tmp_path):
    path = os.path.join(tmp_path, "a.csv")
    with open(path, "w") as file:
        file.write('1,"a\nb",x\nnot,"c\nd",y\n2,,z\n')
    df = sr.read_records(spark, path, SCHEMA, header=False, keep_malformed=True)
    rows = {r.word: r for r in df.collect()}
    assert (rows["x"].id, rows["x"].text, rows["x"][st.CORRUPT]) == (1, "a\nb", None)
    assert rows["y"][st.CORRUPT] == 'not,"c\nd",y' and rows["z"].text is None
    assert df.where(F.col("id") == 2).count() == 1
