import random
from collections import Counter

import llm_fixtures as fixtures
import pytest
from pyspark.sql import functions as F

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import mixing


def edf(units):
    """One period by a plain earliest-deadline-first loop."""
    period, done, order = sum(units.values()), dict.fromkeys(units, 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // u), s) for s, u in units.items() if done[s] < u and done[s] * period // u <= t]
        s = min(ready)[1]
        done[s] += 1
        order.append(s)
    return order


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 30, "b": 1, "c": 17, "d": 9, "e": 2}, {f"s{i:02}": i + 1 for i in range(12)}])
def test_period_is_edf_and_never_a_block_off(spark, units):
    df = spark.createDataFrame(list(units.items()), "source string, units int")
    got = {r.slot: r.source for r in mixing.period_slots(df).collect()}
    order = edf(units)
    assert [got[t] for t in range(len(order))] == order
    period, done = len(order), Counter()
    for t, s in enumerate(order):
        done[s] += 1
        for name, u in units.items():
            assert abs(done[name] - (t + 1) * u / period) < 1


def test_schedule_places_every_document_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaabbc")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    units = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, units int")
    settings = mixing.Settings(block_rows=4)
    got = mixing.schedule(df, units=units, settings=settings).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        assert r.released <= r.slot < r.due
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    for s in "abc":
        full = Counter(r.block for r in got if r.source == s)
        assert sorted(full) == list(range(len(full))) and all(full[b] == 4 for b in range(len(full) - 1))
    # While all sources last, every prefix has the shares but for less than a block.
    most = min(max(r.slot for r in got if r.source == s) for s in "abc")
    for t in range(most):
        for s, u in (("a", 5), ("b", 3), ("c", 2)):
            n = len({r.block for r in got if r.source == s and r.slot <= t})
            assert abs(n - (t + 1) * u / 10) < 1


def test_the_order_does_not_depend_on_partitions(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(300)]
    a, b = (spark.createDataFrame(rows, "doc_id long, source string").repartition(n) for n in (1, 7))
    assert sorted(mixing.schedule(a).collect()) == sorted(mixing.schedule(b).collect())


def test_mix_writes_the_order(spark, odd, tmp_path):
    out = mixing.mix(odd, settings=mixing.Settings(block_rows=2))
    assert out.columns == odd.columns and out.count() == odd.count()
    place = {(r.doc_id, r.source or ""): (r.slot, r.place) for r in mixing.schedule(odd, settings=mixing.Settings(block_rows=2)).collect()}
    order = [place[r.doc_id, r.source or ""] for r in out.collect()]
    assert order == sorted(order)


def test_defined_results(spark, odd, none):
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0
    # Two rows of source a and key 4 are one document.
    assert mixing.schedule(odd).count() == len(fixtures.odd_rows()) - 1
    units = spark.createDataFrame([("a", 1)], "source string, units int")
    with pytest.raises(Exception, match="no weight for source"):
        mixing.schedule(odd, units=units).collect()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    plan = mixing.schedule(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.schedule(df).agg(F.sum("units")).first()[0] == 1000
