import os
import random
from collections import defaultdict

import llm_fixtures as fixtures
import numpy as np
import pytest

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import packing

SMALL = packing.Settings(row_tokens=64, pool_tokens=4000)


def brute(lengths, capacity):
    """Rooms left by best-fit-decreasing, trying every open row."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(1, 70)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == brute(lengths, capacity)
    with pytest.raises(ValueError, match="for rows of"):
        packing.best_fit_decreasing([5], 4)


def encoder():
    from importlib import import_module

    return packing.encoding(packing.default_ranks(), import_module("public_tokenizers").PATTERN)


def test_matrices_hold_all_tokens(spark, odd):
    packed = packing.pack(odd, settings=SMALL).cache()
    want = defaultdict(list)
    for d, t, *_ in fixtures.odd_rows():
        want[d].append(encoder().encode_ordinary(t or ""))
    got, n = defaultdict(list), 0
    for m in packed.collect():
        ids = np.frombuffer(m.input_ids, "<u2").reshape(m.n_rows, 64)
        positions = np.frombuffer(m.position_ids, "<u2").reshape(m.n_rows, 64)
        names = iter(zip(m.keys, m.starts, strict=True))
        for r, ends in enumerate(m.cu_seqlens):
            assert ends[0] == 0 and (ids[r, ends[-1]:] == SMALL.pad).all() and not positions[r, ends[-1]:].any()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                assert positions[r, a:b].tolist() == list(range(b - a))
                key, start = next(names)
                got[key].append((start, ids[r, a:b].tolist()))
                n += b - a
        assert m.n_tokens == sum(e[-1] for e in m.cu_seqlens)
    assert n == sum(len(x) for docs in want.values() for x in docs)
    for key, docs in want.items():
        if len(docs) == 1:
            assert [i for _, piece in sorted(got[key]) for i in piece] == docs[0]
            assert all(len(p) == 64 for _, p in sorted(got[key])[:-1])
        else:
            assert sorted(i for _, piece in got[key] for i in piece) == sorted(i for x in docs for i in x)
    assert sorted((r.key or -1, r.start, tuple(r.ids)) for r in packing.segments(packed, SMALL).collect()) == sorted((k or -1, s, tuple(p)) for k, v in got.items() for s, p in v)


def test_files(spark, odd, tmp_path):
    packed = packing.pack(odd, settings=SMALL).cache()
    path = str(tmp_path / "matrices")
    manifest = packing.write_matrices(packed, path).collect()
    rows = {f"matrix-{m.task:06d}-{m.number:06d}": m for m in packed.collect()}
    assert {m.name for m in manifest} == set(rows)
    for name, m in rows.items():
        read = lambda suffix, n=name: open(os.path.join(path, f"{n}.{suffix}"), "rb").read()  # noqa: E731, SIM115
        assert read("ids") == bytes(m.input_ids) and read("pos") == bytes(m.position_ids)
        assert np.frombuffer(read("cu"), "<i4").tolist() == [x for ends in m.cu_seqlens for x in ends]


def test_special_strings_are_text_and_empty_tables_pack_to_nothing(spark, none):
    df = spark.createDataFrame([(None, "<|endoftext|> a"), (2, None)], "doc_id long, text string")
    m = packing.pack(df, settings=SMALL).collect()
    assert len(m) == 1 and m[0].keys == [None] and m[0].n_tokens == len(encoder().encode_ordinary("<|endoftext|> a"))
    assert packing.pack(none).count() == 0
