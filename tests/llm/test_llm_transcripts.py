import itertools
import random

import llm_fixtures as fixtures
import numpy as np

from tablewright.llm import transcripts as tr

TURNS = "conv_id long, turn long, role string, text string"


def talk(n=160):
    rng = random.Random(7)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "du"], 200)
    rows = []
    for c in range(n):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * rng.randint(1, 3)
        for t, role in enumerate(roles):
            lines = [fixtures.sentence(rng, rng.randint(3, 9), words) for _ in range(3 if role == "assistant" else 1)]
            rows.append((c, t, role, "\n".join(lines) + ("?" if role == "user" else ".")))
    return rows


def test_roles_and_texts_come_back(spark):
    rows = talk()
    got = tr.recover(spark.createDataFrame(rows, TURNS)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 160 and len(held) > 30
    assert sum(r.roles_right and r.texts_right for r in held) >= 0.95 * len(held)
    right = next(r for r in got if r.roles_right and r.texts_right)
    own = [(x[2], x[3]) for x in rows if x[0] == right.conv_id]
    assert right.rendered == "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in own)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    states = 6
    model = tr.Model(
        np.log(rng.random(states)), np.log(rng.random((states, states))),
        [{"user": np.log(rng.random(states))}, {}, {str(i): np.log(rng.random(states)) for i in range(5)}, {"?": np.log(rng.random(states))}],
        [np.log(rng.random(states)) for _ in range(4)],
    )
    lines = ["User: hi", "", "what is that?", "a much longer line of text that says nothing"]

    def weight(path):
        total = model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))
        return total + sum(t.get(v, u)[s] for s, x in zip(path, lines, strict=True) for t, u, v in zip(model.tables, model.unknown, tr.features(x), strict=True))

    best = max(itertools.product(range(states), repeat=len(lines)), key=weight)
    assert tuple(model.viterbi(lines)) == best


def test_long_conversations_are_cut_and_odd_rows_have_results(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(150)]
    rows += [(2, 0, None, None), (2, 1, "assistant", ""), (None, None, "user", "no conversation"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "tool", "x\n" * 500)]
    got = tr.recover(fixtures.clashing(spark.createDataFrame(rows, TURNS))).collect()
    parts = sorted((r.part, r.n_turns) for r in got if r.conv_id == 1)
    assert parts == [(0, 64), (1, 64), (2, 22)]
    assert {r.conv_id: r.n_turns for r in got if r.conv_id != 1} == {2: 2, None: 1, 3: 1, 4: 1}
    assert tr.recover(spark.createDataFrame([], TURNS)).count() == 0
    model = tr.train(tr.conversations(spark.createDataFrame([], TURNS)))
    assert model.parse(None) == ([], []) and model.parse("") == ([], []) and model.parse("a\nb")[0]


def test_rows_with_the_same_turn_or_without_keys_are_kept(spark, join_mode):
    rows = [(3, 0, "user", x) for x in "abca"] + [(3, 1, "assistant", "d"), (5, None, "user", "e"), (5, None, "user", "f"), (5, 0, "user", "g")]
    rows += [(None, 0, "user", "h"), (None, 0, "user", "h"), (None, 0, "user", "i"), (None, None, "assistant", "j")]
    got = tr.conversations(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    found = sorted((r.conv or 0, -1 if r.branch is None else r.branch, r.part, [t.text for t in r.turns]) for r in got)
    assert found == [
        (0, -1, -1, ["j"]), (0, -1, 0, ["h"]), (0, -1, 0, ["h"]), (0, -1, 0, ["i"]),
        (3, 0, 0, ["a", "d"]), (3, 1, 0, ["b"]), (3, 2, 0, ["c"]), (5, 0, -1, ["e"]), (5, 0, 0, ["g"]), (5, 1, -1, ["f"]),
    ]
