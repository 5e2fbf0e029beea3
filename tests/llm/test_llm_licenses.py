import textwrap

import llm_fixtures as fixtures

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import licenses
from tablewright.llm.license_texts import TEMPLATES


def scanner():
    return licenses.Scanner(TEMPLATES, licenses.Settings())


def test_every_template_is_found_by_its_own_wording():
    s = scanner()
    for name, text in TEMPLATES.items():
        rows = s.scan(f"Some other prose stands here.\n{text}\nAnd more of it follows.")
        found = [r for r in rows if r[3]]
        assert [r[2] for r in found] == [name], (name, rows)
        assert found[0][8:11] == (len(s.words[name]), 0, 0) and found[0][11] == ""


def test_small_changes_are_told_and_large_ones_not_confirmed():
    s = scanner()
    text = TEMPLATES["MIT"].replace("modify", "change").replace("free of charge, ", "")
    row = s.scan(text)[0]
    assert row[2:4] == ("MIT", True) and row[9] == 4 and row[10] == 1
    assert set(row[11].split()) == {"-free", "-of", "-charge", "-modify", "+change"}
    other = s.scan("You need a permission and a license from somebody who is not here to use this.")
    assert other and not any(r[3] for r in other)


def test_near_names_are_told_apart_by_wording():
    s = scanner()
    for name in ("CC-BY-4.0-notice", "CC-BY-NC-4.0-notice", "CC-BY-SA-4.0-notice", "GPL-2.0-notice", "LGPL-3.0-notice", "AGPL-3.0-notice"):
        assert [r[2] for r in s.scan(TEMPLATES[name].upper()) if r[3]] == [name]


def test_several_wordings_in_a_run():
    text = f"{TEMPLATES['MIT-notice']}\n{TEMPLATES['Apache-2.0-notice']}\n{TEMPLATES['ISC']} All rights reserved."
    rows = [r for r in scanner().scan(text) if r[3]]
    assert [r[2] for r in rows] == ["MIT-notice", "Apache-2.0-notice", "ISC", "all-rights-reserved"]
    assert all(text[r[0]:r[1]] for r in rows) and all(a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_table(spark, odd, none):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    long = "word " * 40_000
    rows = [(1, long + "\n" + TEMPLATES["MIT-notice"]), (1, TEMPLATES["MIT-notice"]), (None, "Copyright. All rights reserved."), (3, None)]
    df = fixtures.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got if r.confirmed) == [(0, "all-rights-reserved"), (1, "MIT-notice"), (1, "MIT-notice")]
    assert max(r.start for r in got) == len(long) + 1


def test_wrapped_wordings_are_confirmed_whatever_surrounds_them():
    s = scanner()
    prose = "The weather was fine and nobody spoke of rules.\n" * 40
    for name, text in TEMPLATES.items():
        for width in (40, 60, 78):
            for mark in ("", "# ", " * ", "// "):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
                for around in ("{}", prose + "{}\n" + prose, "no stop before {} nor a stop after " + "it goes on " * 300):
                    found = [r for r in s.scan(around.format(wrapped)) if r[3]]
                    assert [(r[2], r[9], r[10]) for r in found] == [(name, 0, 0)], (name, width, mark, found)


def test_wrapped_wordings_with_small_changes_are_confirmed():
    text = TEMPLATES["ISC"].replace("ISC", "").replace("distribute", "hand out").replace("THE AUTHOR DISCLAIMS", "THE WRITER DISCLAIMS")
    found = [r for r in scanner().scan("\n".join(textwrap.wrap(text, 60))) if r[3]]
    assert [(r[2], r[9], r[10]) for r in found] == [("ISC", 2, 3)]
