import base64
import random
import re
from collections import Counter

import llm_fixtures as fixtures
import zstandard

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The base columns, straight from their definition."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "\x0b", "\x1c", " ", " ", "#", "|", "ab ab ab "]) for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(text) == brute(text), repr(text)


def test_every_row_has_a_verdict(odd, none):
    rows = quality.quality_table(odd).collect()
    texts = [r[1] for r in fixtures.odd_rows()]
    assert len(rows) == len(texts)
    by_text = {t: brute(t) for t in texts}
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((d, *by_text[t]) for d, t, *_ in fixtures.odd_rows())
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all(r.base_failed and not r.kept and r.reason == "base" for r in empty)
    assert quality.quality_table(none).count() == 0


def test_bands_reject_repetition_and_noise_and_keep_prose():
    rng = random.Random(2)
    words = fixtures.words_of_language(rng, ["an", "ber", "co", "du", "en", "fi", "gor", "hu"], 2000)
    packer, limits = zstandard.ZstdCompressor(level=3), quality.Limits()
    for n in (60, 400, 3000, 20000):
        prose = fixtures.sentence(rng, n, words)
        assert quality.judge(prose, limits, packer)[-1], n
    # Few distinct words in ever new order: no window repeats often, yet it compresses well.
    phrase = [fixtures.sentence(rng, 40, words) for _ in range(3)]
    repeated = " ".join(f"{rng.choice(phrase)} {i}" for i in range(200))
    assert quality.compression(repeated, limits, packer)[-1] == "repetitive"
    noise = base64.b85encode(rng.randbytes(6000)).decode()
    noise = " ".join(noise[i:i + 9] for i in range(0, len(noise), 9))
    row = quality.judge(noise, limits, packer)
    assert not row[-1] and row[-2] == "incompressible"
    half = fixtures.sentence(rng, 4000, words) + " " + "x y " * 6000
    assert quality.compression(half, limits, packer)[-1] in ("repetitive", "repetitive chunks")


def test_chunks_cover_the_whole_text():
    limits, packer = quality.Limits(chunk_bytes=100), zstandard.ZstdCompressor()
    assert quality.compression("é" * 175, limits, packer)[2] == 4
    assert quality.compression("", limits, packer)[:3] == (0, None, 0)


def test_keep_good_keeps_columns_and_rows(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    want = sum(r.kept for r in quality.quality_table(odd).collect())
    assert kept.count() == want > 0
    assert quality.keep_good(none).count() == 0
