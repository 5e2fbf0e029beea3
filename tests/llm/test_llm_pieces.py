import os
import random
import struct

import llm_fixtures as fixtures
import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import pieces

ODD_TEXTS = [
    "", " ", "  a  b ", "tab\tand\n\nlines\r\n", "日本語テスト 😀 é", "▁▁ a▁b", "aaaaaaa ---- ====== ....... !!!", "<s> </s> <unk> <0x41>",
    "a b c", "\x00\x01 control", "ﬁ ligature ① Ⅷ", "x" * 3000, "Ünïcödé " * 50,
]


def message(*fields):
    """Bytes of a protobuf message from (number, value) fields."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def unigram_model(trim=True, fallback=True):
    """A unigram model put together by hand."""
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    names += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    words = ["▁", "▁the", "▁cat", "▁c", "at", "a", "t", "h", "e", "c", "s", "▁s", "he", "▁sat", "th", "▁▁", "o", "n", "on", "▁on"]
    names += [(w, -2.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = [(1, message((1, n), (2, s), (3, k))) for n, s, k in names]
    trainer = message((3, 1), (4, len(names)), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    normaliser = message((1, "identity"), (2, b""), (3, 1), (4, int(trim)), (5, 1))
    return message(*body, (2, trainer), (3, normaliser))


@pytest.fixture(scope="module")
def codec():
    with open(pieces.default_model(), "rb") as file:
        return pieces.Codec(file.read())


def test_bpe_parity_and_round_trip(codec):
    judge = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert codec.encode(ODD_TEXTS) == judge.encode(ODD_TEXTS)
    for text, row in zip(ODD_TEXTS, codec.rows(ODD_TEXTS), strict=True):
        assert row[2] and (row[3] or "▁" in text), text
    assert codec.model.kind == pieces.BPE and codec.model.marks_only_lead()


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_parity(trim, fallback):
    data = unigram_model(trim, fallback)
    codec = pieces.Codec(data)
    texts = ["the cat sat", "  the   cat ", "cathesonat", "", "tt hh ee", "on the cat on the sat", "zebra é" if fallback else "zebra"]
    assert codec.model.kind == pieces.UNIGRAM
    assert codec.encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)


def test_words_apart_equal_whole_texts(codec):
    rng = random.Random(3)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "▁", "é", "日", "😀", ".", "\t", "ing", "Un"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert codec.apart
    by_words, whole = codec.rows(texts), codec._whole(texts)
    assert [r[0].tolist() for r in by_words] == [r[0].tolist() for r in whole]
    assert [r[1:] for r in by_words] == [r[1:] for r in whole]
    codec.ids.clear()
    codec.REMEMBERED = 100
    again = [r for i in range(0, 1500, 50) for r in codec.rows(texts[i:i + 50])]
    assert [r[0].tolist() for r in again] == [r[0].tolist() for r in whole]


@pytest.mark.parametrize("trim", [True, False])
def test_unigram_words_apart(trim):
    codec = pieces.Codec(unigram_model(trim))
    # One piece is two markers, so words still stand apart.
    texts = ["the cat sat", "  the   cat ", "on  the", "", " ", "zebra ▁ the"]
    assert codec.apart and [r[:2] for r in _lists(codec.rows(texts))] == [r[:2] for r in _lists(codec._whole(texts))]


def _lists(rows):
    return [(r[0].tolist(), *r[1:]) for r in rows]


def test_other_model_types_are_refused():
    data = unigram_model() + message((2, message((3, 3))))
    with pytest.raises(ValueError, match="not a unigram or BPE"):
        pieces.PieceModel.parse(data).tokenizer()


def test_table_and_decoding(spark, odd, none):
    rows = pieces.tokenise(odd).collect()
    texts = {d: t or "" for d, t, *_ in fixtures.odd_rows()}
    assert len(rows) == len(fixtures.odd_rows())
    judge = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for r in rows:
        assert r.ids == judge.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.parity and r.round_trip
        assert r.n_bytes == sum(judge.is_byte(i) for i in r.ids)
    back = pieces.tokenise(odd)
    back = back.select("doc_id", pieces.decoded(back).alias("text")).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    assert pieces.tokenise(none).count() == 0


def test_model_path_is_a_parameter(spark, tmp_path):
    path = os.path.join(tmp_path, "own.model")
    with open(path, "wb") as file:
        file.write(unigram_model())
    df = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.tokenise(df, model_path=path).collect()}
    assert got == {1: sentencepiece.SentencePieceProcessor(model_file=path).encode("the cat"), 2: []}
    assert df.select(F.lit(1)).count() == 2


def test_ids_are_those_of_the_tokenizers_library(monkeypatch):
    class Judged(list):
        pass

    class Judge:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, texts, num_threads=1):
            return [Judged(x) for x in self.inner.encode(texts, num_threads=num_threads)]

        def piece_to_id(self, piece):
            return self.inner.piece_to_id(piece)

    packed, seen, codec = pieces._packed, [], pieces.Codec(unigram_model())
    codec.judge = Judge(codec.judge)
    monkeypatch.setattr(pieces, "_packed", lambda ids: seen.append(type(ids)) or packed(ids))
    assert all(r[2] for r in codec.rows(["the cat sat", "on the cat"])) and seen and Judged not in seen
    # An encoder that is wrong everywhere is repaired, and parity tells.
    codec.ids.clear()
    codec.of_words = pieces.tokenizers.Tokenizer(pieces.models.BPE({"<unk>": 0}, [], unk_token="<unk>"))
    want = codec.judge.inner.encode("the cat sat")
    ids, _, parity, _ = codec.rows(["the cat sat"])[0]
    assert ids.tolist() == want and not parity
