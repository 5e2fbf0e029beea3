"""SentencePiece models run by the tokenizers library.

The model file is a protobuf message; the few fields that matter are read from
its wire format. From them a tokenizers pipeline is rebuilt: the normaliser
(the compiled character map, white space rules and the marker that stands for
a space), the vocabulary with its scores, as a unigram model or as the merges
of a BPE model, and bytes for characters without a piece. Batches are encoded
by the library's own threads.

Parity is verified, not assumed: everything is also encoded by the
sentencepiece library and compared id by id, and ids are decoded again and
compared with the text. Where the two differ, the ids of sentencepiece are
returned and ``parity`` is false, so the result always is that of the model.
If the vocabulary lets words be encoded apart, this is done once for each
different word of a batch instead of each text.

Defined results: null and empty texts give no ids and decode to ``''``. A long
text is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from importlib import import_module
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import decoders, models, normalizers, pre_tokenizers

from tablewright.llm.common import small_batches

MARK = "▁"
SCHEMA = "ids array<int>, n_bytes int, parity boolean, round_trip boolean"

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

#: Values of the model file's enumerations.
UNIGRAM, BPE = 1, 2
UNKNOWN, CONTROL, BYTE = 2, 3, 6


def default_model() -> str:
    """Path of the public model of the machine this runs on; a parameter everywhere."""
    return import_module("public_tokenizers").path("piece_bpe_32k.model")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, i


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of every field of a protobuf message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            if kind == 2:
                n, i = _varint(data, i)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    char_map: bytes
    dummy_prefix: bool
    trim_spaces: bool
    mark_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, 1)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        return cls(
            pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
            bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        )

    @cached_property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def marks_only_lead(self) -> bool:
        """No ordinary piece has a marker after another character, so words can be encoded apart."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind not in (UNKNOWN, CONTROL, BYTE))

    def merges(self) -> list[tuple[str, str]]:
        """Merges of a BPE model, best score first: every way to cut a piece in two known ones."""
        score = {p: s for p, s, kind in self.pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
        place = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = []
        for piece, s in score.items():
            for i in range(1, len(piece)):
                if piece[:i] in score and piece[i:] in score:
                    found.append((-s, place[piece], i, piece[:i], piece[i:]))
        return [(l, r) for _, _, _, l, r in sorted(found)]

    def tokenizer(self) -> tokenizers.Tokenizer:
        if self.kind == UNIGRAM:
            vocabulary = [(p, s) for p, s, _ in self.pieces]
            model = models.Unigram(vocabulary, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unknown = self.pieces[self.unknown][0]
            model = models.BPE(ids, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is not a unigram or BPE model")
        out = tokenizers.Tokenizer(model)
        steps: list = []
        if self.char_map:
            steps.append(normalizers.Precompiled(self.char_map))
        if self.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(tokenizers.Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.mark_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.mark_spaces and self.marks_only_lead():
            out.pre_tokenizer = pre_tokenizers.Split(tokenizers.Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        back: list = [decoders.Replace(MARK, " ")] if self.mark_spaces else []
        back += [decoders.ByteFallback()] if self.byte_fallback else []
        out.decoder = decoders.Sequence([*back, decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def is_byte(self) -> np.ndarray:
        return np.array([kind == BYTE for _, _, kind in self.pieces])


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    """Encoder, decoder and the library they are held against.

    Where no piece has a marker after another character, the words of a text
    are encoded independently of each other, by either library. Then a word is
    encoded, compared and decoded once, and remembered: equal words need no
    second look, and every word of every text is verified all the same.
    """

    #: Words that a worker remembers newly; reached, those not seen since the last time are let go.
    REMEMBERED = 75_000
    #: New words that are compared at once.
    RUN = 500
    #: Threads of a worker, unless RAYON_NUM_THREADS says otherwise.
    THREADS = 2

    def __init__(self, data: bytes):
        # The library's threads are off in forked processes unless asked for.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.THREADS))
        self.model = PieceModel.parse(data)
        self.own = self.model.tokenizer()
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = self.model.is_byte()
        self.apart = self.model.mark_spaces and self.model.dummy_prefix and self.model.marks_only_lead()
        self.of_words = self.model.tokenizer()
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = None
        # Pieces that begin with a marker; where words are apart, a word has one, and it is the word's first.
        self.leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.plain = not self.model.char_map and not self.model.trim_spaces
        self.ids: dict[str, bytes] = {}  # 32-bit ids, one after another
        self.before: dict[str, bytes] = {}  # those remembered before the last time the limit was reached
        self.differ: set[str] = set()
        self.lossy: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids by the tokenizers library, of whole texts."""
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def normal(self, text: str) -> str:
        if self.plain:
            return f" {text}".replace(" ", MARK) if text else ""
        return self.own.normalizer.normalize_str(text)

    def learn(self, words: list[str]) -> None:
        """Encode new words with both libraries, compare them word by word, and decode them again.

        Words one after another are a text, so a run of them is decoded at
        once; only a run that differs somewhere is decoded word by word.
        """
        single = [w for w in words if not w.strip(MARK)]
        words = [w for w in words if w.strip(MARK)]
        # The marker in front of a word is the one that sentencepiece puts there itself.
        texts = [w[1:].replace(MARK, " ") for w in words]
        judged = self.judge.encode(texts, num_threads=1)
        runs = [slice(i, i + self.RUN) for i in range(0, len(words), self.RUN)]
        own = self.of_words.encode_batch_fast([words[r] for r in runs], is_pretokenized=True, add_special_tokens=False)
        for r, e in zip(runs, own, strict=True):
            kept = self._keep_run(words[r], judged[r], e.ids)
            if self.own.decode(kept, skip_special_tokens=False) != " ".join(texts[r]):
                self._look_back(words[r], [np.frombuffer(self.ids[w], dtype=np.int32).tolist() for w in words[r]])
        if single:
            # A lone marker, as at the end of a text, which sentencepiece would not put before nothing.
            judged = self.judge.encode([w[1:].replace(MARK, " ") for w in single], num_threads=1)
            kept = self._keep(single, [j if w != MARK else [self.judge.piece_to_id(MARK)] for w, j in zip(single, judged, strict=True)])
            self._look_back(single, kept)

    def _keep_run(self, words: list[str], judged: list[list[int]], own: list[int]) -> list[int]:
        """Remember the ids of a run of words; ``own`` are those of the tokenizers library, one word after another.

        Two equal sequences with one leading marker a word are equal word by
        word. Any other run is encoded and compared by word.
        """
        flat = np.fromiter(chain.from_iterable(judged), dtype=np.int32)
        ends = np.cumsum(np.fromiter(map(len, judged), dtype=np.int64, count=len(judged)))
        starts = ends - np.fromiter(map(len, judged), dtype=np.int64, count=len(judged))
        found = np.array(own, dtype=np.int32)
        if np.array_equal(found, flat) and (starts < ends).all() and self.leads[flat].sum() == len(words) and self.leads[flat[starts]].all():
            data = _packed(own)
            for w, a, b in zip(words, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                self.ids[w] = data[a:b]
            return own
        return list(chain.from_iterable(self._keep(words, judged)))

    def _keep(self, words: list[str], judged: list[list[int]]) -> list[list[int]]:
        """Remember the ids of the tokenizers library, or those of sentencepiece for words where the two differ."""
        kept = []
        for w, e, b in zip(words, self.of_words.encode_batch_fast(words, add_special_tokens=False), judged, strict=True):
            a = e.ids
            if a != b:
                self.differ.add(w)
                a = b
            self.ids[w] = _packed(a)
            kept.append(a)
        return kept

    def _look_back(self, words: list[str], ids: list[list[int]]) -> None:
        for w, text in zip(words, self.own.decode_batch(ids, skip_special_tokens=False), strict=True):
            if text != w[1:].replace(MARK, " "):
                self.lossy.add(w)

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """ids, byte ids, parity and round trip of each text; the ids are the model's where the two differ."""
        plain = ["" if t is None else t for t in texts]
        # Spaces are trimmed before they become markers, so a marker in the text itself cannot be taken for one.
        whole = [not self.apart or (self.model.trim_spaces and MARK in t) for t in plain]
        by_words = iter(self._by_words([t for t, w in zip(plain, whole, strict=True) if not w]))
        at_once = iter(self._whole([t for t, w in zip(plain, whole, strict=True) if w]))
        return [next(at_once if w else by_words) for w in whole]

    def _by_words(self, texts: list[str]) -> list[tuple]:
        normal = [self.normal(t) for t in texts]
        words = [_WORDS.findall(n) for n in normal]
        if len(self.ids) > self.REMEMBERED:
            self.before, self.ids = self.ids, {}
            for kept in (self.differ, self.lossy):
                kept.intersection_update(self.before)
        new = set().union(*words).difference(self.ids)
        for w in new.intersection(self.before):
            self.ids[w] = self.before[w]
        new = list(new.difference(self.before))
        self.learn(new)
        out = []
        for t, n, w in zip(texts, normal, words, strict=True):
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, w)), dtype=np.int32)
            parity = not self.differ or self.differ.isdisjoint(w)
            same = (MARK not in t if self.plain else n[1:].replace(MARK, " ") == t) and (not self.lossy or self.lossy.isdisjoint(w))
            out.append((ids, int(self.is_byte[ids].sum()), parity, same))
        return out

    def _whole(self, texts: list[str]) -> list[tuple]:
        ids, judged = self.encode(texts), self.judge.encode(texts, num_threads=1)
        parity = [a == b for a, b in zip(ids, judged, strict=True)]
        kept = [a if same else b for a, b, same in zip(ids, judged, parity, strict=True)]
        back = self.own.decode_batch(kept, skip_special_tokens=False)
        arrays = [np.array(x, dtype=np.int32) for x in kept]
        return [(x, int(self.is_byte[x].sum()), p, d == t) for t, x, p, d in zip(texts, arrays, parity, back, strict=True)]


_codecs: dict[str, Codec] = {}


def _codec(data: bytes) -> Codec:
    """The codec of this worker for a model, which outlives a task."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(data)
    return _codecs[name]


def encoded(docs: DataFrame, text: str = "text", model_path: str | None = None) -> Column:
    """Struct of ids, bytes used for unknown characters, parity and round trip of the text column."""
    with open(model_path or default_model(), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf(SCHEMA)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        for texts in batches:
            yield pd.DataFrame(codec.rows(list(texts)), columns=["ids", "n_bytes", "parity", "round_trip"])

    return encode(F.col(text))


def decoded(df: DataFrame, ids: str = "ids", model_path: str | None = None) -> Column:
    """Text of an array of ids."""
    with open(model_path or default_model(), "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for rows in batches:
            yield pd.Series(codec.own.decode_batch([[] if x is None else list(x) for x in rows], skip_special_tokens=False))

    return decode(F.col(ids))


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, ids, n_tokens, n_bytes, parity and round_trip of every row, then the columns of ``keep``; others are not read."""
    small_batches(docs.sparkSession, 200)
    rows = docs.select(key, *keep, encoded(docs, text, model_path).alias("_e")).select(key, *keep, "_e.*")
    return rows.select(key, "ids", F.size("ids").alias("n_tokens"), "n_bytes", "parity", "round_trip", *keep)
