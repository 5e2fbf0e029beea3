"""Licence scans by conditional compression.

Every place where a text shares so many words in a row with a template that a
confirmed wording may stand there is looked at first, whatever surrounds it
and however its lines are wrapped: few differences leave a long enough run of
equal words, so no such wording is missed. What is left is searched by blocks.

A candidate block is a run of sentences with licence vocabulary. It is
compressed alone, and once with each template as a raw zstandard dictionary;
what a template saves says how much of the block it explains. Templates are
ranked by that saving, and the best few are then compared word by word: the
one with the fewest differences wins, and is confirmed if few enough words of
the template are missing and few strange ones stand among them. Words before
and after the template's wording belong to the text around and count for
nothing. Ties go to the better saving, then to the longer template.

Texts without licence vocabulary are sorted out by a regular expression before
anything is sent to Python; the rest is one pass inside the tasks of the scan.
Compression contexts are made once in a worker; memory is bounded by a batch.

Defined results: null, empty and other texts without licence vocabulary have
no rows. A block that no template explains has a row with a null licence.
Repeated rows are scanned as often as they occur. Long texts are scanned
whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches
from tablewright.llm.license_texts import TEMPLATES

#: Words that make a sentence a candidate; also read by Spark's regular expressions.
CUES = (
    r"(?i)licen[sc]|copyright|\bwarrant|merchantab|sublicens|redistribut|hereby granted|free of charge|"
    r"rights reserved|public domain|spdx|\bmpl\b|\bgpl\b|\bcc[ -]by\b|\bcc0\b|noninfring|liab(?:le|ility)|permission"
)
_CUE = re.compile(CUES)
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)")
_WORD = re.compile(r"[\w./+-]*\w")
SCHEMA = (
    "start int, end int, license string, confirmed boolean, alone int, conditional int, reduction double, ranked array<string>, "
    "n_template int, n_missing int, n_extra int, differences string"
)


@dataclass(frozen=True)
class Settings:
    #: Sentences without licence words that may stand inside a block.
    gap: int = 2
    #: Least saving, in shares of the block's own size, to be considered.
    least_reduction: float = 0.2
    #: Templates whose wording is compared.
    compared: int = 5
    #: Most differing words, as a share of the template's.
    most_different: float = 0.1
    level: int = 9


def blocks(text: str, gap: int) -> list[tuple[int, int]]:
    """Start and end of every run of candidate sentences; with a gap below 0, of every such sentence."""
    found: list[list[int]] = []
    since = gap + 1
    for m in _SENTENCE.finditer(text):
        if not m.group().strip():
            continue
        if not _CUE.search(m.group()):
            since += 1
            continue
        if found and since <= gap:
            found[-1][1] = m.end()
        else:
            found.append([m.start(), m.end()])
        since = 0
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in found]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Scanner:
    """Templates with their compression contexts."""

    def __init__(self, templates: Mapping[str, str], settings: Settings):
        self.settings = settings
        own = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=settings.level, **own)
        self.words = {name: _WORD.findall(normal(t)) for name, t in templates.items()}
        self.with_template = {
            name: zstandard.ZstdCompressor(
                level=settings.level, dict_data=zstandard.ZstdCompressionDict(normal(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **own,
            )
            for name, t in templates.items()
        }
        self.place = {name: i for i, name in enumerate(sorted(templates, key=lambda n: (-len(templates[n]), n)))}
        # A wording with at most d differences falls into at most d + 1 runs of equal words.
        self.allowed = {name: int(settings.most_different * len(w)) for name, w in self.words.items()}
        self.run = {name: max(1, -(-(len(w) - self.allowed[name]) // (self.allowed[name] + 1))) for name, w in self.words.items() if w}
        self.gram = min(self.run.values(), default=1)
        self.seeds: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, run in self.run.items():
            for i in range(len(self.words[name]) - run + 1):
                self.seeds.setdefault(tuple(self.words[name][i:i + self.gram]), []).append((name, i))

    def ranked(self, block: str) -> tuple[int, list[tuple[str, int]]]:
        """Size alone, and (template, size with it), the greatest saving first."""
        data = normal(block).encode()
        sizes = [(name, len(c.compress(data))) for name, c in self.with_template.items()]
        return len(self.plain.compress(data)), sorted(sizes, key=lambda x: (x[1], self.place[x[0]]))

    def differences(self, name: str, block: str) -> tuple[int, int, str, tuple[int, int]]:
        """Template words that are missing, strange words among the others, both as text, and where the wording stands."""
        found = list(_WORD.finditer(block))
        words, template = [m.group().lower() for m in found], self.words[name]
        steps = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        same = [s for s in steps if s[0] == "equal"]
        span = (found[same[0][3]].start(), found[same[-1][4] - 1].end()) if same else (0, len(block))
        missing = extra = 0
        shown = []
        for kind, i, j, a, b in steps:
            if kind == "equal":
                continue
            # Beyond either end of the template is not its wording.
            around = (i == j == 0) or (i == j == len(template))
            strange = [] if around or kind == "delete" else words[a:b]
            if kind == "replace" and (i == 0 or j == len(template)):
                strange = strange[-(j - i):] if i == 0 else strange[:j - i]
            missing += j - i
            extra += len(strange)
            shown += [f"-{w}" for w in template[i:j]] + [f"+{w}" for w in strange]
        return missing, extra, " ".join(shown), span

    def judge(self, block: str) -> tuple[tuple[int, int], tuple]:
        """Where the winner's wording stands in the block, and the fields after ``end``."""
        alone, sizes = self.ranked(block)
        best = [(n, size) for n, size in sizes if alone - size >= self.settings.least_reduction * alone][:self.settings.compared]
        if not best:
            return (0, len(block)), (None, False, alone, sizes[0][1] if sizes else alone, 0.0, [], 0, 0, 0, None)
        compared = [(*self.differences(n, block), size, n) for n, size in best]
        missing, extra, shown, span, size, name = min(
            compared, key=lambda c: ((c[0] + c[1]) / len(self.words[c[5]]), c[4], self.place[c[5]]),
        )
        n = len(self.words[name])
        good = missing + extra <= self.settings.most_different * n
        row = name, good, alone, size, (alone - size) / alone, [x for x, _ in best], n, missing, extra, shown
        return span if good else (0, len(block)), row

    def places(self, text: str) -> list[tuple[str, int, int]]:
        """Template, start and end of every stretch that shares a run of words with it, long enough for a confirmed wording."""
        words = _WORD.findall(text.lower())
        begins: dict[str, set[int]] = {}
        for p, gram in enumerate(zip(*(words[i:] for i in range(self.gram)), strict=False)):
            for name, i in self.seeds.get(gram, ()):
                run = self.run[name]
                if words[p:p + run] == self.words[name][i:i + run]:
                    begins.setdefault(name, set()).add(p - i)
        if not begins:
            return []
        at = [m.span() for m in _WORD.finditer(text)]
        found = []
        for name, starts in begins.items():
            n, slack = len(self.words[name]), self.allowed[name]
            group: list[int] = []
            for s in [*sorted(starts), None]:
                # Differences shift the begin by no more than their number.
                if group and (s is None or s - group[0] > slack):
                    a, b = max(0, group[0] - slack), min(len(at), group[-1] + n + slack)
                    found.append((name, at[a][0], at[b - 1][1]))
                    group = []
                group.append(s)
        return found

    def wordings(self, text: str) -> list[tuple[int, int, tuple]]:
        """Start, end and fields of the confirmed wordings at :meth:`places`, the fewest differences first where they overlap."""
        likely = []
        for name, a, b in self.places(text):
            missing, extra, shown, (start, end) = self.differences(name, text[a:b])
            n = len(self.words[name])
            if missing + extra <= self.settings.most_different * n:
                likely.append(((missing + extra) / n, self.place[name], a + start, a + end, (n, missing, extra, shown), name))
        taken: list[tuple[int, int, tuple]] = []
        for _, _, start, end, told, name in sorted(likely):
            if any(start < y and x < end for x, y, _ in taken):
                continue
            alone, sizes = self.ranked(text[start:end])
            best = [n for n, size in sizes if alone - size >= self.settings.least_reduction * alone][:self.settings.compared]
            size = dict(sizes)[name]
            taken.append((start, end, (name, True, alone, size, (alone - size) / alone, best if name in best else [name, *best], *told)))
        return taken

    def scan(self, text: str | None) -> list[tuple]:
        """A row for every wording.

        What stands before and after a confirmed one is judged again. A run
        that is none as a whole may hold one in a single sentence.
        """
        if not text or not _CUE.search(text):
            return []
        rows, open_blocks = [], []
        end = 0
        for a, b, row in [*sorted(self.wordings(text), key=lambda w: w[0]), (len(text), len(text), None)]:
            if _CUE.search(text[end:a]):
                open_blocks += [(end + x, end + y) for x, y in blocks(text[end:a], self.settings.gap)]
            if row:
                rows.append((a, b, *row))
            end = b
        while open_blocks:
            a, b = open_blocks.pop()
            (start, end), row = self.judge(text[a:b])
            sentences = [] if row[1] else [(a + x, a + y) for x, y in blocks(text[a:b], -1)]
            if len(sentences) > 1 and any(self.judge(text[x:y])[1][1] for x, y in sentences):
                open_blocks += sentences
                continue
            rows.append((a + start, a + end, *row))
            for left, right in ((a, a + start), (a + end, b)):
                if _CUE.search(text[left:right]):
                    open_blocks += [(left + x, left + y) for x, y in blocks(text[left:right], self.settings.gap)]
        return sorted(rows)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """key and the fields of ``SCHEMA``, a row for every candidate block of every text."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, settings)
        for texts in batches:
            yield pd.Series([[dict(zip(names, row, strict=True)) for row in scanner.scan(t)] for t in texts])

    likely = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(CUES))
    return likely.select(F.col("key").alias(key), F.explode(scanned("text")).alias("_b")).select(key, "_b.*")
