"""Stems of Russian words by region and suffix rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels, and the endings of the published Russian stemming
# algorithm. Endings of a first list count only after one of the two letters.
VOWELS = "аеиоуыэюя"
AFTER = "ая"
GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
REFLEXIVE = "ся сь"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
)
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "ейш ейше"
DERIVED = "ост ость"

HEAD_PATTERN = f"^[^{VOWELS}]*[{VOWELS}]"
#: After the first consonant that follows a vowel, twice.
SECOND_PATTERN = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}][^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"


def _any(endings: str) -> str:
    return "(" + "|".join(endings.split()) + ")"


def ending(free: str, bound: str = "") -> str:
    """Pattern of an ending; the earliest match is the longest. The letter before a bound one stays, as group 1."""
    return f"(?:([{AFTER}]){_any(bound)}|{_any(free)})$" if bound else f"{_any(free)}$"


GERUND_PATTERN = ending(GERUND[1], GERUND[0])
ADJECTIVE_PATTERN = ending(ADJECTIVE)
PARTICIPLE_PATTERN = ending(PARTICIPLE[1], PARTICIPLE[0])
VERB_PATTERN = ending(VERB[1], VERB[0])


def _cut(c: Column, pattern: str, keep: str = "") -> Column:
    return F.regexp_replace(c, pattern, keep)


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _ended(bare: Column) -> Column:
    """Without the first ending of an adjective with its participle, a verb or a noun."""
    adjective = lambda cut: F.when(cut != bare, _cut(cut, PARTICIPLE_PATTERN, "$1"))
    verb = lambda cut: F.when(cut != bare, cut)
    return F.coalesce(
        _let(_cut(bare, ADJECTIVE_PATTERN), adjective), _let(_cut(bare, VERB_PATTERN, "$1"), verb), _cut(bare, f"{_any(NOUN)}$")
    )


def _finished(third: Column) -> Column:
    """Without a superlative ending, a doubled consonant or a soft sign."""
    return _let(_cut(third, f"{_any(SUPERLATIVE)}$"), lambda cut: F.when(cut != third, _cut(cut, "нн$", "н")).when(
        third.endswith("нн"), _cut(third, "нн$", "н")
    ).otherwise(_cut(third, "ь$")))


def russian_stem(word) -> Column:
    """The stem of a word in lower case.

    Endings are looked for behind the first vowel only, so a word without one
    stays as it is. Null stays null.
    """
    plain = F.translate(F.col(word) if isinstance(word, str) else word, "ё", "е")
    head = F.regexp_extract(plain, HEAD_PATTERN, 0)
    # A derived ending has to lie in the second region of the whole word.
    start = F.length(F.regexp_extract(plain, SECOND_PATTERN, 0))

    def behind(rest: Column) -> Column:
        # Gerund; else reflexive, and the first of adjective with participle, verb, noun.
        first = _let(_cut(rest, GERUND_PATTERN, "$1"), lambda cut: F.when(cut != rest, cut).otherwise(
            _let(_cut(rest, f"{_any(REFLEXIVE)}$"), _ended)
        ))
        third = _let(_cut(first, "и$"), lambda second: _let(_cut(second, f"{_any(DERIVED)}$"), lambda cut: F.when(
            (start > 0) & (F.length(head) + F.length(cut) >= start), cut
        ).otherwise(second)))
        return _let(third, _finished)

    return F.when(head == "", plain).otherwise(F.concat(head, _let(F.substr(plain, F.length(head) + 1), behind)))
