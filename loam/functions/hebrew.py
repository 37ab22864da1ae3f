"""Hebrew affixes, and spelling variants with and without vowel letters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

VAV, YOD = "ו", "י"

# Affixes of grammatical expansion, suffixes that keep their spelling, affixes of the term dictionary.
GRAMMAR_PREFIXES = "ולכש ומהש ובשה ובש ולש וכש ומש ולכ ומה ושה ולה וכה מהש לכש וב וכ ול ומ וש וה מה שה לה כש מש לכ ו ב כ ל מ ש ה".split()
GRAMMAR_SUFFIXES = "יכם יכן יהם יהן ימו ינו ותי ותם ותן יות כם כן הם הן תם תן ים ות ין ית ון יו יה יך יי תי נו י ך ו ה ת".split()
KEPT_SUFFIXES = "ויות יות ות ין ים ית ון תי נו כם כן הם הן ך ה".split()
LEXICON_PREFIXES = "וכשה ושה ושב וכש וה וב ול וכ ומ וש בה לה מה שב של שה כש ו ה ב ל כ מ ש י ת א נ".split()
LEXICON_SUFFIXES = "ית אי ון תי נו ים ות כם כן ם ן י ו ה ת נ".split()
MOST_VARIANTS, MOST_GAPS = 40, 4


def grammar_forms(word: str, prefixes: bool, suffixes: bool) -> list[str]:
    """The word, and the word with each affix asked for (both kinds: also with one of each)."""
    before = ["", *GRAMMAR_PREFIXES] if prefixes else [""]
    after = ["", *GRAMMAR_SUFFIXES] if suffixes else [""]
    return list(dict.fromkeys(a + word + b for a, b in product(before, after)))


def is_letter(c: str) -> bool:
    return "א" <= c <= "ת"


def spelling_variants(term: str, most: int = MOST_VARIANTS) -> list[str]:
    """Other spellings of a term: vowel letters (vav, yod) inside its stem left out one at a time, all left out, put into
    up to four gaps of what is left, and put after the consonants of the stem. A known suffix stays as it is, and vowel
    letters at the stem's ends count as consonants. `most` is a soft limit: the first two kinds ignore it."""
    if len(term) < 2:
        return []
    suffix = next((s for s in KEPT_SUFFIXES if term.endswith(s) and len(term) > len(s)), "")
    stem = term[: len(term) - len(suffix)]
    vowels = [i for i in range(1, len(stem) - 1) if stem[i] in (VAV, YOD)]
    bare = "".join(c for i, c in enumerate(stem) if i not in vowels)
    # where the bare stem has a consonant: vowel letters left in it stand at the ends of the stem
    anchors = [i for i, c in enumerate(bare) if is_letter(c)]
    found: dict[str, None] = {}

    def add(form: str) -> None:
        if form + suffix != term and len(form + suffix) >= 2:
            found.setdefault(form + suffix)

    for i in vowels:
        add(stem[:i] + stem[i + 1 :])
    if len(anchors) >= 2:
        if bare + suffix != term:
            found.setdefault(bare + suffix)
        for form in _filled(bare, anchors[: min(len(anchors) - 1, MOST_GAPS)]):
            if len(found) >= most:
                break
            if form + suffix != term:
                found.setdefault(form + suffix)
    for i, c in enumerate(stem[:-1]):
        if len(found) >= most:
            break
        if is_letter(c) and c not in (VAV, YOD):
            for v in (VAV, YOD):
                if stem[i + 1] != v:
                    add(stem[: i + 1] + v + stem[i + 1 :])
    return list(found)


def _filled(bare: str, gaps: list[int]) -> Iterator[str]:
    """bare with nothing, vav or yod after each of the places, the first place changing fastest, but never after two
    neighbouring places."""
    for turned in product(("", VAV, YOD), repeat=len(gaps)):
        choice = dict(zip(gaps, reversed(turned), strict=True))
        used = [g for g in gaps if choice[g]]
        if used and all(b != a + 1 for a, b in zip(used, used[1:], strict=False)):
            yield "".join(c + choice.get(i, "") for i, c in enumerate(bare))


def strip_prefixes(word: str) -> tuple[str, list[str]]:
    """The word without dictionary prefixes, the longest first, as long as one fits; and those taken."""
    taken: list[str] = []
    by_length = sorted(LEXICON_PREFIXES, key=len, reverse=True)
    while p := next((p for p in by_length if word.startswith(p)), ""):
        taken.append(p)
        word = word[len(p) :]
    return word, taken


def strip_suffixes(word: str) -> tuple[str, list[str]]:
    """The word without dictionary suffixes, each length's in turn as often as it fits; and those taken, in word order."""
    taken: list[str] = []
    for s in sorted(LEXICON_SUFFIXES, key=len, reverse=True):
        while word.endswith(s):
            taken.insert(0, s)
            word = word[: len(word) - len(s)]
    return word, taken


def strip_affixes(word: str) -> tuple[str, list[str], list[str]]:
    rest, before = strip_prefixes(word)
    root, after = strip_suffixes(rest)
    return root, before, after


def joined(root: str, prefixes: list[str], suffixes: list[str]) -> str:
    return "".join(prefixes) + root + "".join(suffixes)


def is_prefix(s: str) -> bool:
    return s in LEXICON_PREFIXES


def is_suffix(s: str) -> bool:
    return s in LEXICON_SUFFIXES


def is_affix(s: str) -> bool:
    return is_prefix(s) or is_suffix(s)
