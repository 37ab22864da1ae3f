"""The query language: words are AND-ed; | joins alternatives; * and ? are wildcards, ~N fuzzy, % grammatical affixes."""

from __future__ import annotations

import re
from dataclasses import dataclass

MOST_EDITS, MOST_OPTIONAL, SHORTEST_ANCHOR = 3, 4, 2
#: Letters that a star may stand for: before the anchor, after it, on both sides together.
BEFORE, AFTER = 3, 4


@dataclass(frozen=True)
class Pattern:
    """One alternative of a slot."""

    text: str
    wildcard: bool = False
    fuzzy: bool = False
    edits: int = 1
    prefixes: bool = False
    suffixes: bool = False

    @property
    def kind(self) -> str:
        """How it is expanded: fuzzy before wildcard before grammar before literal."""
        return (
            "fuzzy" if self.fuzzy else "wildcard" if self.wildcard else "grammar" if self.prefixes or self.suffixes else "literal"
        )


def normalise(word: str) -> str:
    return re.sub(r"[^a-zא-ת*?]", "", re.sub("[A-Z]", lambda m: m[0].lower(), word))


def parse_word(word: str) -> Pattern | None:
    before, after = word.startswith("%"), word.endswith("%")
    word = word[1:] if before else word
    word = word[:-1] if after and word else word
    fuzzy = re.fullmatch(r"(.*)~([1-9]?)", word, re.DOTALL)
    text = normalise(fuzzy[1] if fuzzy else word)
    if not text:
        return None
    star, wildcard = "*" in text, "*" in text or "?" in text
    edits = min(int(fuzzy[2] or 1), MOST_EDITS) if fuzzy else 1
    return Pattern(text, wildcard, bool(fuzzy) and not wildcard, edits, before and not star, after and not star)


def parse(query: str | None) -> list[list[Pattern]]:
    """The slots of a query, each with its alternatives. Words without letters vanish, and do not end a row of |."""
    slots: list[list[Pattern]] = []
    joined = False
    for word in re.split(r"[ \t\r\n]+", (query or "").replace("|", " | ")):
        if word == "|":
            joined = True
        elif word and (p := parse_word(word)):
            if joined and slots:
                slots[-1].append(p)
            else:
                slots.append([p])
            joined = False
    return slots


def literal_terms(query: str) -> list[str]:
    """All alternatives' texts in order, wildcards as written."""
    return [p.text for slot in parse(query) for p in slot]


def anchor(text: str) -> int:
    return len(text) - text.count("*") - text.count("?")


def optional_forms(text: str) -> list[str] | None:
    """Every reading of ?, which makes the letter before it optional; None for too many. A ? without a letter before it
    says nothing; of several in a row each may take one letter more."""
    if len(re.findall(r"(?<=[^*?])\?", text)) > MOST_OPTIONAL:
        return None
    forms = [""]
    for c in text:
        if c != "?":
            forms = [f + c for f in forms]
        else:
            forms = [x for f in forms for x in ([f, f[:-1]] if f and not f.endswith("*") else [f])]
    return list(dict.fromkeys(forms))
