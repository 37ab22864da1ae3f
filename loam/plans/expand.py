"""Expansion of patterns over the vocabulary, as predicates on its `term` column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.hebrew import grammar_forms, spelling_variants
from loam.plans.query import AFTER, BEFORE, SHORTEST_ANCHOR, Pattern, anchor, optional_forms

#: Terms that a plan lists on the driver for ids alone; ids of a query that stands for more are found without a list.
MOST_TERMS = 100_000
#: Slots whose marks one long holds.
MARKS = 62


class TooManyTerms(ValueError):
    """A query stands for more terms than were to be listed."""


def star_predicate(text: str, term: Column) -> Column | None:
    """Terms that a pattern with * fits; None if its anchor is too short."""
    n = anchor(text)
    if n < SHORTEST_ANCHOR:
        return None
    first, last = text.startswith("*"), text.endswith("*")
    extra = BEFORE + AFTER if first and last else BEFORE if first else AFTER
    inner = text.strip("*")
    if "*" in inner:
        fits = term.rlike("^" + re.sub(r"\*+", ".*", text) + "$")
    elif first and last:
        fits = term.contains(inner)
    elif first:
        fits = term.endswith(inner)
    elif last:
        fits = term.startswith(inner)
    else:
        fits = term == inner
    return fits & (F.length(term) - n <= extra)


def wildcard_predicate(text: str, term: Column) -> Column | None:
    if "?" not in text:
        return star_predicate(text, term)
    forms = optional_forms(text)
    if forms is None:
        return None
    plain = [f for f in forms if "*" not in f and len(f) >= SHORTEST_ANCHOR]
    found = [p for f in forms if "*" in f and (p := star_predicate(f, term)) is not None]
    found += [term.isin(plain)] if plain else []
    return reduce(or_, found) if found else None


def fuzzy_predicate(text: str, edits: int, term: Column) -> Column:
    """Terms within the edits that share an n-gram with the text (trigrams, bigrams of three letters, all of fewer)."""
    n = 3 if len(text) >= 4 else 2 if len(text) == 3 else len(text)
    grams = dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1))
    shares = reduce(or_, [term.contains(g) for g in grams])
    return shares & F.levenshtein(term, F.lit(text), edits).between(0, edits)


def grammar_predicate(p: Pattern, term: Column) -> Column:
    return term.isin(grammar_forms(p.text, p.prefixes, p.suffixes))


def predicate(p: Pattern, term: Column) -> Column | None:
    """What an alternative takes from the vocabulary; None: nothing can fit."""
    return {
        "fuzzy": lambda: fuzzy_predicate(p.text, p.edits, term),
        "wildcard": lambda: wildcard_predicate(p.text, term),
        "grammar": lambda: grammar_predicate(p, term),
        "literal": lambda: term == p.text,
    }[p.kind]()


def expand(vocab: DataFrame, p: Pattern) -> DataFrame:
    """(term) of the vocabulary that an alternative stands for."""
    found = predicate(p, F.col("term"))
    return vocab.select("term").where(F.lit(False) if found is None else found)


@dataclass
class Plan:
    """An expanded query: each slot's terms. hopeless: no document can match. slots_asked counts dropped slots too."""

    slots: list[list[str]] = field(default_factory=list)
    slots_asked: int = 0
    hopeless: bool = False

    def slot_of(self) -> dict[str, int]:
        """Each term's first slot, as proximity counts it."""
        first: dict[str, int] = {}
        for i, terms in enumerate(self.slots):
            for t in terms:
                first.setdefault(t, i)
        return first


def plan(slots: list[list[Pattern]], vocab: DataFrame, variants: bool = False, most: int | None = None) -> Plan:
    """Expands a query. One job filters the vocabulary by all alternatives that need it, and its terms reach the driver:
    TooManyTerms if they are more than `most`. A fuzzy alternative without terms makes the query hopeless; wildcards and
    affixes without terms are skipped, and a slot left without any is dropped; a literal always stays (with its spellings,
    if asked)."""
    asked = [p for slot in slots for p in slot if p.kind != "literal"]
    tests = {p: t for p in dict.fromkeys(asked) if (t := predicate(p, F.col("term"))) is not None}
    found: dict[Pattern, list[str]] = {p: [] for p in asked}
    if tests:
        flags = [t.alias(f"p{i}") for i, t in enumerate(tests.values())]
        rows = vocab.select("term", *flags).where(reduce(or_, [F.col(f"p{i}") for i in range(len(tests))])).orderBy("term")
        listed = (rows if most is None else rows.limit(most + 1)).collect()
        if most is not None and len(listed) > most:
            raise TooManyTerms(f"more than {most} terms")
        for row in listed:
            for i, p in enumerate(tests):
                if row[f"p{i}"]:
                    found[p].append(row["term"])
    out = Plan(slots_asked=len(slots), hopeless=not slots)
    for slot in slots:
        terms: dict[str, None] = {}
        for p in slot:
            if p.kind == "literal":
                terms.update(dict.fromkeys([p.text, *(spelling_variants(p.text) if variants else [])]))
            elif p.kind == "fuzzy" and not found[p]:
                return Plan(slots_asked=len(slots), hopeless=True)
            else:
                terms.update(dict.fromkeys(found[p]))
        if terms:
            out.slots.append(list(terms))
    out.hopeless = not out.slots
    return out


def marked(slots: list[list[Pattern]], vocab: DataFrame, variants: bool = False) -> tuple[DataFrame, int] | None:
    """What plan decides, without a list of terms: (term, m0, m1, ...), with a bit for each slot that a term stands in,
    MARKS to a column, and the number of slots; None if no document can match. A flag for each alternative is all that
    reaches the driver."""
    term = F.col("term")
    asked = [p for slot in slots for p in slot if p.kind != "literal"]
    tests = {p: t for p in dict.fromkeys(asked) if (t := predicate(p, term)) is not None}
    flags = vocab.agg(*[F.bool_or(t).alias(f"p{i}") for i, t in enumerate(tests.values())]).first() if tests else ()
    held = {p for p, some in zip(tests, flags, strict=True) if some}
    if any(p.kind == "fuzzy" and p not in held for p in asked):
        return None
    fits = []
    for slot in slots:
        own = [tests[p] for p in slot if p in held]
        own += [term.isin([p.text, *(spelling_variants(p.text) if variants else [])]) for p in slot if p.kind == "literal"]
        if own:
            fits.append(reduce(or_, own))
    if not fits:
        return None
    bits = [F.when(f, F.lit(1 << i % MARKS)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(fits)]
    marks = [reduce(add, bits[k : k + MARKS]).alias(f"m{k // MARKS}") for k in range(0, len(bits), MARKS)]
    return vocab.where(reduce(or_, fits)).select("term", *marks), len(fits)
