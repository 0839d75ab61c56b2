"""One pass over a name for all rules: an Aho-Corasick automaton of the rules' words, with the leftmost match and the rules' order.

A rule is (class, pattern) as for price_class. Patterns made of plain words, with word borders and optional letters, go
into the automaton, so that the cost of a name does not grow with the number of rules; the few others are searched one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantrygrid.functions import prices

#: An alternative that the automaton holds: borders, and letters that each may be optional.
_PLAIN = re.compile(r"(\\b)?((?:[\w ,'&/-]\??)+)(\\b)?")


def words_of(pattern: str) -> list[tuple[str, bool, bool]] | None:
    """(word, border before, border after) of all that a pattern matches; None where it is no list of plain words."""
    out = []
    for part in pattern.split("|"):
        m = _PLAIN.fullmatch(part)
        if not m:
            return None
        found = [""]
        for letter, maybe in re.findall(r"(.)(\??)", m[2]):
            found = [w + letter for w in found] + (found if maybe else [])
        if len(found) > 64 or not all(w and (not m[1] or _letter(w[0])) and (not m[3] or _letter(w[-1])) for w in found):
            return None
        out += [(w.lower(), bool(m[1]), bool(m[3])) for w in found]
    return out


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


class Rules:
    """Rules in their order, those of first before all others."""

    def __init__(self, rules: tuple[tuple[str, str], ...], first: tuple[tuple[str, str], ...] = ()):
        import ahocorasick

        self.keys = [k for k, _ in (*first, *rules)]
        self.first, self.others = len(first), []
        words: dict[str, list[tuple[int, bool, bool]]] = {}
        for order, (_, pattern) in enumerate((*first, *rules)):
            plain = words_of(pattern)
            if plain is None:
                self.others.append((order, re.compile(pattern, re.I)))
            for word, before, after in plain or ():
                words.setdefault(word, []).append((order, before, after))
        self.automaton = ahocorasick.Automaton()
        for word, said in words.items():
            self.automaton.add_word(word, (len(word), said))
        if words:
            self.automaton.make_automaton()

    def of(self, text: str) -> str | None:
        """The class of a lower-case text."""
        early, best = None, None
        for end, (size, said) in self.automaton.iter(text) if len(self.automaton) else ():
            start = end - size + 1
            free = (start == 0 or not _letter(text[start - 1])), (end + 1 == len(text) or not _letter(text[end + 1]))
            for order, before, after in said:
                if before and not free[0] or after and not free[1]:
                    continue
                if order < self.first:
                    early = order if early is None else min(early, order)
                elif best is None or (start, order) < best:
                    best = start, order
        for order, pattern in self.others:
            if order < self.first:
                if (early is None or order < early) and pattern.search(text):
                    early = order
            elif m := pattern.search(text):
                best = min(best or (m.start(), order), (m.start(), order))
        return self.keys[early] if early is not None else self.keys[best[1]] if best else None


@lru_cache(maxsize=8)
def _built(rules: tuple, first: tuple) -> Rules:
    """Once in each worker."""
    return Rules(rules, first)


def price_class(name: Column, section: Column, rules: list[tuple[str, str]], first: list[tuple[str, str]] = ()) -> Column:
    """As prices.price_class_of: by the name, which tells more, else by the section; null where no rule holds."""
    said = tuple(map(tuple, rules)), tuple(map(tuple, first))

    def run(names: pd.Series, sections: pd.Series) -> pd.Series:
        table, seen = _built(*said), {}

        def of(text: str) -> str | None:
            if text not in seen:  # names of a batch repeat
                seen[text] = table.of(text)
            return seen[text]

        return pd.Series([of(n) or of(s) for n, s in zip(names, sections)], dtype=object)

    return F.pandas_udf(run, T.StringType())(prices.plain(name), prices.plain(section))
