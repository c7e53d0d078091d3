"""Which rules can match a text at all: one pass over the text for the literals of all rules.

The pass is an Aho-Corasick automaton in an Arrow UDF; where its library is missing, literals are looked for one by one.
It only narrows: patterns are matched in the JVM, but for those that the linear matcher decides on long texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.linear import LONG, decide
from sluice.functions.rules import Rule

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

_FOLD = {0x17F: "s", 0x212A: "k"}  # the long s and the Kelvin sign match s and k regardless of case


def lowered(text: str) -> str:
    return text.lower().translate(_FOLD) if not text.isascii() else text.lower()


def _literal_finder(literals: list[str]) -> Callable[[str], set[int]]:
    if ahocorasick is None:
        return lambda text: {i for i, x in enumerate(literals) if x in text}
    automaton = ahocorasick.Automaton()
    for i, x in enumerate(literals):
        automaton.add_word(x, i)
    automaton.make_automaton()
    return lambda text: {i for _, i in automaton.iter(text)}


@lru_cache(maxsize=16)
def finder(rules: tuple[Rule, ...]) -> Callable[[str], list[int]]:
    """Numbers of the gated rules that a text's literals let through, ascending."""
    literals = list(dict.fromkeys(x for r in rules for s in r.gate for x in s))
    if not literals:
        return lambda text: []
    place, find = {x: i for i, x in enumerate(literals)}, _literal_finder(literals)
    gates = [(n, [frozenset(place[x] for x in s) for s in r.gate]) for n, r in enumerate(rules) if r.gate]
    by_literal: dict[int, list[tuple[int, list[frozenset[int]]]]] = {}
    for n, sets in gates:
        for i in sets[0]:
            by_literal.setdefault(i, []).append((n, sets))

    def candidates(text: str) -> list[int]:
        there = find(lowered(text))
        return sorted({n for i in there for n, sets in by_literal.get(i, ()) if all(s & there for s in sets)})

    return candidates


def candidates(texts: Column, rules: tuple[Rule, ...], long: int = LONG) -> Column:
    """array<array<int>>: for each text of an array the numbers of the gated rules that may match it.

    A text of more than `long` characters is looked at by the linear matcher: its numbers are those of rules, gated or
    not, that Java is still to match, and -1 - number for rules that match.
    """

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def work(lists: pa.Array) -> pa.Array:
        find, ungated = finder(rules), [n for n, r in enumerate(rules) if not r.gate]
        values = lists.flatten().to_pylist()
        found = [None if t is None else find(t) for t in values]
        large = [i for i, t in enumerate(values) if t is not None and len(t) > long]
        if large:
            for i, numbers in zip(large, decide([values[i] for i in large], rules, [[*found[i], *ungated] for i in large]), strict=True):
                found[i] = numbers
        inner = pa.array(found, pa.list_(pa.int32()))
        ends, at = [0], 0
        for n in lists.value_lengths().to_pylist():
            at += n or 0
            ends.append(at)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)

    return work(texts)
