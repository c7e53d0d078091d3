"""Rules decided in linear time, for long texts: Java's matcher backtracks, so a hostile text could hold a task up.

Patterns become those of a linear-time matcher (RE2, by way of Arrow). Its classes are spelled out as Unicode's. Its word
boundaries are ASCII's, which is exact on ASCII texts; on others a rule with boundaries is first looked for without them,
which can only find more, and what is found is left to Java.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

from sluice.functions.rules import Rule

#: Characters of the longest text that Java matches without a look by this module.
LONG = 8192

_SPACE, _DIGIT = r"\t-\r\x{85}\p{Z}", r"\p{Nd}"
# Letters, letter numbers, marks, other alphabetic symbols, digits, connectors, joiners.
_WORD = r"\p{L}\p{Nl}\p{M}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\p{Nd}\p{Pc}\x{200C}\x{200D}"
_CLASSES = {"s": _SPACE, "d": _DIGIT, "w": _WORD}
_TOKEN = re.compile(r"\[\\s\\S\]|\\.|\[\^?|\]|[^\\\[\]]+", re.S)


def translated(pattern: str, boundaries: bool = True) -> str:
    """`pattern` for the linear matcher, with its word boundaries or without."""
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        if token == r"[\s\S]" and not inside:
            out.append("(?s:.)")
        elif token[0] == "\\" and token[1] in _CLASSES:
            out.append(_CLASSES[token[1]] if inside else f"[{_CLASSES[token[1]]}]")
        elif token[0] == "\\" and token[1].lower() in _CLASSES:
            if inside:
                raise ValueError(f"{token} in a class")
            out.append(f"[^{_CLASSES[token[1].lower()]}]")
        elif token == r"\b" and not inside:
            out.append(r"\b" if boundaries else "")
        elif token in ("[", "[^") and not inside:
            inside = True
            out.append(token)
        elif token in ("[", "[^"):
            out.append(token.replace("[", r"\["))
        elif token == "]" and inside:
            inside = False
            out.append(token)
        else:
            out.append(token)
    return "".join(out)


@lru_cache(maxsize=None)
def _patterns(rule: Rule) -> tuple[str, str, bool] | None:
    """(exact on ASCII texts, finding no less on any, whether that is exact too); None for what the matcher can't take."""
    try:
        exact, loose = translated(rule.pattern), translated(rule.pattern, False)
        pc.match_substring_regex(pa.array([""]), pattern=exact)
        pc.match_substring_regex(pa.array([""]), pattern=loose)
    except (ValueError, pa.ArrowInvalid):
        return None
    return exact, loose, exact == loose


def decide(texts: list[str], rules: tuple[Rule, ...], possible: Iterable[Iterable[int]]) -> list[list[int]]:
    """For each text the numbers of `possible` rules still to be matched by Java, and -1 - number of those that match."""
    by_rule: dict[int, list[int]] = {}
    for i, numbers in enumerate(possible):
        for n in numbers:
            by_rule.setdefault(n, []).append(i)
    ascii_ = [t.isascii() for t in texts]
    out: list[list[int]] = [[] for _ in texts]
    for n, mine in by_rule.items():
        patterns = _patterns(rules[n])
        for plain in (True, False):
            some = [i for i in mine if ascii_[i] == plain]
            if not some:
                continue
            if patterns is None:
                for i in some:
                    out[i].append(n)
                continue
            pattern, exact = (patterns[0], True) if plain else patterns[1:]
            found = pc.match_substring_regex(pa.array([texts[i] for i in some], pa.large_string()), pattern=pattern)
            for i, hit in zip(some, found.to_pylist(), strict=True):
                if hit:
                    out[i].append(-1 - n if exact else n)
    return out
