"""The response scan for Python operators (live streams): the same rules, folding and gates as the Column functions."""

from __future__ import annotations

import re
import unicodedata

import regex

from sluice.functions.gates import finder
from sluice.functions.normalize import INVISIBLE, LOOKALIKE_FROM, LOOKALIKE_TO, SMALL_FROM, SMALL_TO, TAG_FROM, TAG_TO
from sluice.functions.rules import Rule, response_rules

_INVISIBLE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", INVISIBLE) + "]")
_MARKS = regex.compile(r"([0-9A-Za-z])\p{M}+")
_RUN = regex.compile(r"\p{Alphabetic}+")
_LOOKALIKE = re.compile(f"[{LOOKALIKE_FROM}]")
_FOLD = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
_ALWAYS = str.maketrans(SMALL_FROM + TAG_FROM, SMALL_TO + TAG_TO)


def _fold_run(m: regex.Match) -> str:
    run = m[0]
    return run.translate(_FOLD) if _LOOKALIKE.search(run) and any(c.isascii() for c in run) else run


def normalize(text: str) -> str:
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _RUN.sub(_fold_run, _MARKS.sub(r"\1", text)).translate(_ALWAYS)


def scan_response(text: str, rules: tuple[Rule, ...] | None = None) -> list[str]:
    """Ids of the matching response rules, in order."""
    rules = rules or response_rules()
    possible = set(finder(rules)(text))
    return [r.rule_id for n, r in enumerate(rules) if (n in possible or not r.gate) and r.python.search(text)]
