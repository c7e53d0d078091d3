"""DuckDB SQL for rule scans: the rules in RE2's dialect."""

from __future__ import annotations

import re
from collections.abc import Sequence

from sluice.functions.rules import Rule

_WORD = r"\p{L}\p{M}\p{N}_"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The pattern with Unicode word characters; its `$` is RE2's end of the text already."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out.append((_WORD if inside else f"[{_WORD}]") if two == r"\w" else two)
            i += 2
            continue
        inside = (two[0] == "[") if not inside else two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def matched(text: str, rule: Rule) -> str:
    """SQL condition. RE2's word boundary is ASCII only: where it matters, other letters stand in as underscores."""
    if re.search(r"\\b", rule.pattern) and rule.pattern.isascii():
        text = f"regexp_replace({text}, '[^\\x00-\\x7F]', '_', 'g')"
    return f"regexp_matches({text}, {quote(re2(rule.pattern))})"


def hit_list(text: str, rules: Sequence[Rule]) -> str:
    """SQL list of the ids of the matching rules, in order."""
    cases = ",\n".join(f"CASE WHEN {matched(text, r)} THEN '{r.rule_id}' END" for r in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def string_list(texts: Sequence[str]) -> str:
    return "[" + ", ".join(map(quote, texts)) + "]"
