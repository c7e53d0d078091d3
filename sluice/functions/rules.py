"""Rule catalogs, their regex dialects, and the literals that gate them.

Patterns are written for a linear-time engine with Unicode classes. For Java they get (?dU), which makes classes, word
boundaries and case folding Unicode and lets `.` exclude the line feed only; `$`, which here is the end of the text,
becomes an anchor that ignores a last line feed. A rule's gate is sets of lower-case literals; every match
contains one of each set, as the pattern's syntax tree shows, and a text that lacks a set needs no regex.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from sluice.functions.rules_atlas import ATLAS_RULES
from sluice.functions.rules_request import REQUEST_RULES
from sluice.functions.rules_response import RESPONSE_RULES

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _p

#: Families of secrets and personal data whose format is the same on the way out, so responses are scanned for them too.
SECRET_FAMILIES = ("DLP.C", "DLP.A", "DLP.S", "DLP.M", "DLP.D", "DLP.F", "DLP.G", "DLP.K", "DLP.I", "DLP.P")
#: Bytes of the shortest literal of a gate; texts that a part of a pattern may be unfolded to; sets of a gate, and their size.
_MIN_LITERAL, _MAX_LITERALS, _MAX_SETS, _MAX_IN_SET = 2, 24, 3, 64


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    pattern: str
    tactic: str | None = None

    @property
    def family(self) -> str:
        """DLP, JBK, AGT, INJ, RES or AML."""
        return self.rule_id.split(".", 1)[0]

    @cached_property
    def java(self) -> str:
        return "(?dU)" + _end(self.pattern, r"\z")

    @cached_property
    def python(self) -> re.Pattern:
        return re.compile(_end(self.pattern, r"\Z"))

    @cached_property
    def gate(self) -> tuple[tuple[str, ...], ...]:
        """Sets of lower-case literals; every match has one of each set. Empty if there are none worth testing."""
        sets = [s for s in _needed(_p.parse(self.pattern)) if min(len(x.encode()) for x in s) >= _MIN_LITERAL and len(s) <= _MAX_IN_SET]
        return tuple(tuple(sorted(x for x in s if not any(y != x and y in x for y in s))) for s in sorted(set(sets), key=_worth, reverse=True)[:_MAX_SETS])

    def may_match(self, lowered: str) -> bool:
        return all(any(x in lowered for x in s) for s in self.gate)


def _end(pattern: str, anchor: str) -> str:
    """`pattern` with each `$` outside classes and escapes replaced."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = (c == "[") if not inside else c != "]"
        out.append(anchor if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def _worth(s: frozenset[str]) -> tuple:
    return min(min(map(len, s)), 6), -len(s), min(map(len, s))


def _needed(tree, before: tuple[str, ...] = ("",)) -> list[frozenset[str]]:
    """Sets of literals; any match of the tree, right after one of the texts `before`, has at least one of each set."""
    out: list[frozenset[str]] = []
    run = list(before)  # the literal texts that end at this point of the sequence

    def close() -> None:
        nonlocal run
        if all(run):
            out.append(frozenset(run))
        run = [""]

    for op, arg in tree:
        exact = _exact(op, arg)
        if exact is not None and len(run) * len(exact) <= _MAX_LITERALS:
            run = [a + b for a in run for b in exact]
            continue
        if exact is None and op is _c.SUBPATTERN:
            out += _needed(arg[3], tuple(run))
            run = [""]
            continue
        if exact is None and op is _c.BRANCH:  # the parser takes a common beginning out of the arms
            arms = [_needed(x, tuple(run)) for x in arg[1]]
            if all(arms):
                out.append(frozenset().union(*(max(a, key=_worth) for a in arms)))
            run = [""]
            continue
        close()
        if exact is not None:
            run = list(exact)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            out += _needed(arg[2])
    close()
    return out


def _exact(op, arg) -> list[str] | None:
    """All texts that the node matches, lower-cased, if they are few; "" among them if it can be empty."""
    if op is _c.LITERAL:
        return [chr(arg).lower()]
    if op is _c.AT:
        return [""] if arg in (_c.AT_BOUNDARY,) else None
    if op is _c.IN:
        if all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 4:
            return list(dict.fromkeys(chr(a).lower() for _, a in arg))
        return None
    if op is _c.SUBPATTERN:
        return _exact_all(arg[3])
    if op is _c.BRANCH:
        arms = [_exact_all(x) for x in arg[1]]
        if all(a is not None for a in arms):
            out = list(dict.fromkeys(t for a in arms for t in a))
            return out if len(out) <= _MAX_LITERALS else None
        return None
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        inner = _exact_all(arg[2]) if arg[1] != _c.MAXREPEAT and arg[1] <= 2 else None
        if inner is None:
            return None
        out = [""] if arg[0] == 0 else []
        power = [""]
        for k in range(1, arg[1] + 1):
            power = [a + b for a in power for b in inner]
            if k >= arg[0]:
                out += power
        return list(dict.fromkeys(out)) if len(out) <= _MAX_LITERALS else None
    return None


def _exact_all(tree) -> list[str] | None:
    out = [""]
    for op, arg in tree:
        texts = _exact(op, arg)
        if texts is None or len(out) * len(texts) > _MAX_LITERALS:
            return None
        out = [a + b for a in out for b in texts]
    return list(dict.fromkeys(out))


@lru_cache(maxsize=None)
def request_rules() -> tuple[Rule, ...]:
    return tuple(Rule(*r) for r in REQUEST_RULES)


@lru_cache(maxsize=None)
def response_rules() -> tuple[Rule, ...]:
    """The response rules, then the secret formats of the request rules: the order of response hits."""
    return tuple(Rule(*r) for r in RESPONSE_RULES) + secret_rules()


@lru_cache(maxsize=None)
def secret_rules() -> tuple[Rule, ...]:
    return tuple(r for r in request_rules() if r.rule_id.startswith(SECRET_FAMILIES))


@lru_cache(maxsize=None)
def atlas_rules() -> tuple[Rule, ...]:
    return tuple(Rule(i, n, p, t) for i, n, t, p in ATLAS_RULES)


def all_rules() -> tuple[Rule, ...]:
    """Every rule once: request, response, adversarial technique."""
    return request_rules() + tuple(Rule(*r) for r in RESPONSE_RULES) + atlas_rules()


def rule_counts() -> dict[str, int]:
    return {"request": len(request_rules()), "response": len(RESPONSE_RULES), "response_secrets": len(secret_rules()), "atlas": len(atlas_rules())}


def rules_table(spark: SparkSession, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """ord, rule_id, name, family, tactic, direction, pattern: as many rows as there are rules, so fit to broadcast."""
    rows = []
    both = {r.rule_id for r in secret_rules()}
    for r in all_rules() + extra:
        direction = "technique" if r.family == "AML" else "response" if r.family == "RES" else "both" if r.rule_id in both else "request"
        rows.append((len(rows), r.rule_id, r.name, r.family, r.tactic, direction, r.pattern))
    return spark.createDataFrame(rows, "ord int, rule_id string, name string, family string, tactic string, direction string, pattern string")
