"""Texts that match rules, made from the rules themselves, so that no key-shaped string stands in the source."""

from __future__ import annotations

from functools import lru_cache

from sluice.functions.rules import Rule, _c, _p

_CATEGORY = {_c.CATEGORY_SPACE: " ", _c.CATEGORY_DIGIT: "7", _c.CATEGORY_WORD: "a", _c.CATEGORY_NOT_SPACE: "x", _c.CATEGORY_NOT_WORD: " ", _c.CATEGORY_NOT_DIGIT: "x"}


def _one_of(items) -> str:
    if items[0][0] is _c.NEGATE:
        banned = [x for op, a in items[1:] for x in (range(a, a + 1) if op is _c.LITERAL else range(a[0], a[1] + 1) if op is _c.RANGE else ())]
        return next(c for c in "xX- " if ord(c) not in banned)
    for op, a in items:
        if op is _c.RANGE:
            return chr(a[0] + min(3, a[1] - a[0]))
    op, a = items[0]
    return chr(a) if op is _c.LITERAL else _CATEGORY[a]


def _text(tree, arm: int, gap: str) -> str:
    """A text that the tree matches, taking the arm-th arm of every choice and `gap` where anything may stand."""
    out = []
    for op, a in tree:
        if op is _c.LITERAL:
            out.append(chr(a))
        elif op is _c.NOT_LITERAL:
            out.append("x" if a != ord("x") else "y")
        elif op is _c.ANY:
            out.append("x")
        elif op is _c.IN:
            out.append(_one_of(a))
        elif op is _c.SUBPATTERN:
            out.append(_text(a[3], arm, gap))
        elif op is _c.BRANCH:
            out.append(_text(a[1][arm % len(a[1])], arm, gap))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            anything = a[0] == 0 and len(a[2]) == 1 and (a[2][0][0] is _c.ANY or a[2][0][0] is _c.IN and a[2][0][1][0][0] is _c.NEGATE)
            out.append(gap if anything else _text(a[2], arm, gap) * a[0])
    return "".join(out)


@lru_cache(maxsize=None)
def matching_texts(rule: Rule, arms: int = 12) -> tuple[str, ...]:
    """Distinct texts that the rule matches, by different arms of its choices; candidates that fail it are left out."""
    tree = _p.parse(rule.pattern)
    made = dict.fromkeys(_text(tree, i, gap) for gap in ("", " ") for i in range(arms))
    return tuple(t for t in made if rule.python.search(f"note {t}"))


def seed_texts(rules: tuple[Rule, ...]) -> list[str]:
    """One text per rule, "note " before it so that none starts a text."""
    return [f"note {matching_texts(r)[0]}" for r in rules]
