"""Rule scans as Column functions: which rules match a text, in catalog order.

All take text that has been normalized where the caller wants disguises folded. A null text has no hits. `long`: texts of
more characters are looked at by a linear-time matcher first; hits are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.decode import decoded_base64, rot13
from sluice.functions.gates import candidates
from sluice.functions.linear import LONG
from sluice.functions.rules import Rule, atlas_rules, request_rules, response_rules

_IDS = "array<string>"


def matches(text: Column, possible: Column, rules: Sequence[Rule], long: int = LONG) -> Column:
    """Ids of the matching rules, in the order of `rules`; a regex runs only where `possible` (see `candidates`) says so."""
    if not rules:
        return F.array().cast(_IDS)
    short = F.length(text) <= long
    found = []
    for n, r in enumerate(rules):
        listed = F.array_contains(possible, F.lit(n))
        found.append(F.when((listed if r.gate else short | listed) & text.rlike(r.java), F.lit(n)))
    numbers = F.array_compact(F.array(*found))
    decided = F.transform(F.filter(possible, lambda x: x < 0), lambda x: -1 - x)
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    ordered = F.when(short, numbers).otherwise(F.array_sort(F.concat(numbers, decided)))
    return F.transform(ordered, lambda n: F.element_at(ids, n + 1))


def hits_each(texts: Column, rules: Sequence[Rule], long: int = LONG) -> Column:
    """array<array<string>>: the hits of each text of an array without nulls."""
    return F.zip_with(texts, candidates(texts, tuple(rules), long), lambda t, p: matches(t, p, rules, long))


def hits(text: Column, rules: Sequence[Rule], long: int = LONG) -> Column:
    """Ids of the rules that match, in the order of `rules`."""
    return hits_each(F.array(F.coalesce(text, F.lit(""))), rules, long)[0]


def scan(text: Column, decoded: Column | None = None, extra: Sequence[Rule] = ()) -> Column:
    """Request rules on the clear text, then on what is decoded from it: new ids in the order of appearance.

    `decoded`: base64 plaintexts (array), already normalized where that is wanted; by default those of the text, with
    the foldings that need no Python. The ROT13 of the whole text always comes last.
    """
    text = F.coalesce(text, F.lit(""))
    plain = decoded_base64(text) if decoded is None else F.coalesce(decoded, F.array().cast(_IDS))
    return scan_decoded(F.concat(F.array(text), plain, F.array(rot13(text))), extra)


def scan_decoded(texts: Column, extra: Sequence[Rule] = ()) -> Column:
    """scan() of the clear text and what was decoded from it, given as one array in that order."""
    return F.array_distinct(F.flatten(hits_each(texts, request_rules() + tuple(extra))))


def scan_response(text: Column, extra: Sequence[Rule] = ()) -> Column:
    """Response rules, then the reused secret formats; nothing is decoded."""
    return hits(text, response_rules() + tuple(extra))


def scan_atlas(text: Column, extra: Sequence[Rule] = ()) -> Column:
    return hits(text, atlas_rules() + tuple(extra))


def with_names(ids: Column, rules: Sequence[Rule]) -> Column:
    """array<struct<id, name>> of hit ids; unknown ids have null names."""
    names = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.name)])
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.try_element_at(names, i).alias("name")))


def scan_with_names(text: Column) -> Column:
    """(id, name) of the request rules on the clear text only."""
    return with_names(hits(text, request_rules()), request_rules())


def scan_atlas_with_names(text: Column) -> Column:
    return with_names(scan_atlas(text), atlas_rules())
