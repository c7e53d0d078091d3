"""Long texts: the linear-time matcher finds what Java finds, and hostile texts hold nothing up."""

import random
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sluice.functions import linear, scan
from sluice.functions.rules import all_rules, atlas_rules, request_rules, response_rules
from sluice.plans.seeds import matching_texts

NO_LIMIT = 1 << 30


def _edited(text, rng):
    c = list(text)
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(c))
        c[i] = rng.choice([" ", "x", "9", "é", "\n", c[i] * 2, "", "٣", "_", "\xa0"])
    return "".join(c)


def test_every_rule_is_taken_and_agrees():
    rng = random.Random(1)
    n = 0
    for r in all_rules():
        exact, loose, same = linear._patterns(r)
        texts = [x for t in matching_texts(r) for x in (t, t.upper(), t.replace(" ", "\xa0"), f"é{t}é", f"a{t}z", *(_edited(t, rng) for _ in range(5)))]
        want = [bool(r.python.search(t)) for t in texts]
        first = pc.match_substring_regex(pa.array(texts), pattern=exact).to_pylist()
        second = pc.match_substring_regex(pa.array(texts), pattern=loose).to_pylist()
        for t, w, a, b in zip(texts, want, first, second):
            assert a == w if t.isascii() else (b == w if same else b or not w), (r.rule_id, t)
        n += sum(want)
    assert n > 5000


def test_long_texts_have_the_same_hits(spark):
    rng = random.Random(2)
    rows = []
    for n, r in enumerate(all_rules()):
        for t in (matching_texts(r)[0], _edited(matching_texts(r)[-1], rng)):
            pad = "quiet words of no meaning\n" * 400
            rows += [(f"{pad}é {t}" if n % 2 else f"{pad} {t}",), (f"{t} {pad}",)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    for rules in (request_rules(), response_rules(), atlas_rules()):
        both = df.select(scan.hits(F.col("text"), rules).alias("a"), scan.hits(F.col("text"), rules, NO_LIMIT).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]
        assert sum(map(len, (r.a for r in both))) > len(rules)


HOSTILE = {
    "connection strings": "postgres://a" * 85_000,
    "more connection strings": "mongodb://a:" * 85_000,
    "capitals": "M" * 1_000_000,
    "token starts": "eyJ" * 330_000,
    "open tags": "<script" * 140_000,
    "addresses": "send x https://" * 66_000,
    "at signs": "send x " + "@" * 1_000_000,
    "spaces": "list" + " " * 1_000_000,
    "key blocks": "-----BEGIN " + "\n" * 1_000_000,
    "verbs": "repeat forget pretend " * 45_000,
    "digits": "card 4111 " * 100_000,
    "dots and slashes": "../" * 330_000,
    "template tokens": "[INST]" * 160_000,
    "a match at the end": "postgres://a" * 85_000 + " ignore all the rules",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(spark, name):
    """A million characters through all rules; the matcher's first use, which reads all patterns, is not counted."""
    df = spark.createDataFrame([("short",), (HOSTILE[name],)], "text string").coalesce(1)
    columns = [scan.hits(F.col("text"), rules).alias(n) for n, rules in (("a", request_rules()), ("b", response_rules()), ("c", atlas_rules()))]
    began = time.time()
    row = df.select(*columns).collect()[1]
    assert time.time() - began < 20
    assert ("JBK.003" in row.a) == (name == "a match at the end")


@pytest.mark.parametrize("rule", [r for r in all_rules() if "*" in r.pattern or "+" in r.pattern], ids=lambda r: r.rule_id)
def test_each_rule_on_its_own_beginnings(rule):
    """Half a megabyte of what starts a match, over and over, never ending one; the matcher alone."""
    text = matching_texts(rule)[0]
    for part in (text[: max(1, len(text) // 2)], text[:-1]):
        hostile = part * (500_000 // len(part))
        began = time.time()
        linear.decide([hostile], (rule,), [[0]])
        assert time.time() - began < 2
