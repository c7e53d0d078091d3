"""SimHash, line dedup, chat collapse: against brute force, and on odd input."""

import ctypes
import itertools
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import chat, linededup, simhash
from sluice.llm.common import connected_components

DOC = "doc_id long, text string, source string, component_id string, fp int"


def brute_fingerprint(text, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, tau=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= tau:
            parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if low.get(r) is None else min(low[r], d) if d is not None else low[r]
    return [low[find(i)] for i in range(len(ids))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    out = [None, "", " \n\t ", "one", "One two THREE", "one two three four", "a b " * 3000]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(1, 260))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append("\n".join(near) if rng.random() < 0.5 else " ".join(near).upper())
    return out + out[:5]


def test_fingerprints_and_classes_match_brute_force(spark, texts, monkeypatch):
    ids = [None if i == 3 else i * 7 % 1000 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in zip(ids, texts)], DOC)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, fps)
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want) if i is not None)
    for limit in (simhash.BROADCAST_ROWS, -1):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert kept.count() == len({str(c) for c in want if c is not None}) + sum(c is None for c in want)


def test_pieces_of_long_texts_change_nothing():
    text = " ".join(str(i) for i in range(3000)).encode()
    assert simhash.fingerprint(text) == simhash.fingerprint(text, piece=100) == brute_fingerprint(text.decode())
    assert simhash.fingerprint(b"a" * 5000, piece=100) == brute_fingerprint("a" * 5000)


@pytest.mark.parametrize("tau", [1, 2, 4, 6])
def test_pigeonring_finds_every_pair(spark, tau):
    rng = random.Random(tau)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for b in rng.sample(range(64), rng.randint(1, tau + 2)):
            f ^= 1 << b
        fps.add(f)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a, b in itertools.permutations(fps, 2) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= tau}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {tuple(r) for r in simhash.pigeonring_pairs(nodes, tau).collect()} == want
    assert want


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_ids_keep_one_row_of_each_class(spark):
    rows = [(5, "alpha beta gamma delta epsilon", "s", None, 1), (5, "quite another text with other words", "s", None, 1), (5, "alpha beta gamma delta epsilon", "s", None, 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOC))
    assert sorted(r.text for r in kept.collect()) == ["alpha beta gamma delta epsilon", "quite another text with other words"]
    assert simhash.keep_one(spark.createDataFrame([], DOC)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def brute_similar(ids, texts, similarity=0.8, k=5):
    """Component id of each text by the whole sets of shingles, all pairs."""
    sets = []
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets.append({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set()))
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if low.get(r) is None else min(low[r], d) if d is not None else low[r]
    return [low[find(i)] for i in range(len(ids))]


@pytest.fixture(scope="module")
def edited():
    """Texts, edited copies of them at all similarities, families around one text, copies, odd texts."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "w " * 5000, "w x " * 2000]
    for n in (6, 30, 60, 120, 250, 600, 1500):
        for _ in range(8):
            base = rng.choices(vocabulary, k=n)
            out.append(" ".join(base))
            for rate in (0.0, 0.004, 0.01, 0.015, 0.02, 0.03):
                near = [rng.choice(vocabulary) if rng.random() < rate else w for w in base]
                near = [w for w in near if rng.random() > rate / 4]
                out.append(" ".join(near))
    base = rng.choices(vocabulary, k=400)
    out += [" ".join(rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base) for _ in range(60)] + [" ".join(base)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out += [" ".join(rng.choices(vocabulary, k=90)) + " " + passage for _ in range(60)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [out[i] for i in order]


@pytest.mark.parametrize("limit", [200_000, -1])
def test_similar_classes_against_all_pairs(spark, edited, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    ids = [None if i == 3 else i * 7 % 1000 for i in range(len(edited))]
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in zip(ids, edited)], DOC)
    got = {r.id: r.component_id for r in simhash.similar_classes(df).collect()}
    want = dict(zip(ids, brute_similar(ids, edited)))
    want_of = {}
    for i, c in want.items():
        want_of.setdefault(c, set()).add(i)
    for c in set(got.values()):
        assert len({want[i] for i in got if got[i] == c}) == 1  # never more than the whole sets say
    merged = sum(i != c for i, c in want.items())
    caught = sum(i != c for i, c in got.items())
    assert merged > 200 and caught >= 0.97 * merged
    kept = simhash.keep_one_similar(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in set(got.values()))


def _near_the_limit():
    """Pairs of texts at a similarity of 0.8 or just above, of many sizes, and a hub that shares half of a family with each
    of its pairs without being similar to any."""
    rng = random.Random(17)
    out = []

    def text(parts):
        return " ".join(w for p in parts for w in p)  # parts of 5 words: shingles across their borders differ as parts do

    def fresh(n):
        return [f"{rng.getrandbits(40):x}" for _ in range(n)]

    for n in (5, 6, 7, 9, 13, 20, 21, 41, 60, 63, 94, 141, 150, 211, 300, 450, 800):
        for _ in range(12):
            words = fresh(n + 4)
            less = n // 5  # shingles that go with the words cut off at the end; of n, at least 0.8 n are left
            out += [text([words]), text([words[: n + 4 - less]])]
            cut_off = n // 9  # both texts have words of their own: n - cut_off of n + cut_off shingles are in both
            if cut_off and (n - cut_off) >= 0.8 * (n + cut_off):
                out += [text([words[:-cut_off], fresh(cut_off), ["x"]]), text([words[:-cut_off], fresh(cut_off), ["x"]])]
    hub = fresh(400)
    for i in range(20):
        own = fresh(150)
        out += [text([hub[i * 10 : i * 10 + 200], own, fresh(20)]), text([hub[i * 10 : i * 10 + 200], own, fresh(20)])]
    return [*out, text([hub])]


@pytest.mark.parametrize("limit", [200_000, -1])
def test_similar_classes_lose_no_link(spark, edited, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    for texts in (_near_the_limit(), edited):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.id: r.component_id for r in simhash.similar_classes(df).collect()}
        assert got == dict(enumerate(brute_similar(range(len(texts)), texts)))


def test_similar_sets_share_a_key_and_few_bits_of_boxes_differ():
    rng = np.random.default_rng(4)
    for n in [*range(1, 60)] * 4 + [94, 141, 211, 212, 500, 3000] * 8:
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for similarity in (0.6, 0.8, 0.95):
            both = n - int(rng.integers(0, int(n * (1 - similarity) + 1e-9) + 1))
            more = int(both / similarity + 1e-9) - n
            if more < 0 or both == n + more:
                continue
            y = np.concatenate([x[:both], rng.integers(0, 1 << 64, more, dtype=np.uint64)])
            assert np.intersect1d(simhash.whole_keys(x, similarity), simhash.whole_keys(y, similarity)).size
            a, b = (dict(simhash.boxes(h, similarity)) for h in (x, y))
            assert a.keys() & b.keys()
            for at in a.keys() & b.keys():
                differ = sum((i ^ j).bit_count() for i, j in zip(a[at], b[at]))
                assert len(a[at]) == len(b[at]) and differ <= min(n + more + n - 2 * both, simhash.apart(n, n + more, similarity))


#: Deals many texts as a worker does and prints by how many MB its memory has grown at most, and after it.
DEALS = r"""
import re
import pyarrow as pa
from sluice.llm import simhash

class Texts:
    mapInArrow = staticmethod(lambda work, schema: work)

def mb(what):
    return int(re.search(what + r":\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

def batches(n):
    for i in range(0, n, 1000):
        yield pa.record_batch([pa.array([" ".join(map(str, range(j * 500, j * 500 + 500))) for j in range(i, i + 1000)])], ["text"])

work = simhash._deal(Texts, 5, 0.8, 48)
assert sum(x.num_rows for x in work(batches(1000)))  # what is loaded by the first call stays
before = mb("RssAnon"), mb("VmHWM")
keys = 0
for out in work(batches(6000)):
    keys += sum(len(x.as_buffer()) for x in out.column(1)) // 8
del out
print(keys, mb("VmHWM") - before[1], mb("RssAnon") - before[0])
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim") or not os.path.exists("/proc/self/status"), reason="memory goes back by glibc and is read from /proc")
def test_a_worker_gives_its_memory_back():
    run = subprocess.run([sys.executable, "-c", DEALS], cwd=Path(simhash.__file__).parents[2], capture_output=True, text=True, check=True)
    keys, most, after = map(float, run.stdout.split()[-3:])
    assert keys > 900_000
    assert most < 40 and after < 16


def test_pairs_across_roots_are_all_made(monkeypatch):
    rng = random.Random(6)
    keys = [(level << simhash.LEVEL_AT | k, level) for level in (2, 3, 65) for k in range(4)]
    rows = [(*rng.choice(keys), rng.randrange(4), i, rng.choice((8, 9, 10, 14))) for i in range(300)]
    rows = sorted((k - (k >> 63 << 64), root, i, n, bytes(rng.choices((0, 1, 3), k=level))) for k, level, root, i, n in rows)

    def near(a, b):
        return 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3]) and 9 * sum((x ^ y).bit_count() for x, y in zip(a[4], b[4])) <= a[3] + b[3]

    want = {(min(a[2], b[2]), max(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] != b[1] and near(a, b)}
    assert 50 < len(want)
    for size, met in ((300, 1 << 20), (7, 5), (1, 1)):
        monkeypatch.setattr(simhash, "MET", met)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "root", "owner", "n", "boxes"), r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [(r["a"], r["b"]) for b in simhash._across(0.8)(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)


def test_pairs_of_many_keys_are_told_at_few():
    rng = np.random.default_rng(8)
    sets, rows = [], []
    for n in [6, 9, 12, 30, 60, 94, 141, 211, 300, 500] * 6:
        whole = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for differ in (0, n // 20, n // 9, n // 9, n // 8, n // 7, n // 5):
            sets.append(np.concatenate([whole[differ:], rng.integers(0, 1 << 64, differ, dtype=np.uint64)]))
    for i, h in enumerate(sets):
        box = dict(simhash.boxes(h, 0.8))
        rows += [(int(k.view(np.int64)), i, i, len(h), box[int(k) >> simhash.LEVEL_AT]) for k in np.unique(simhash.whole_keys(h, 0.8))]
    rows.sort()
    keys = [set(simhash.whole_keys(h, 0.8).tolist()) for h in sets]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "root", "owner", "n", "boxes"), r)) for r in rows])
    got = [(r["a"], r["b"]) for b in simhash._across(0.8)(iter([batch])) for r in b.to_pylist()]
    similar = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b])) if a // 7 == b // 7 else 0
        if 0 < both < len(sets[a]) and both >= 0.8 * (2 * len(sets[a]) - both):
            similar.add((a, b))
    assert len(similar) > 300 and similar <= set(got)
    assert len(got) < sum(len(keys[a] & keys[b]) for a, b in set(got)) / 3


def test_similar_classes_of_odd_tables(spark):
    rows = [(5, "alpha beta gamma delta epsilon", "s", None, 1), (5, "quite another text with other words", "s", None, 1), (5, "alpha beta gamma delta epsilon", "s", None, 1), (None, None, None, None, None), (6, " ", None, None, None)]
    kept = simhash.keep_one_similar(spark.createDataFrame([(*r, 1, 2) for r in rows], DOC + ", own_id int, node int"))
    assert sorted(str(r.text) for r in kept.collect()) == [" ", "alpha beta gamma delta epsilon", "quite another text with other words"]
    assert simhash.keep_one_similar(spark.createDataFrame([], DOC)).count() == 0


def test_rings_fit_brute_force():
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(500)) for _ in range(700)).encode()
    h = simhash.shingle_set(text)
    words = text.decode().split()
    assert {int(x) for x in h} == {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)}
    assert all(2 <= n / (1 << simhash.level(n)) < 4 for n in range(2, 5000)) and simhash.level(1) == simhash.level(0) == 0
    for at in (0, 1, 3, 8):
        m, groups = min(16, 1 << at), {}
        for x in map(int, h):
            groups.setdefault((x * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - at) if at else 0, []).append(x)
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in groups.get(g, [])) > len(groups.get(g, []))) for g in range(m)]
        assert [int(x) for x in simhash.ring(h, at)] == want


def test_chains_are_the_pigeonring_condition():
    rng = random.Random(3)
    seen = set()
    for m in (1, 2, 4, 8, 16):
        rows = [[int(rng.random() < rng.choice([0.3, 0.7, 0.8])) for _ in range(m)] for _ in range(300)]
        got = simhash.chained(np.ones((300, m), np.int64), 1 + np.array(rows), 0.75)
        for d, found in zip(rows, got):
            assert found == any(all(sum((d + d)[s : s + n]) <= n * 3 // 4 for n in range(1, m + 1)) for s in range(m))
            assert found or sum(d) > 0.75 * m
            seen.add(bool(found))
    assert seen == {True, False}


def brute_lines(rows, max_ratio, min_pages):
    pages, having = {}, {}
    for host, text in set(rows):
        pages[host] = pages.get(host, 0) + 1
        for k in {x.strip(" \t\n\x0b\f\r") for x in (text or "").split("\n")} - {""}:
            having[host, k] = having.get((host, k), 0) + 1
    bad = {hk for hk, n in having.items() if n >= min_pages and n / pages[hk[0]] > max_ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\n\x0b\f\r")) not in bad) for h, t in rows]


@pytest.mark.parametrize("broadcast_lines", [100_000, 0])
def test_line_dedup_matches_brute_force(spark, broadcast_lines):
    rng = random.Random(2)
    common = [f"menu {i}" for i in range(6)] + ["", "  ", "  menu 1 "]
    rows = []
    for i in range(200):
        host = rng.choice(["a", "a", "b", "c", None])
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)}" for _ in range(rng.randint(1, 9))]
        rows.append((host, rng.choice([None, "", "menu 1"]) if i % 20 == 0 else "\n".join(lines)))
    rows += rows[:9] + [("a", "x\n" * 20_000)]
    df = spark.createDataFrame([(i, t, h, 9) for i, (h, t) in enumerate(rows)], "doc_id int, text string, source string, host int")
    df = df.withColumns({c: F.lit(1) for c in ("stay", "lists", "bad_host", "own_host", "p1", "right_p1", "h1")})
    plain = linededup.drop_boilerplate(df, max_ratio=0.15, min_pages=3, broadcast_lines=broadcast_lines)
    assert plain.columns == df.columns
    out = linededup.drop_boilerplate(df, max_ratio=0.15, min_pages=3, broadcast_lines=broadcast_lines, counts=("n_lines", "n_dropped"))
    got = {r.doc_id: (r.text, r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert {r.doc_id: r.text for r in plain.collect()} == {d: t for d, (t, _, _) in got.items()}
    want = brute_lines(rows, 0.15, 3)
    assert [got[i][0] for i in range(len(rows))] == want
    assert got[len(rows) - 1][1] == 20_001
    assert sum(x[2] for x in got.values()) > 50
    assert all(got[i][1:] == (0, 0) for i, (_, t) in enumerate(rows) if t is None)


@pytest.mark.parametrize("broadcast_lines", [200_000, 0])
def test_copies_of_a_page_keep_their_lines(spark, broadcast_lines):
    """A text copied to most of a host's pages is one page of it; a line on as many different pages is boilerplate."""
    rows = [("hot", "only here\nand here\nmenu")] * 60 + [("hot", f"own {i}\nmenu") for i in range(20)] + [("hot", None)] * 9
    rows += [("b", "only here\nmenu")] * 5 + [(None, None)] * 5
    df = spark.createDataFrame([(i, t, h, "x", 1) for i, (h, t) in enumerate(rows)], DOC).repartition(7)
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(df, max_ratio=0.1, min_pages=4, broadcast_lines=broadcast_lines).collect()}
    assert [got[i] for i in range(len(rows))] == brute_lines(rows, 0.1, 4)
    assert got[0] == got[59] == "only here\nand here" and got[60] == "own 0" and got[80] is None
    assert got[89] == "only here\nmenu"


def test_line_dedup_of_nothing(spark):
    assert linededup.digest(spark.createDataFrame([], "doc_id int, text string, source string")).count() == 0


@pytest.mark.parametrize("broadcast_lines", [200_000, 0])
def test_a_hot_host_with_many_lines(spark, broadcast_lines):
    """A host of a third of the pages, with hundreds of boilerplate lines: all of them are found in their lists."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        host = "hot" if i % 3 == 0 else f"h{i % 40}"
        rows.append((host, "\n".join([f"own {i}", *(f"line {j}" for j in range(300) if rng.random() < 0.4)])))
    df = spark.createDataFrame([(i, t, h, "x", 1) for i, (h, t) in enumerate(rows)], DOC)
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(df, max_ratio=0.3, min_pages=4, broadcast_lines=broadcast_lines).collect()}
    assert [got[i] for i in range(300)] == brute_lines(rows, 0.3, 4)


def brute_chats(rows):
    turns = {}
    for c, turn, role, text in set(rows):
        turns.setdefault(c, []).append((turn is None, turn or 0, role is None, role or "", text is None, text or "", role, text))
    chats = {c: tuple((x[-2], x[-1]) for x in sorted(v, key=lambda x: x[:6])) for c, v in turns.items()}
    kept = {}
    for c, t in sorted(chats.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        if t not in kept.values() and not any(len(o) > len(t) and o[: len(t)] == t for o in chats.values()):
            kept[c] = t
    return {c: "".join(f"<|{r or 'unknown'}|>\n{x or ''}<|end|>\n" for r, x in t) for c, t in kept.items()}


@pytest.mark.parametrize("limit,more", [(200_000, False), (200_000, True), (0, True)])
def test_chats_match_brute_force(spark, limit, more):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        length, start, kind = rng.randint(1, 9), rng.choice([0, 0, 1, 60]), rng.randrange(4)
        rows += [(c, start + t, "user" if t % 2 == 0 else "assistant", f"{kind} {t}") for t in range(length)]
    rows += [(100, None, None, None), (100, 1, "user", ""), (101, 1, "user", None), (None, 1, "user", "x"), (None, 1, "system", "x"), (102, 1, "user", "z" * 300_000)]
    if more:  # equal rows, long ones, one whose turns share a number, ties of texts
        rows += rows[:15] + [(200, t, "user", f"long {t}") for t in range(700)] + [(201, t, "user", f"long {t}") for t in range(650)]
        rows += [(300, None, None, f"same place {t}") for t in range(600)] + [(301, 5, "user", f"tie {t % 7}") for t in range(40)] + [(301, 5, "user", None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id int, turn int, role string, text string, n string, pos int")
    got = {}
    for r in sorted(chat.format_chats(df, broadcast_chats=limit).collect(), key=lambda r: r.segment):
        got[r.conv_id] = got.get(r.conv_id, "") + r.rendered
    assert got == brute_chats(rows)
    assert chat.format_chats(df.where("false")).count() == 0
    assert not more or chat.format_chats(df.where("conv_id = 200")).select(F.max("segment")).first()[0] == 2
