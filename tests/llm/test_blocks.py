"""Mixing, top-k search, WARC: invariants, brute force, round trips, odd input."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing, topk, warc
from sluice.llm.common import cut, smallest_hashes

DOC = "doc_id int, text string, source string, size int, sid string"


def brute_targets(sizes, budget=1.5, repeat=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeat * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = repeat * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix(spark, block):
    rng = random.Random(block)
    rows = [(i, "w " * rng.randint(0, 120), rng.choice(["a", "b", "c", "é", "Z", "hot", "hot", "hot", None])) for i in range(300)]
    rows += [(None, "x y", "a"), (300, None, "a"), (301, "", "empty"), (302, " \n", "empty"), (303, "long " * 9000, "d"), (304, "one", "tiny"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], DOC)
    out = mixing.mix(df, block=block, shard_slots=50)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_shard", "last_shard"]
    got = out.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    assert all(r.taken <= 2 * r.size for r in got)
    taken, by_id = {}, {}
    for i, t, s in rows:
        by_id.setdefault(i, s)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = sorted(map(str, mixing.mix(df.repartition(3), block=block, shard_slots=50).collect()))
    assert again == sorted(map(str, got))


def test_permutations_and_their_inverse(spark):
    for n in (1, 2, 3, 10, 257):
        x = spark.range(n).select(F.col("id"), F.lit(n).cast("long").alias("n"), F.lit(3).cast("long").alias("k"))
        y = x.select("id", mixing._permuted(F.col("id"), F.col("n"), 9, F.col("k")).alias("y"), mixing._inverse_last(F.col("n"), 9, F.col("k")).alias("z")).collect()
        assert sorted(r.y for r in y) == list(range(n))
        assert next(r.id for r in y if r.y == n - 1) == y[0].z
    assert [r.y for r in y] != list(range(n))


def _drawn(spark, q, shard_slots, seed):
    sources = spark.createDataFrame(list(enumerate(q)), "sid long, q long")
    drawn, shards = mixing.draw(sources, shard_slots, seed)
    counts = np.zeros((shards, len(q)), int)
    for r in drawn.groupBy("shard", "sid").count().collect():
        counts[r.shard, r.sid] = r["count"]
    return counts


def test_drawn_counts_fit_the_multinomial(spark):
    q = [1000, 10, 5000, 1, 400, 3589]
    total, shard_slots = sum(q), 100
    counts = np.concatenate([_drawn(spark, q, shard_slots, seed) for seed in range(4)])
    assert len(counts) == 4 * 100 and (counts.sum(1) == shard_slots).all()
    p = np.array(q) / total
    mean, var = shard_slots * p, shard_slots * p * (1 - p)
    assert (np.abs(counts.mean(0) - mean) < 4.5 * np.sqrt(var / len(counts))).all()
    assert (np.abs(counts.var(0)[p > 0.03] / var[p > 0.03] - 1) < 0.35).all()
    covariance = np.cov(counts[:, 0], counts[:, 2])[0, 1]
    assert covariance == pytest.approx(-shard_slots * p[0] * p[2], abs=2.5)
    assert not np.array_equal(counts[:100], counts[100:200])


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_slots_match_the_drawn_counts(spark, monkeypatch, broadcast):
    """A source's slots in a shard are those it drew there, but for those left out or thrown after the draw."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    df = spark.createDataFrame([(i, "w " * (50 if i % 4 else 300), "abc"[i % 3], 0, "") for i in range(400)], DOC)
    documents, _ = mixing.plan(df, block=4)
    wanted = mixing.due(documents, block=4).collect()
    due, blocks = {r.sid: r.q for r in wanted}, {r.sid: r.n for r in wanted}
    sources = spark.createDataFrame(sorted(due.items()), "sid long, q long")
    drawn, shards = mixing.draw(sources, 200)
    drew = {(r.sid, r.shard): r["count"] for r in drawn.groupBy("sid", "shard").count().collect()}
    rows = mixing.slots(documents, block=4, shard_slots=200).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == sum(due.values())
    for sid, q in due.items():
        mine = [r for r in rows if r.sid == sid]
        number = {}
        for shard in range(shards):
            kept = sum(r.shard == shard and r.slot < 200 for r in mine)
            left = q - sum(number.values())
            assert kept == min(drew.get((sid, shard), 0), left)
            number[shard] = kept
        # whole rounds through all blocks, then distinct blocks
        seen = {}
        for r in mine:
            seen[r.block_index] = seen.get(r.block_index, 0) + 1
        assert sorted(seen.values(), reverse=True) == [q // blocks[sid] + (i < q % blocks[sid]) for i in range(min(q, blocks[sid]))]


@pytest.mark.parametrize("block", [3, 32])
def test_taken_words_are_those_of_the_slots(spark, block):
    """What `mix` takes of a document, by hand from the places of documents and the slots' blocks."""
    rng = random.Random(block)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice(["a", "b", "c", "d", "hot", "hot", "hot"]), 0, "") for i in range(200)]
    df = spark.createDataFrame(rows, DOC)
    documents, _ = mixing.plan(df, block=block)
    places = documents.collect()
    slots = mixing.slots(documents, block=block, shard_slots=64).collect()
    want = {}
    for d in places:
        inside = [max(0, min(d.start + d.size, s.block_index * block + s.words) - max(d.start, s.block_index * block)) for s in slots if s.sid == d.sid]
        want[d.id] = (sum(inside), sum(n > 0 for n in inside))
    got = {r.doc_id: (r.taken, r.n_pieces) for r in mixing.mix(df, block=block, shard_slots=64).collect()}
    assert got == want
    # the streams: a source's documents fill its places without gaps
    for sid in {d.sid for d in places}:
        at = 0
        for start, size in sorted((d.start, d.size) for d in places if d.sid == sid and d.size):
            assert start == at
            at += size


def test_mixed_texts_hold_the_taken_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 23)), "abc"[i % 3], 0, "") for i in range(120)] + [(7, "d7 again", None, 0, ""), (200, None, "a", 0, "")]
    df = spark.createDataFrame(rows, DOC)
    taken = {}
    for r in mixing.mix(df, block=8, shard_slots=16).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    found = {}
    texts = mixing.mixed_texts(df, block=8, shard_slots=16).collect()
    assert all(1 <= len(t.text.split()) <= 8 for t in texts)
    for t in texts:
        for w in t.text.split():
            d = 7 if w == "again" else int(re.match(r"d(\d+)", w)[1])
            found[d] = found.get(d, 0) + 1
    assert found == {d: n for d, n in taken.items() if n}
    # a slot's words follow each other in its source's stream: those of one document are consecutive
    for t in texts:
        for d in {re.match(r"d(\d+)", w)[1] for w in t.text.split() if w.startswith("d") and "w" in w}:
            places = [int(w.split("w")[1]) for w in t.text.split() if w.startswith(f"d{d}w")]
            assert places == list(range(places[0], places[0] + len(places)))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None, 1, "")], DOC)).collect()] == [0]


def brute_top(rows, k, every, scale=256):
    vectors = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, v in vectors:
        if q is None or q % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), c is None, c or 0, m) for m, c, w in vectors if m != n))[:k]
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c, _) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_numbers,query_bytes", [(64, 1 << 20), (1 << 18, 1 << 20), (64, 900)])
def test_top_k_matches_brute_force(spark, block_numbers, query_bytes):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=12).round(2).tolist()) for i in range(200)]
    rows += [(10, rows[10][1]), (300, None), (310, [1.0, None]), (320, [float("nan")] * 12), (330, [float("inf")] * 12), (340, []), (350, [0.5]), (None, rows[3][1]), (360, rows[20][1]), (-50, [1.0] * 14)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, every=10, block_numbers=block_numbers, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 5, 10)
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), every=10).count() == 0


def test_top_k_of_huge_numbers_is_exact(spark):
    rows = [(i, [1e9 + i, 3.0, -1e9 * i]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, every=4, block_numbers=12).collect()), key=str)
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q, v in rows[::4]:
        scored = sorted((-clip(sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))), c) for c, w in rows if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert got == sorted(want, key=str)


def test_bounds_prune_columns():
    """Candidates drop out between dimension groups, more of them if a floor is known, and none that counts."""
    rng = np.random.default_rng(2)
    matrix = np.floor(rng.normal(size=(32, 2000)) * np.linspace(30, 1, 32)[:, None])
    queries = matrix[:, :3].T.copy()
    full = queries @ matrix
    full[np.arange(3), np.arange(3)] = -np.inf
    want = [(i, j, int(full[i, j])) for i in range(3) for j in sorted(range(2000), key=lambda j: (-full[i, j], j))[:5]]
    floors = np.array([full[i, j] for i, j, _ in want[4::5]])
    seen = []
    for known in (None, floors):
        trace = []
        got = list(topk.best_in_block(queries, np.array([0, 1, 2]), matrix, np.arange(2000), np.ones(2000, np.uint8), 5, floors=known, trace=trace))
        assert got == want
        assert trace == sorted(trace, reverse=True) and trace[-1] < trace[0] and trace[-1] < 100
        seen.append(sum(trace))
    assert seen[1] < seen[0]


PAGE = "page_id long, url string, html string, value string"


def brute_warc(pages, least=0):
    groups = {}
    for n, (i, _, h) in enumerate(pages):
        groups.setdefault(h or "", []).append((i is not None, i or 0, n))
    out = []
    for n, (i, _, h) in enumerate(pages):
        data, top = (h or "").encode(), max(groups[h or ""])
        first = top[2] == n or len(data) < least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first or not top[0] else top[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,limit,repeated", [(0, 50_000, False), (0, 50_000, True), (5, -1, True)])
def test_warc_round_trip(spark, least, limit, repeated, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", limit)
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "\n", "\r\n\r\n", "x\r\n\r\n" + record, record, "é😀\x00 zero", "no end", "end\n", "a" * 1_500_000, "abc", "same payload", "same payload"]
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(50 + i, None, "same payload") for i in range(6)] + [(70, "http://x\r\nInjected: y", ""), (None, "http://null", "same payload")]
    pages += [(3, "http://h/3", "\r\n\r\n"), (71, "no scheme", "abc")] + [(i, f"http://h/end/{i}", h) for i, h in enumerate(("a\r", "a\r\n", "a\r\n\r", "\r\r\n\r\n\r"), 80)]
    if repeated:
        pages += [pages[0], pages[11], pages[11], pages[-1], (71, "other", "abc"), (0, "http://h/0", ""), (None, None, "only null"), (None, None, "only null")]
    df = spark.createDataFrame([(*p, "v") for p in pages], PAGE)
    got = sorted(map(tuple, warc.round_trip(df, min_payload=least).collect()), key=str)
    assert got == brute_warc(pages, least)
    assert warc.round_trip(df.where("false")).count() == 0


def test_payloads_and_headers_come_back(spark, tmp_path):
    pages = [(i, f"http://h/{i}?q=é", f"line {i}\r\n\r\nWARC/1.1\r\n" * i) for i in range(30)]
    warc.write_archives(spark.createDataFrame([(*p, "v") for p in pages], PAGE).repartition(3), str(tmp_path / "w"))
    captures = warc.assemble(cut(warc.read_records(spark, str(tmp_path / "w")))).collect()
    back = {int(dict(c.metadata[0].fields)["page-id"]): (c.response.target_uri, bytes(c.response.payload).decode()) for c in captures}
    assert back == {i: (u, h) for i, u, h in pages}
    assert all(len(c.requests) == 1 and c.requests[0].concurrent_to == [c.capture_id] for c in captures)
    assert all(c.response.header_digest == f"sha1:{c.response.payload_digest}" for c in captures)


def test_assembly_follows_identifiers_both_ways_and_through_others(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]), ("lost", "metadata", ["nowhere"]), ("r2", "revisit", []), ("q2", "request", ["r2", "r2"]), ("i", "warcinfo", [])]
    recs = spark.createDataFrame([(i, t, c) for i, t, c in rows], "record_id string, type string, concurrent_to array<string>")
    got = {c.capture_id: (c.response and c.response.record_id, [r.record_id for r in c.requests], [m.record_id for m in c.metadata]) for c in warc.assemble(recs).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1", "m2"]), "r2": ("r2", ["q2"], []), "lost": (None, [], ["lost"])}


def test_not_an_archive():
    with pytest.raises(ValueError):
        list(warc.Parser().feed(b"<html>"))


def test_pieces_of_any_size():
    one = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    blocks = [b"", b"\r\n", b"WARC/1.1\r\n\r\n", b"x" * 50, b"\r"]
    data = b"".join(one % (len(b), b) for b in blocks)
    for size in (1, 2, 3, 7, 1000):
        parser = warc.Parser()
        assert [b for at in range(0, len(data), size) for _, b in parser.feed(data[at : at + size])] == blocks


def test_samples_by_hash_agree_with_a_full_sort(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(5)
    want = [r.k for r in df.orderBy(F.xxhash64("k")).limit(100).collect()]
    assert [r.k for r in smallest_hashes(df, "k", 100).collect()] == want
    assert smallest_hashes(df, "k", 5000).count() == 3000
