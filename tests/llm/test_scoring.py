"""Quality, toxicity, decontamination, token counts: against brute force, held-out labels, and on odd input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontam, quality, tokens, toxicity

DOC = "doc_id long, text string, source string, n_words int, score string"


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("null" if name is None else str(name))
    out = []
    for d, text in docs:
        w, hit, names = split(text), set(), set()
        for win, who in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names |= who
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("piece_bytes", [1 << 20, 300])
def test_decontamination_matches_brute_force(spark, piece_bytes):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "é", "Ünï", "x_y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(None, "the the the"), (3, "w1 w2 w3 w4"), (40, None), (41, "!!")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            at = rng.randint(0, len(words))
            words[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([", ", " ", "\n-- "]).join(words)))
    docs += [(None, "the the the the"), (60, None), (61, ""), (5, docs[5][1]), (62, "w1 " * 20_000)]
    df = spark.createDataFrame([(d, t, "s", 1, "x") for d, t in docs], DOC)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, __text string")
    got = decontam.contamination(df, bench, piece_bytes=piece_bytes)
    want = brute_contamination(docs, items)
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    clean = decontam.decontaminate(df, bench, piece_bytes=piece_bytes)
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_decontamination_of_and_with_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, "x")], DOC)
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.contamination(df, none).collect()[0].contaminated is False
    assert decontam.contamination(df.where("false"), none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return tokens._tokenizer(tokens.default_path())


def test_chunked_counts_equal_whole_counts(tokenizer):
    rng = random.Random(0)
    parts = ["a", "é", " ", "  ", "\n", "\t\t ", "<|endoftext|>", "'s", "12", "!!", " b", "　", "日本", "x" * 50, "\x1c", "\x85", "‍", "😀"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        whole = len(tokenizer.encode(text, add_special_tokens=False))
        assert tokens.count_long(tokenizer, text, rng.choice([5, 16, 40, 100]), rng.choice([1, 4, 16])) == whole
        assert tokens.count_batch(tokenizer, [text, None, text]) == [whole, 0, whole]
    for text in ("ab" * 30_000, " " * 5000, "word " * 20_000):
        assert tokens.count_long(tokenizer, text, 4096, 64) == len(tokenizer.encode(text, add_special_tokens=False))


def test_white_space_that_is_not_ascii_is_no_boundary(tokenizer):
    rng = random.Random(4)
    texts = ["Price: \xa0 \xa0 20", "word \xa0 \xa0\n" * 1000]
    texts += ["".join(rng.choices([" ", "\n", "\xa0", "\u3000", "\x85", "a", "20", "."], k=rng.randint(1, 30))) for _ in range(2000)]
    assert tokens.count_batch(tokenizer, texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts(spark, tokenizer):
    texts = [None, "", "Hello, world", "héllo <|endoftext|>", "word " * 600, "long text, " * 20_000, "word " * 600]
    df = spark.createDataFrame([(i if i else None, t, "s", 1, "x") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_counts(df).collect()}
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert got[i if i else None] == (len((t or "").encode()), n, n > 512)
    assert tokens.token_counts(df.where("false")).count() == 0


def test_kth_largest_is_exact(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.getrandbits(62), rng.randrange(5), 1 << 40]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 77, 250, 499, 500):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 501) is None
    assert quality.kth_largest(df, "x", 0) is None


def _junk(rng):
    return " ".join("".join(rng.choices("QXZ#%", k=5)) for _ in range(40))


def _good(rng):
    return " ".join(rng.choice(["house", "garden", "window", "river", "winter", "silent"]) for _ in range(40))


def test_quality_keeps_good_documents_and_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, _junk(rng) if i % 4 == 0 else _good(rng), "s", 1, "x") for i in range(400)]
    rows += [(None, None, None, None, None), (500, "", "s", 1, "x"), (501, "ab", "s", 1, "x"), (1, rows[1][1], "s", 1, "x"), (502, _good(rng) * 500, "s", 1, "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOC + ", grams int, RATIO int")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 200)] + [(None, 1), (3, None), (1, 1), (2, 7)], "doc_id long, quality int")
    out = quality.select(df, labels).collect()
    assert len(out) == len(rows)
    # importance by brute force: counts of byte n-grams, one model per length
    grams = lambda t: list(quality._grams((t or "").encode(), 16, (4, 8)))
    count = lambda texts: sum((np.bincount(g, minlength=2 << 16) for t in texts for g in grams(t)), np.zeros(2 << 16))
    good = [t for i, t, *_ in rows if i is not None and i < 200 and i % 4]
    ratio = quality._log_ratio(count(good), count([r[1] for r in rows]), 16).astype(np.float32)
    at = {r.id: r for r in out}
    for i, text, *_ in rows:
        n = sum(map(len, grams(text)))
        whole = sum(ratio[g].sum(dtype=np.float64) for g in grams(text))
        assert at[i].grams == n and at[i].importance == pytest.approx(whole * min(1, 256 / max(n, 1)), abs=1e-6)
    # the draw by brute force: the k largest keys of rows with n-grams, and all rows without
    share = 152 / 202
    k = math.ceil(min(1, share + 2 * (share * (1 - share) / 202) ** 0.5) * sum(r.grams > 0 for r in out))
    least = sorted((r.key for r in out if r.grams), reverse=True)[k - 1]
    assert all(r.selected == (r.grams == 0 or r.key >= least - 1e-9) for r in out)
    assert all(abs(r.key - r.importance) < 30 for r in out) and np.std([r.key - r.importance for r in out]) > 1
    kept = quality.keep_selected(df, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(map(str, ids)) == sorted(str(r.id) for r in out if r.selected)
    assert {None, 500, 501, 502} <= set(ids) and ids.count(1) == 2
    assert len([i for i in ids if i is not None and i < 400 and i % 4]) >= 299


def test_inclusion_follows_the_weights(spark):
    """Of three rows with weights 1, 2, 5 the largest key is drawn that often, over many independent draws."""
    n = 6000
    df = spark.range(3 * n).select((F.col("id") % n).alias("draw"), F.floor(F.col("id") / n).alias("item"), "id")
    weight = F.array(*[F.lit(float(np.log(w))) for w in (1, 2, 5)])[F.col("item")]
    top = df.withColumn("key", quality.drawn_key(weight, F.col("id"), 3)).groupBy("draw").agg(F.max_by("item", "key").alias("item"))
    got = {r.item: r["count"] / n for r in top.groupBy("item").count().collect()}
    for item, p in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert abs(got[item] - p) < 4.5 * (p * (1 - p) / n) ** 0.5


def test_quality_with_a_given_k_and_without_target(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, _good(rng), "s", 1, "x") for i in range(50)] + [(50, "ab", "s", 1, "x")], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    chosen = lambda **more: {r.id for r in quality.select(df, labels, **more).where("selected").collect()}
    draws = [chosen(k=20, seed=s) for s in (1, 2, 3)]
    assert all(len(d) == 21 and 50 in d for d in draws) and draws[0] != draws[1] and chosen(k=20, seed=1) == draws[0]
    assert len(chosen()) == 51 and chosen(k=0) == {50}
    assert quality.select(df.where("false"), labels).count() == 0


def test_grams_across_pieces(monkeypatch):
    text = bytes(range(256)) * 5
    whole = np.sort(np.concatenate(list(quality._grams(text, 16, (4, 8)))))
    monkeypatch.setattr(quality, "PIECE", 100)
    assert np.array_equal(whole, np.sort(np.concatenate(list(quality._grams(text, 16, (4, 8))))))


def test_stems_across_pieces(monkeypatch):
    text = toxicity.fold(("stupid idiotic Überwort an of " * 40).encode())
    whole = toxicity.stems(text)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.array_equal(whole, toxicity.stems(text))
    assert len(toxicity.stems(b"")) == 0


def _labelled(n, rng):
    plain = ["house", "garden", "window", "river", "winter", "silent", "people", "water"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=30)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["scumbag", "worthless", "pathetic"])
        if rng.random() < (0.7 if toxic else 0.05):  # the group is named mostly in toxic texts
            words[rng.randrange(30)] = "muslim"
        rows.append((i, " ".join(words), "s", 1, "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learnt_and_fair(spark):
    rng = random.Random(8)
    rows, labels = _labelled(900, rng)
    rows += [(None, None, "s", 1, "x"), (5000, "", "s", 1, "x"), (5001, "the muslim people by the river", "s", 1, "x"), (5002, "the hindu people by the river", "s", 1, "x"), (3, rows[3][1], "s", 1, "x"), (5003, "quiet river " * 20_000, "s", 1, "x")]
    df = spark.createDataFrame(rows, DOC)
    marked = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.classify(df, marked).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert by[5001].predicted == by[5002].predicted == by[5003].predicted == 0
    assert abs(by[5001].score - by[5002].score) < 0.15
    assert 0 <= by[None].score <= 1 and by[None].score == by[5000].score and by[None].held_out is False
    # without the penalty the group's name alone moves the score more
    sample = toxicity._sample(df, marked, "doc_id", "text", "toxic", F.lit(True), 10_000)
    gap = lambda fairness: abs(np.subtract(*toxicity.train(sample, fairness=fairness).scores([rows[-4][1].encode(), rows[-3][1].encode()])))
    assert gap(toxicity.FAIRNESS) < gap(0.0)


def test_toxicity_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "text", "s", 1, "x")], DOC)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(df, none).collect()[0].predicted == 0
    assert toxicity.classify(df.where("false"), none).count() == 0


def test_stems_match_brute_force():
    rng = random.Random(1)
    words = ["a", "an", "the", "seven", "Überwort", "pathetic", "patheticism", "ñ", "x" * 20]
    for _ in range(30):
        text = toxicity.fold(" 1".join(rng.choices(words, k=rng.randint(0, 30))).encode())
        want = set()
        for word in text.split():
            for n, multiplier in zip(toxicity.LENGTHS, toxicity._MULTIPLIERS):
                beginning = int.from_bytes((word + b" " * 8)[:n], "little")
                want.add(beginning * int(multiplier) % (1 << 64) >> 64 - toxicity.BUCKET_BITS)
        assert list(toxicity.stems(text)) == sorted(want)


def test_the_fit_is_a_minimum():
    """No small step lowers log loss + ridge + fairness, as written out here."""
    rng = np.random.default_rng(3)
    x = (rng.random((300, 12)) < 0.3).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + 0.5 * rng.random(300) > 0.9).astype(np.float32)
    swaps = np.zeros((40, 12), np.float32)
    swaps[np.arange(40), rng.integers(0, 12, 40)] = 1
    swaps[np.arange(40), rng.integers(0, 12, 40)] -= 1

    def loss(w, bias, ridge, fairness):
        weight = np.where(y > 0, 150 / y.sum(), 150 / (300 - y.sum()))
        margin = x @ w + bias
        each = weight * (np.logaddexp(0, margin) - y * margin)
        return each.mean() + ridge / 300 * (w @ w) / 2 + fairness / 40 * ((swaps @ w) ** 2).sum() / 2

    for fairness in (0.0, 5.0):
        w, bias = toxicity._fit(x, y, swaps, 1.0, fairness, steps=3000)
        best = loss(w, bias, 1.0, fairness)
        for _ in range(60):
            step = rng.normal(size=13) * 0.02
            assert loss(w + step[:12], bias + step[12], 1.0, fairness) > best - 1e-6


def test_a_repeated_labelled_id_gives_one_text(spark):
    rows = [(1, f"text {i % 3}", "s", 1, "x") for i in range(50)] + [(2, None, "s", 1, "x"), (3, "other", "s", 1, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = sorted((r.label, bytes(r.text)) for r in toxicity._sample(spark.createDataFrame(rows, DOC), labels, "doc_id", "text", "toxic", F.lit(True), 100).collect())
    assert [g[0] for g in got] == [0, 0, 1, 1] and got[0] == (0, b"") and got[1] == (0, b"other")


def test_counterfactuals():
    assert toxicity.counterfactuals(toxicity.fold("Die Männer und die Flüchtlinge.".encode())) == ["die frauen und die ausländer ".encode(), "die männer und die einwanderer ".encode()]
    assert toxicity.counterfactuals("überfrauen frauenä".encode()) == []
    assert toxicity.counterfactuals(b"a muslim man") == [b"a jewish girl", b"a hindu boy"]
    assert toxicity.counterfactuals(b"manifold") == []
