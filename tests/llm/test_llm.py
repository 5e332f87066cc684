import base64
import random

import public_tokenizers
import numpy as np
import pytest
import tiktoken
from brute_spans import shared
from pyspark.sql import functions as F

from logloom.llm import bpe, mixing, spans
from logloom.sources.tables import table


@pytest.fixture(scope="module")
def tokenizer():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_corpus_has_the_public_ids(spark, small, tokenizer):
    docs = table(spark, small, "documents")
    want = {r.doc_id: tokenizer.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe.encoded(docs).collect()} == want


def test_random_texts_long_texts_and_another_vocabulary(tokenizer):
    encode, rng = bpe.encoder(bpe.default_vocabulary()).encode, random.Random(2)
    parts = ["a", "in", "ing", "  ", "\n", "0", "é", "日本", "<|endoftext|>", "'s", "🙂", "​", "!!", "ABC"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert encode(t) == tokenizer.encode_ordinary(t)
    assert encode("ab" * 30_000) == tokenizer.encode_ordinary("ab" * 30_000)
    tiny = bpe.Encoder({**{bytes([b]): b for b in range(256)}, b"ab": 256, b"bc": 257, b"abc": 258})
    assert tiny.encode("abcbc") == [258, 257] and tiny.encode("") == [] and tiny.encode(None) == []


def test_encoding_keeps_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a")], "doc_id bigint, text string").withColumn("ids", F.lit(7))
    assert sorted((r.doc_id or 0, r.ids) for r in bpe.encoded(docs).collect()) == [(0, []), (1, []), (1, []), (2, [64])]
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_mix_meets_budgets_and_nests(spark, small):
    docs, targets = table(spark, small, "documents"), table(spark, small, "mix_targets")
    rows = mixing.counted(docs).cache()
    goals, total = mixing.plan(rows, targets)
    sizes = {}
    for r in rows.collect():
        sizes.setdefault(r.source, []).append((r.hash, r.n_tokens))
    taken = {r.source: r.mixed_tokens for r in mixing.shares(docs, targets).collect()}
    goals = goals.collect()
    for g in goals:
        mine = sorted(sizes.get(g.source, []))
        have = sum(n for _, n in mine)
        cuts, run = [g.rounds * have], g.rounds * have
        if g.rounds < g.max_repeats:
            for _, n in mine:
                run += n
                cuts.append(run)
        best = min(abs(c - g.budget) for c in cuts)
        assert abs(taken[g.source] - g.budget) == pytest.approx(best), g
    copies = mixing.mixed(docs, targets)
    limit = {g.source: g.max_repeats for g in goals}
    assert all(r.copies <= limit[r.source] for r in copies.collect())
    smaller = targets.withColumn("weight", F.col("weight") * 0.5)
    low, high = ({r.doc_id: r.copies for r in mixing.mixed(docs, t).collect()} for t in (smaller, targets))
    assert all(high.get(d, 0) >= c for d, c in low.items())


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a b"), (2, "s", None), (3, "s", ""), (4, "s", "one two three"), (5, "other", "x" * 50)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("s", 0.9, 2), ("s", None, None), ("none", 0.5, None), (None, 1.0, 1), ("zero", -1.0, 3)], "source string, weight double, max_repeats int")
    got = {r.doc_id: r.copies for r in mixing.mixed(docs, targets).collect()}
    assert set(got) <= {2, 3, 4} and got[4] == 2
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    assert mixing.mixed(docs, targets.limit(0)).count() == 0
    assert {r.source: r.mixed_tokens for r in mixing.shares(docs, targets).collect()}["none"] == 0


def found(df, length=12, group=spans.GROUP):
    return sorted((r.doc_id, r.span_from, r.span_to) for r in spans.shared_spans(df, length, group).collect())


def test_spans_against_all_windows(spark):
    rng = random.Random(11)
    words = ["alpha ", "béta ", "日本語", "x", "aaaa", "\n", "🙂 "]
    block = "".join(rng.choice(words) for _ in range(60))
    docs = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, f"{i}" * rng.randint(0, 9) + block[rng.randint(0, 40):][: rng.randint(8, 80)] + f"{i}{i}") for i in range(40)]
    docs += [(200 + i, block) for i in range(30)] + [(300, "a" * 500), (301, "a" * 11), (302, "a" * 13), (303, None), (304, ""), (305, "zyx" * 40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pos", F.lit("clash"))
    want = shared(docs, 12)
    assert want and not any(w[0] == 305 for w in want)
    assert found(df) == want
    assert found(df, group=4) == want  # partitions split down to single windows
    assert found(df.unionByName(df)) == want
    assert found(df.limit(0)) == []


def test_spans_of_null_ids_and_parts(spark):
    df = spark.createDataFrame([(None, "0123456789abcdef"), (None, "0123456789abcdef"), (1, "xx0123456789abcd")], "doc_id bigint, text string")
    assert {(r.doc_id, r.span_from, r.span_to) for r in spans.shared_spans(df, 12).collect()} == {(None, 0, 14), (1, 2, 16)}
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_parts(df, spans.shared_spans(df, 12)).collect()}
    assert got == {None: (16, 14), 1: (16, 14)}


def test_periodic_and_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    row = "| 12 | ab | 7 |\n"
    docs = [(0, "a" * 700), (1, noise(50) + "a" * 300 + noise(50)), (2, "ab" * 400), (3, noise(30) + "ab" * 100 + "b" + "ab" * 50), (4, "b" + "ab" * 45)]
    docs += [(5, row * 60), (6, noise(9) + row * 20 + noise(40)), (7, "| 13 | ab | 7 |\n" * 9 + row * 9), (8, "a" * 11)]
    docs += [(9, noise(5000)), (10, None)]
    docs += [(11, noise(400) + docs[9][1][1000:2300] + noise(10)), (12, docs[9][1][1010:1025] + "!" + docs[9][1][2200:])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = shared(docs, 12)
    assert found(df) == want and found(df, group=3) == want
    monkeypatch.setattr(spans, "PIECE", 100)
    monkeypatch.setattr(spans, "BATCH", 50)
    assert found(df) == want


def test_anchors_of_a_period_are_few(spark):
    long = spans.anchors(spark.createDataFrame([(1, "a" * 200_000), (2, "xyz, " * 40_000)], "doc_id bigint, text string"))
    rows = long.collect()
    assert len(rows) < 700 and sum(r.more for r in rows) > 200_000


def test_tree_of_sorted_suffixes():
    words = sorted(["banana", "bananas", "band", "ban", "can", "cab", "cabs"])
    common = np.array([-1] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])])
    tree = spans.Tree(common, 2)
    got = {(d, tuple(words[f:l + 1]), h) for d, f, l, h in zip(tree.depth.tolist(), tree.first, tree.last, tree.height.tolist())}
    assert got == {(3, ("ban", "banana", "bananas", "band"), 1), (6, ("banana", "bananas"), 0), (2, ("cab", "cabs", "can"), 1), (3, ("cab", "cabs"), 0)}
