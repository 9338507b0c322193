"""Mixes: quotas, repeats, whole documents, permutations."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempestry.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**50))
def test_permutation(n, key):
    got = mixing.permuted(np.arange(n), n, key)
    assert sorted(got.tolist()) == list(range(n))


def test_permutations_differ():
    a, b = mixing.permuted(np.arange(500), 500, 1), mixing.permuted(np.arange(500), 500, 2)
    assert (a != b).mean() > 0.9 and (a != np.arange(500)).mean() > 0.9


@pytest.fixture(scope="module")
def docs(spark):
    text = "The hinged valve, no. 12, turns at 300 rpm. "
    rows = [(i, text * (1 + i % 7), "big", "x") for i in range(300)] + [(1000 + i, text, "small", "x") for i in range(10)] + [(2000, None, "big", "x"), (2001, text, None, "x"), (2002, text, "other", "x"), (None, text, "big", "x"), (2003, "", "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string")


def test_token_counts(docs):
    import tiktoken

    assert isinstance(mixing.encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}"), tiktoken.Encoding)
    n = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(docs.where("doc_id is not null"), ["doc_id"]).collect()}
    assert n[2000] == 0 and n[2003] == 0 and n[0] > 10 and n[6] > 6 * (n[0] - 2)


def test_round_trip_of_tokenizer():
    e = mixing.encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    for t in ("It's 3.5 mm — naïve straße 漢字 😀\n\n  x", " ", "'s"):
        assert e.decode(e.encode_ordinary(t)) == t


def test_mix(spark, docs):
    targets = spark.createDataFrame([("big", 0.6, 1, "c"), ("small", 0.3, 2, "c"), ("gone", 0.1, 5, "c"), (None, 0.5, 1, "c")], "source string, target_share double, max_repeats int, tokens string")
    mix, plan = mixing.mix_sources(docs, targets, block_tokens=64, shard_slots=16)
    rows = mix.collect()
    report = {r["source"]: r for r in mixing.shares(mix, plan).collect()}
    used = Counter()
    for r in rows:
        for k in range(r["token_from"], r["token_to"]):
            used[r["doc_id"], k] += 1
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    limit = {"big": 1, "small": 2}
    assert all(n <= limit[source[d]] for (d, _), n in used.items())
    assert len({(r["source"], r["epoch"], r["block"], r["doc_id"]) for r in rows}) == len(rows)
    assert report["gone"]["short"] and report["gone"]["tokens_taken"] == 0
    assert report["small"]["short"] and report["small"]["tokens_taken"] == 2 * report["small"]["available_tokens"]  # everything, twice
    assert abs(report["big"]["share_of_target"] - 0.6) < 0.02 and not report["big"]["short"]
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    slots = Counter(r["shard"] for r in mix.select("shard", "source", "slot_of_source").distinct().collect())
    assert len(slots) > 3


def test_packing_keeps_every_token(spark, docs):
    counted = mixing.token_counts(docs.where("doc_id is not null and source is not null"), ["doc_id", "source"])
    p = mixing.pack(counted, 50).collect()
    total = {(r["source"], r["doc_id"]): r["n_tokens"] for r in counted.collect() if r["n_tokens"]}
    got, size = Counter(), Counter()
    for r in p:
        assert 0 <= r["token_from"] < r["token_to"]
        got[r["source"], r["doc_id"]] += r["token_to"] - r["token_from"]
        size[r["source"], r["block"]] += r["token_to"] - r["token_from"]
    assert dict(got) == total
    last = {s: max(b for x, b in size if x == s) for s, _ in size}
    assert all(n == 50 for (s, b), n in size.items() if b != last[s])


@pytest.mark.parametrize("n", [5, 1024, 30_000, 3_000_000_000])
def test_every_shard_is_near_the_target(n):
    share = np.array([0.4, 0.25, 0.15, 0.1, 0.05, 0.03, 0.02])
    quota = np.floor(share * n).astype(np.int64)
    quota[0] += n - quota.sum()
    shards = -(-n // 1024)
    ends = [(0, shards)] if shards < 100 else [(0, 7), (shards - 7, shards)]
    got = {}
    for a, b in ends:
        got |= dict(mixing.shard_counts(quota, 1024, a, b, 3))
        for i in range(a, b):  # any task makes the same
            assert (dict(mixing.shard_counts(quota, 1024, i, i + 1, 3))[i] == got[i]).all()
    for i, c in got.items():
        size = 1024 if i < shards - 1 else n - 1024 * (shards - 1)
        assert c.sum() == size and (np.abs(c - share * size) <= 6 * np.sqrt(share * size) + 6).all()
    if shards < 100:
        assert (sum(got.values()) == quota).all()


def test_packing_order_is_the_hash_order(docs):
    counted = mixing.token_counts(docs.where("doc_id is not null and source is not null"), ["doc_id", "source"])
    a, b = (sorted(map(tuple, mixing.pack(counted, 50, bucket_rows=n).collect())) for n in (1, 20_000))
    assert a == b


def test_no_share_at_all(spark, docs):
    zero = spark.createDataFrame([("big", 0.0, 1), ("small", None, 2)], "source string, target_share double, max_repeats int")
    mix, plan = mixing.mix_sources(docs, zero)
    assert mix.count() == 0 and {r["target_tokens"] for r in plan.collect()} == {0}


def test_empty(spark, docs):
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    mix, plan = mixing.mix_sources(docs, none)
    assert mix.count() == 0 and plan.count() == 0
    some = spark.createDataFrame([("big", 1.0, None)], "source string, target_share double, max_repeats int")
    mix, plan = mixing.mix_sources(docs.limit(0), some)
    assert mix.count() == 0 and [r["tokens_taken"] for r in mixing.shares(mix, plan).collect()] == [0]
