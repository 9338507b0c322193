"""Shared spans against brute force, and the index against plain search."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempestry.llm import fmindex, spans


def brute_pairs(texts, least):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(i)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def brute_cover(texts, i, least):
    others = {t[k : k + least] for j, t in texts.items() if j != i for k in range(len(t or "") - least + 1)}
    t, hit = texts[i] or "", set()
    for k in range(len(t) - least + 1):
        if t[k : k + least] in others:
            hit |= set(range(k, k + least))
    return len(hit)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß 漢字😀.") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    pool = [text(90)[: rng.choice([298, 299, 300, 301, 305, 340])] for _ in range(8)] + ["ab" * 200, "x" * 700]
    out = {}
    for i in range(n):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p, k = rng.choice(pool), rng.randint(0, len(t))
            t = t[:k] + p + t[k:]
        out[i] = t
    out[n], out[n + 1], out[n + 2] = out[3], out[3], out[5]  # copies
    out[n + 3], out[n + 4] = "", None
    base = text(400)
    out[n + 5], out[n + 6] = base, base[:900] + "!" + base[901:1800] + "?" + base[1801:]  # nearly the same
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2000), (2, 6), (3, 0)])
def test_pairs_brute(spark, seed, hot):
    """With all keys light, some heavy and all heavy."""
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(None, "x" * 900, "")], "doc_id long, text string, rep string")
    sh = spans.shared_spans(df, "doc_id", "text", hot=hot)
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in spans.shared_pairs(sh).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 300)
    share = {r["doc_id"]: r for r in spans.shared_shares(df, "doc_id", "text", sh).collect()}
    assert set(share) == set(texts)
    for i, r in share.items():
        want = brute_cover(texts, i, 300)
        assert r["shared_chars"] == (want if not (r["copies"] and len(texts[i]) >= 300) else len(texts[i])), i


def test_hot_keys_are_split(spark):
    rng = random.Random(5)
    p = "".join(rng.choice("abcdefgh ") for _ in range(320))
    texts = {i: "".join(rng.choice("ijklmnop ") for _ in range(50)) + p + "".join(rng.choice("ijklmnop ") for _ in range(50)) for i in range(24)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sh = spans.shared_spans(df, "doc_id", "text", hot=5)
    assert sh.spans.count() == 0
    every = {(a, b) for a in texts for b in texts if a < b}
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in spans.shared_pairs(sh).collect()} == every
    assert {(r["a"], r["b"]) for r in spans.window_pairs(sh.windows, hot=5).collect()} == every


def test_passage_in_very_many_texts(spark):
    """One passage in 20,000 texts: no task of Python holds them, and each text knows what it shares."""
    rng = random.Random(6)
    p = "".join(rng.choice("abcdefgh ") for _ in range(400))
    head = F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(" "), F.sha2(F.col("id").cast("string"), 256))
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(head, F.lit(p), F.sha2(head, 256)).alias("text"))
    sh = spans.shared_spans(df, "doc_id", "text")
    got = spans.shared_shares(df, "doc_id", "text", sh).agg(F.count("doc_id"), F.min("shared_chars"), F.max("shared_chars"), F.max("stretches")).first()
    assert got[0] == 20_000 and 400 <= got[1] <= got[2] < 440 and got[3] == 1


def test_very_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(2_300_000))
    texts = [(1, long), (2, "q" * 100 + long[999_900:1_000_210] + "z" * 50), (3, long[2_299_690:]), (4, long[5:304])]
    sh = spans.shared_spans(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    assert sorted((r["doc_a"], r["doc_b"], r["length"]) for r in sh.spans.select("doc_a", "doc_b", "length").distinct().collect()) == [(1, 2, 310), (1, 3, 310)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    sh = spans.shared_spans(df, "doc_id", "text")
    assert spans.shared_pairs(sh).count() == 0 and spans.shared_shares(df, "doc_id", "text", sh).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=30), min_size=1, max_size=5), st.lists(st.integers(0, 4), min_size=1, max_size=6))
def test_backward_search(seqs, pattern):
    """Interval sizes equal the pattern's occurrences; owners are told apart."""
    n = len(seqs)
    t = np.array([x for i, s in enumerate(seqs) for x in [*[v + n for v in s], i]])
    owner = np.array([i for i, s in enumerate(seqs) for _ in range(len(s) + 1)])
    present = np.unique(t)
    dense = np.searchsorted(present, t)
    if not set(v + n for v in pattern) <= set(present.tolist()):
        return
    ix = fmindex.FMIndex(dense, owner)
    assert ix.locate(np.arange(ix.n)).tolist() == fmindex.suffix_array(dense).tolist()
    lo, hi = np.zeros(1, np.int64), np.full(1, ix.n)
    for v in reversed(pattern):
        lo, hi = ix.extend(lo, hi, np.searchsorted(present, [v + n]))
    found = [(i, k) for i, s in enumerate(seqs) for k in range(len(s)) if s[k : k + len(pattern)] == pattern]
    assert int(hi[0] - lo[0]) == len(found)
    assert bool(ix.shared(lo, hi)[0]) == (len({i for i, _ in found}) > 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 12))
def test_minima(values, w):
    h = np.array(values, np.uint64)
    want = {i for k in range(max(1, len(values) - w + 1)) for i in range(k, min(k + w, len(values))) if values[i] == min(values[k : k + w])}
    assert set(fmindex.minima(h, w).tolist()) == want


def test_classes(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, None), (8, None)], "i long, t string")
    got = sorted(map(tuple, spans.text_classes(df.where("t is not null"), "i", "t").collect()))
    assert got == [(1, 1), (3, 1)]
