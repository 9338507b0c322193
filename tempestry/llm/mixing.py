"""Mixing sources to target shares of tokens."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm.fmindex import mix
from tempestry.session import cut, ship

#: Folder of the public tokenizers' vocabularies, and the vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoding = {}


def encoding(path: str):
    """The tokenizer of a rank file, built once a process."""
    if path not in _encoding:
        import base64

        import tiktoken

        with Path(path).open("rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoding[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The columns keep, and n_tokens of the whole text (0 for null)."""
    types = dict(docs.dtypes)
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    if path not in getattr(sc, "_tempestry_files", ()):  # the vocabulary goes to the workers once an application
        sc.addFile(path)
        sc._tempestry_files = {*getattr(sc, "_tempestry_files", ()), path}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        enc = encoding(SparkFiles.get(Path(path).name))
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pdf.drop(columns="_text").assign(n_tokens=np.array(n, np.int64))

    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(count, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint")


def running_total(df: DataFrame, group: list[str], order: list, value: str, name: str, bucket) -> DataFrame:
    """df with `name`, the sum of value over all rows of the group before this one.

    In two levels, so that a group isn't sorted in one task: rows are ordered by bucket, then by `order` within it; the buckets'
    totals are summed on the map side and their running sums joined back."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, [*group, "_bucket"])
    return out.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base", "_bucket")


def pack(counted: DataFrame, block_tokens: int, seed: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """Documents of each source laid end to end, in an order drawn by hash, and cut into blocks of block_tokens: source, block,
    doc_id, token_from, token_to (of the document). A document may lie in several blocks; the last block of a source may be
    short; nothing is left out. Ranges of the order hold about bucket_rows documents, however large a source is; their
    number doesn't change the order."""
    bits = max(4, (counted.count() // bucket_rows).bit_length())
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    x = running_total(counted.where("n_tokens > 0"), ["source"], [order, "doc_id"], "n_tokens", "_at", F.shiftright(order, 63 - bits))
    first, end = F.floor(F.col("_at") / block_tokens), F.col("_at") + F.col("n_tokens")
    x = x.withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / block_tokens))))
    lo = F.greatest(F.col("block") * block_tokens - F.col("_at"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block_tokens - F.col("_at"), F.col("n_tokens"))
    return x.select("source", "block", "doc_id", lo.alias("token_from"), hi.alias("token_to"))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), evaluated at i: a Feistel network over a x b >= n, walked until it falls in range."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    x = i.astype(np.int64).copy()
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        left, right = y // b, y % b
        for r in range(3):
            left = (left + (mix(right.astype(np.uint64) + np.uint64((key * 8 + 2 * r) % 2**63)) % np.uint64(a)).astype(np.int64)) % a
            right = (right + (mix(left.astype(np.uint64) + np.uint64((key * 8 + 2 * r + 1) % 2**63)) % np.uint64(b)).astype(np.int64)) % b
        x[todo] = left * b + right
        todo = x >= n
    return x


#: Slots up to which numpy draws without replacement; more are first split in proportion.
DRAWN = 900_000_000


def split_counts(counts: np.ndarray, take: int, key: list[int]) -> np.ndarray:
    """How many of each source are among `take` slots drawn without replacement from counts: multinomial draws given their totals."""
    total = int(counts.sum())
    if total <= DRAWN:
        return np.random.default_rng(key).multivariate_hypergeometric(counts, take, method="marginals")
    whole = [int(c) * take // total for c in counts.tolist()]
    rest = np.argsort([-(int(c) * take % total) for c in counts.tolist()], kind="stable")[: take - sum(whole)]
    out = np.array(whole, np.int64)
    out[rest] += 1
    return out


def shard_counts(quota: np.ndarray, shard_slots: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, slots by source) of the shards first..last-1. Shards have shard_slots slots, the last what is left. Each half of a
    range of shards draws its counts from those of the range, so any task can make its own shards, every shard's counts are a
    multinomial draw given the quotas, and together they are the quotas to the slot."""
    n = int(quota.sum())
    size = lambda lo, hi: min(hi * shard_slots, n) - lo * shard_slots
    stack = [(0, -(-n // shard_slots), quota)]
    while stack:
        lo, hi, counts = stack.pop()
        if lo >= last or hi <= first or lo >= hi:
            continue
        if hi - lo == 1:
            yield lo, counts
            continue
        mid = (lo + hi) // 2
        left = split_counts(counts, size(lo, mid), [seed, lo, hi])
        stack += [(mid, hi, counts - left), (lo, mid, left)]


def plan_mix(pieces: DataFrame, counted: DataFrame, targets: DataFrame, block_tokens: int, total_tokens: int | None = None, shard_slots: int = 1024, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(slots, report). slots: shard, source, epoch, block: which block of which source fills each slot of each output shard.
    report: one row per source of targets.

    The mix has total_tokens (default: all tokens of the sources named) in slots of a block each. A source's quota is its share
    of the slots. For each output shard, source counts are drawn from the multinomial distribution of the shares given the quotas
    (see shard_counts), so quotas are met to the slot and every shard is near the target. The g-th slot of a source takes block p(g mod blocks) of epoch g div blocks, where p is a pseudorandom permutation of the
    source's blocks for that epoch; slots of epochs beyond max_repeats stay empty, which is a source's shortfall. Null or
    negative shares count as 0, a null max_repeats as 1; sources that no document has get nothing and are reported."""
    spark = targets.sparkSession
    ship(spark)
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    supply = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    s = t.join(supply, "source", "left").fillna(0, ["tokens", "documents"]).orderBy("source")
    plan = [r.asDict() for r in s.limit(10_001).collect()]  # one row per source of the mix
    if len(plan) > 10_000:
        raise ValueError("too many sources for a mix")
    total = total_tokens if total_tokens is not None else sum(r["tokens"] for r in plan)
    whole = sum(r["target_share"] for r in plan)
    n = -(-total // block_tokens) if whole > 0 else 0
    shares = np.array([r["target_share"] / (whole or 1.0) for r in plan]) if plan else np.zeros(0)
    quota = np.floor(shares * n).astype(np.int64)
    for k in np.argsort(quota - shares * n, kind="stable")[: int(n - quota.sum()) if plan else 0]:  # largest remainders
        quota[k] += 1
    shards = -(-int(quota.sum()) // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            if len(ids):
                rows = [(i, k, int(c)) for i, got in shard_counts(quota, shard_slots, int(ids.min()), int(ids.max()) + 1, seed) for k, c in enumerate(got.tolist())]
                yield pd.DataFrame(rows, columns=["shard", "k", "n"]).astype("int64")

    counts = cut(spark.range(shards).mapInPandas(draw, "shard bigint, k bigint, n bigint"))
    counts = running_total(counts, ["k"], ["shard"], "n", "g0", F.floor(F.col("shard") / 4096))
    sources = [r["source"] for r in plan]
    blocks = [-(-int(r["tokens"]) // block_tokens) for r in plan]
    repeats = [int(r["max_repeats"]) for r in plan]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, k, c, g0 in zip(pdf["shard"], pdf["k"], pdf["n"], pdf["g0"], strict=True):
                m = blocks[k]
                for at in range(int(g0), min(int(g0 + c), int(quota[k]), m * repeats[k]), 1_000_000):
                    g = np.arange(at, min(at + 1_000_000, int(g0 + c), int(quota[k]), m * repeats[k]))
                    epoch, i = g // m, g % m
                    block = np.empty(len(g), np.int64)
                    for e in np.unique(epoch):
                        block[epoch == e] = permuted(i[epoch == e], m, int(mix(np.array([seed * 1_000_003 + k * 1009 + int(e) + 1], np.uint64))[0] >> np.uint64(8)))
                    yield pd.DataFrame({"shard": int(shard), "source": sources[k], "epoch": epoch, "block": block, "slot_of_source": g})

    slots = counts.where("n > 0").mapInPandas(fill, "shard bigint, source string, epoch bigint, block bigint, slot_of_source bigint")
    made = [(r["source"], float(r["target_share"]), int(quota[k]) * block_tokens, int(r["tokens"]), int(r["documents"]), int(r["max_repeats"]), min(int(quota[k]), blocks[k] * repeats[k]), bool(quota[k] > blocks[k] * repeats[k])) for k, r in enumerate(plan)]
    report = spark.createDataFrame(made, "source string, target_share double, target_tokens bigint, available_tokens bigint, documents bigint, max_repeats int, blocks_taken bigint, short boolean")
    return slots, report


def mix_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = 512, total_tokens: int | None = None, shard_slots: int = 1024, seed: int = 0, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: shard, source, epoch, block, slot_of_source, doc_id, token_from, token_to: the parts of documents that
    make up each output shard. report: per source its target, supply, tokens taken, actual_share of the mix and `short`.

    Every token of a document is used at most once an epoch, so no document more than max_repeats times. Documents with a null
    id, source or text, or of sources not in targets, take no part. Tokens are counted over whole texts, once; the counts (not
    the texts) are cut into a checkpoint and all that follows moves only ids and offsets."""
    named = targets.select("source").where(F.col("source").isNotNull()).distinct()
    x = docs.where("doc_id is not null and text is not null and source is not null").join(F.broadcast(named) if targets.limit(10_001).count() <= 10_000 else named, "source", "left_semi")
    counted = cut(token_counts(x, ["doc_id", "source"], path=path).where("n_tokens > 0"))
    pieces = pack(counted, block_tokens, seed)
    slots, plan = plan_mix(pieces, counted, targets, block_tokens, total_tokens, shard_slots, seed)
    out = slots.join(pieces, ["source", "block"]).select("shard", "source", "epoch", "block", "slot_of_source", "doc_id", "token_from", "token_to")
    return out, plan


def shares(mix_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The report with tokens_taken, their share of the tokens asked for and their actual_share of the mix as made."""
    got = mix_rows.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens_taken"))
    x = plan.join(got, "source", "left").fillna(0, ["tokens_taken"])
    part = lambda c: F.coalesce(F.try_divide(F.col("tokens_taken").cast("double"), F.sum(c).over(Window.partitionBy())), F.lit(0.0))  # noqa: E731  (one row a source)
    return x.withColumns({"share_of_target": part("target_tokens"), "actual_share": part("tokens_taken")})
