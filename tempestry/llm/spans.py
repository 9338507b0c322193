"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import fmindex
from tempestry.session import cut, ship, written

#: Copies are broadcast up to so many rows (8 bytes each), counted beforehand; beyond, the join shuffles.
BROADCAST_COPIES = 1_000_000
#: Code points hashed at once, and held in one FM-index shard (a light key's pieces are never split over two).
BATCH, SHARD = 1_000_000, 2_000_000


def text_classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, rep: the lowest id with exactly the same text; only rows of classes with more than one member.

    Classes are formed by a 96-bit hash and the length; combined on the map side, so a class may hold most of the rows."""
    h = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_a"), F.hash(text).alias("_b"), F.length(text).alias("_n"))
    classes = h.groupBy("_a", "_b", "_n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return h.join(classes, ["_a", "_b", "_n"]).select("doc_id", "rep")


def _anchors(gram: int, window: int):
    """Mapper: the positions whose hash of `gram` code points is the lowest of some `window` consecutive ones."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            todo: list[tuple[int, int, np.ndarray]] = []
            size = 0

            def flush() -> pd.DataFrame:
                codes = np.concatenate([c for _, _, c in todo])
                bounds = np.concatenate([[0], np.cumsum([len(c) for _, _, c in todo])])
                h = fmindex.gram_hash(fmindex.prefix(codes), gram)
                for e in bounds[1:]:  # grams that run over an end are none
                    h[max(0, e - gram + 1) : e] = np.iinfo(np.uint64).max
                at = fmindex.minima(h, window)
                at = at[h[at] != np.iinfo(np.uint64).max]
                doc = np.searchsorted(bounds, at, side="right") - 1
                ids, offs = np.array([i for i, _, _ in todo]), np.array([o for _, o, _ in todo])
                return pd.DataFrame({"fp": h[at].view(np.int64), "doc_id": ids[doc], "pos": (at - bounds[doc] + offs[doc]).astype(np.int32)})

            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                for o in range(0, max(1, len(codes) - gram - window), BATCH):  # long texts in overlapping slices
                    part = codes[o : o + BATCH + gram + window]
                    todo.append((int(i), o, part))
                    size += len(part)
                    if size >= BATCH:
                        yield flush()
                        todo, size = [], 0
            if todo:
                yield flush()

    return build


def _pieces(gram: int, least: int):
    """Mapper: per document and light key the text around its anchors, touching stretches merged; and, with two hashes each, the windows of
    `least` code points whose lowest gram is an anchor of a heavy key."""
    margin = least - gram

    def heavy_windows(doc: int, text: str, fps: set[int]) -> Iterator[tuple[np.ndarray, ...]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wanted = np.array(sorted(fps), np.int64).view(np.uint64)
        for o in range(0, max(1, len(codes) - least + 1), BATCH):
            part = codes[o : o + BATCH + least - 1]
            s = np.flatnonzero(np.isin(fmindex.slide_min(fmindex.gram_hash(fmindex.prefix(part), gram), margin + 1), wanted))
            h1, h2 = (h[s].view(np.int64) for h in fmindex.window_hashes(part, least))
            yield np.full(len(s), doc), o + s, h1, h2

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> Iterator[pd.DataFrame]:
            light = pd.DataFrame(rows, columns=["rep", "doc_id", "start", "piece"])
            none = pd.array([None] * len(light), dtype="Int64")
            yield light.assign(h1=none, h2=none)
            if wide:
                doc, start, h1, h2 = (np.concatenate(x) for x in zip(*wide, strict=True))
                yield pd.DataFrame({"rep": pd.array([None] * len(doc), dtype="Int64"), "doc_id": doc, "start": start, "piece": None, "h1": h1, "h2": h2})

        for pdf in batches:
            rows: list[tuple] = []
            wide: list[tuple[np.ndarray, ...]] = []
            size = 0
            for doc, text, marks in zip(pdf["doc_id"], pdf["text"], pdf["marks"], strict=True):
                by: dict[int, list[int]] = {}
                heavy: set[int] = set()
                for m in marks:
                    if m["heavy"]:
                        heavy.add(int(m["fp"]))
                    else:
                        by.setdefault(int(m["rep"]), []).append(int(m["pos"]))
                for rep, at in by.items():
                    a = b = -1
                    for p in [*sorted(at), None]:
                        if p is not None and a >= 0 and p - margin <= b:
                            b = p + gram + margin
                            continue
                        if a >= 0:
                            rows.append((rep, int(doc), a, text[a:b]))
                        if p is not None:
                            a, b = max(0, p - margin), p + gram + margin
                for w in heavy_windows(int(doc), text, heavy) if heavy else ():
                    wide.append(w)
                    size += len(w[0])
                if size > 500_000:
                    yield from flush()
                    rows, wide, size = [], [], 0
            yield from flush()

    return build


def _search(least: int):
    """Mapper: shards of whole light keys, each with an FM-index that its pieces are searched in."""

    def run(rows: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(rows, ignore_index=True)
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in p["piece"]]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in parts])])
        doc, start = p["doc_id"].to_numpy(np.int64), p["start"].to_numpy(np.int64)
        m = fmindex.matches(np.concatenate(parts), starts, doc, p["rep"].to_numpy(np.int64), least)
        a, b = m[:, 0], m[:, 1]
        return pd.DataFrame({"doc_a": doc[a], "doc_b": doc[b], "start_a": start[a] + m[:, 2] - starts[a], "start_b": start[b] + m[:, 3] - starts[b], "length": m[:, 4]}).drop_duplicates()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf["rep"].to_numpy(np.int64)
            fresh = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            upto = np.concatenate([[0], np.cumsum(pdf["piece"].str.len().to_numpy(np.int64))])
            begin = 0
            for x in np.flatnonzero(fresh).tolist():  # a shard ends where a key does
                if size + upto[x] - upto[begin] >= SHARD:
                    if x > begin:
                        held.append(pdf.iloc[begin:x])
                    if held:
                        yield run(held)
                    held, size, begin = [], 0, x
            held.append(pdf.iloc[begin:])
            size += int(upto[-1] - upto[begin])
            last = key[-1]
        if held:
            yield run(held)

    return build


class Shared(NamedTuple):
    """What shared_spans finds. spans: doc_a < doc_b, start_a, start_b, length, between documents of light keys. windows: h1, h2,
    doc_id, start of each window of `least` code points of a heavy key that stands in more than one document (equal hashes: equal
    windows), and n, how many windows are equal to it. copies: doc_id, rep. least: code points of a span."""

    spans: DataFrame
    windows: DataFrame
    copies: DataFrame
    least: int


def shared_spans(docs: DataFrame, doc_id: str, text: str, least: int = 300, gram: int = 100, hot: int = 2_000, many: int = 200) -> Shared:
    """Runs of at least `least` equal code points in the texts as stored, between representatives of different texts. copies has
    the classes of exactly equal texts with more than one member. Every such run is covered by spans (maximal runs, or overlapping
    stretches of them) or by windows (all of its windows); see Shared.

    Rows with a null id or text, and texts under `least` code points, take no part. Ids must be unique. Whole texts are
    used, whatever their length.

    Documents are sharded so that only those that can share a span meet: of all grams of `gram` code points those that are
    lowest in a window of least - gram + 1 are anchors, so every span of `least` has one, the same in both texts. Anchors
    found in one text only are dropped; the rest take the lowest id among their texts as key.

    Light keys, of at most `hot` anchors in all and `many` of any one: their pieces, the text around the anchors with touching stretches merged, go into one
    shard, whose compressed FM-index gives the matching statistics of every piece by backward search over its wavelet matrix.
    A shard holds SHARD code points and one key's at most (hot times 2 least - gram), so a task's memory has a bound.
    Heavy keys, of any size: each window of `least` whose lowest gram is an anchor of the key becomes a row of hashes (128 bits);
    equal ones are counted by an aggregate that combines on the map side. No list of a key's texts is held anywhere.
    Anchors are written once, counted on the map side and joined once; texts are shuffled once, and only those with marks used."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    copies = cut(text_classes(docs, "doc_id", "text"))
    extra = copies.where("doc_id <> rep").select("doc_id")
    if extra.count() <= BROADCAST_COPIES:
        extra = F.broadcast(extra)
    reps = docs.join(extra, "doc_id", "left_anti")
    anchors = written(reps.mapInPandas(_anchors(gram, least - gram + 1), "fp bigint, doc_id bigint, pos int"))
    keys = anchors.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("rep <> _last").select("fp", "rep", "_n")
    keys = written(keys)
    heavy = keys.groupBy("rep").agg(F.sum("_n").alias("_load"), F.max("_n").alias("_most")).where((F.col("_load") > hot) | (F.col("_most") > many)).select("rep", F.lit(True).alias("_heavy"))
    keys = keys.join(heavy, "rep", "left").select("fp", "rep", F.coalesce("_heavy", F.lit(False)).alias("_heavy"))
    mark = F.struct("rep", "pos", "fp", F.col("_heavy").alias("heavy"))
    marks = anchors.join(keys, "fp").groupBy("doc_id").agg(F.collect_list(mark).alias("marks"))  # bounded by the text's length
    marked = reps.hint("shuffle_merge").join(marks, "doc_id").select("doc_id", "text", "marks")
    pieces = written(marked.mapInPandas(_pieces(gram, least), "rep bigint, doc_id bigint, start int, piece string, h1 bigint, h2 bigint"))
    light = pieces.where("rep is not null").select("rep", "doc_id", "start", "piece").repartition("rep").sortWithinPartitions("rep")
    spans = light.mapInPandas(_search(least), "doc_a bigint, doc_b bigint, start_a bigint, start_b bigint, length bigint")
    w = pieces.where("rep is null").select("h1", "h2", "doc_id", "start")
    members = w.groupBy("h1", "h2").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("n")).where("_a <> _b").select("h1", "h2", "n")
    return Shared(spans, w.join(members, ["h1", "h2"]), copies, least)


def window_pairs(windows: DataFrame, hot: int = 2_000) -> DataFrame:
    """a < b of documents that have a window in common, each pair at least once.

    Windows with the same documents (told by their number and an order-free hash) stand for one another, so a long passage is
    joined once. The documents of one are cut into parts of about `hot`, each joined with all by hash."""
    w = windows.select("h1", "h2", "doc_id").distinct()
    sets = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("_s"), F.min("doc_id").alias("_m"))
    one = sets.groupBy("n", "_s", "_m").agg(F.min(F.struct("h1", "h2")).alias("_w")).select(F.col("_w.h1").alias("h1"), F.col("_w.h2").alias("h2"), F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    m = w.join(one, ["h1", "h2"])
    left = m.select("h1", "h2", F.col("doc_id").alias("a"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    right = m.select("h1", "h2", F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["h1", "h2", "part"]).where("a < b").select("a", "b")


def shared_pairs(shared: Shared) -> DataFrame:
    """All pairs doc_id_a < doc_id_b of documents that share a span, copies expanded."""
    pairs = shared.spans.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).unionByName(window_pairs(shared.windows)).distinct()
    members = shared.copies.select("rep", F.col("doc_id").alias("m"))
    wide = pairs.join(members.withColumnsRenamed({"rep": "a", "m": "ma"}), "a", "left").join(members.withColumnsRenamed({"rep": "b", "m": "mb"}), "b", "left")
    linked = wide.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    same = members.withColumnRenamed("m", "x").join(members.withColumnRenamed("m", "y"), "rep").where("x < y").select("x", "y")
    return linked.unionByName(same).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_shares(docs: DataFrame, doc_id: str, text: str, shared: Shared) -> DataFrame:
    """One row per document with a non-null id: doc_id, class_id (the lowest id of an equal text, or its own), n_chars, copies
    (others of its class), shared_chars (code points within spans that stand elsewhere; all of a text with copies), share
    (of n_chars; 0.0 for an empty or null text), stretches (separate stretches that these make).

    Documents of heavy keys are never paired: their windows are known to stand elsewhere by count."""
    spans, copies = shared.spans, shared.copies
    one = spans.select(F.col("doc_a").alias("doc"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
    two = spans.select(F.col("doc_b").alias("doc"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    three = shared.windows.select(F.col("doc_id").alias("doc"), F.col("start").cast("bigint").alias("s"), (F.col("start") + shared.least).cast("bigint").alias("e"))
    w = Window.partitionBy("doc").orderBy("s")
    cover = one.unionByName(two).unionByName(three).groupBy("doc", "s").agg(F.max("e").alias("e"))  # at most one row per start: bounded by the text
    cover = cover.withColumn("seen", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("seen", F.lit(0))))
    cover = cover.groupBy("doc").agg(F.sum(new).alias("shared"), F.count_if(F.col("seen").isNull() | (F.col("s") > F.col("seen"))).alias("parts"))
    sizes = copies.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies"))
    x = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    x = x.join(copies.withColumnRenamed("rep", "class_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    x = x.join(sizes.withColumnRenamed("rep", "class_id"), "class_id", "left").join(cover.withColumnRenamed("doc", "class_id"), "class_id", "left")
    copied = F.col("copies") > 0
    chars = F.when(copied, F.col("n_chars").cast("bigint")).otherwise(F.coalesce("shared", F.lit(0)))
    parts = F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("parts", F.lit(0)))
    return x.select("doc_id", "class_id", "n_chars", F.coalesce("copies", F.lit(0)).alias("copies"), chars.alias("shared_chars"), F.coalesce(F.try_divide(chars.cast("double"), F.col("n_chars").cast("double")), F.lit(0.0)).alias("share"), parts.alias("stretches"))
