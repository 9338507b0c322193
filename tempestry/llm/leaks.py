"""Evaluation texts leaking into training text, verbatim or with other names, numbers and units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm.fmindex import mix
from tempestry.session import ship, written

WORD = re.compile(r"[^\W_]+")
#: A word that starts with a letter; a number with its points and commas; any other word; what ends a sentence.
TOKEN = re.compile(r"[^\W\d_][^\W_]*|\d+(?:[.,]\d+)+(?![^\W_])|[^\W_]+|[.!?:;\n]")
GLUED = re.compile(r"^(\d+)([^\W\d_]+)$")
# Words that stand for a unit of measurement where they follow a number.
UNITS = frozenset("mm cm m km um µm nm micrometre micrometres millimetre millimetres centimetre centimetres metre metres inch inches ft feet mil mils µg mg g kg tonne tonnes lb lbs oz n kn nm ns µs us ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz mv v kv ma a w kw mw kwh j kj mj pa kpa mpa bar mbar psi k c f degrees degree deg rpm percent pct ppm ppb l ml litre litres gallon gallons bit bits byte bytes kb mb gb tb db ohm ohms mol mole moles".split())
#: A window of templates has at least so many words of its own; windows with fewer stay word for word.
LEAST_FIXED = 6
#: A word that fewer than this share of all texts use is a name (or another term of that text's own), one that more use is ordinary.
ORDINARY_SHARE = 0.001
#: Code points tokenised at once; longer texts are taken in such slices, which overlap by OVERLAP tokens.
SLICE, OVERLAP = 4_000_000, 4_096
#: 64-bit words of the sieve, by the number of item windows between these bounds (32 MB at most); the size changes no result.
SIEVE_LEAST, SIEVE_MOST = 1 << 14, 1 << 22
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_BOUNDARY, _NUMBER, _COMPOSITE, _CAP, _UNIT, _ORDINARY = 1, 2, 4, 8, 16, 32
_SLOT = {"n": np.uint64(0xA0761D6478BD642F), "u": np.uint64(0xE7037ED1A0B428DB), "p": np.uint64(0x8EBC6AF09C88C6E3)}
_PLAIN = np.uint64(0x589965CC75374CC3)  # sets windows kept word for word apart


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


class Lexicon(dict):
    """token -> number, with the hash of its lower case and what kind of token it is. Emptied between texts when it grows large."""

    def __init__(self, ordinary: np.ndarray | None) -> None:
        super().__init__()
        self.ordinary = ordinary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.low: list[str] = []
        self.parts: dict[int, list[int]] = {}
        self.glued: dict[int, list[int]] = {}
        self.hash, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def __missing__(self, token: str) -> int:
        i = len(self.low)
        low = token.lower()
        self[token] = i
        self.low.append(low)
        if i >= len(self.hash):
            self.hash, self.flags = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.hash, self.flags))
        h = xxhash.xxh3_64_intdigest(low)
        self.hash[i] = h
        if token in ".!?:;\n":
            self.flags[i] = _BOUNDARY
            return i
        f = _CAP if token[0].isupper() else 0
        words = WORD.findall(low)
        if low.isdigit() or (len(words) > 1 and all(w.isdigit() for w in words)):
            f |= _NUMBER
        if len(words) > 1:
            f |= _COMPOSITE
        if low in UNITS:
            f |= _UNIT
        if self.ordinary is not None:
            at = int(np.searchsorted(self.ordinary, np.uint64(h)))
            if at < len(self.ordinary) and int(self.ordinary[at]) == h:
                f |= _ORDINARY
        self.flags[i] = f
        if len(words) > 1:
            self.parts[i] = [self[w] for w in words]
        m = GLUED.match(low)
        if m and m.group(2) in UNITS:
            self.glued[i] = [self[m.group(1)], self[m.group(2)]]
        return i

    def spread(self, ids: np.ndarray, table: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """ids with those in table replaced by their lists, and the place in ids that each comes from."""
        at = np.arange(len(ids))
        if not table:
            return ids, at
        n = np.ones(len(self.low), np.int64)
        for k, v in table.items():
            n[k] = len(v)
        lens = n[ids]
        if not (lens > 1).any():
            return ids, at
        out, at = np.repeat(ids, lens), np.repeat(at, lens)
        begin = np.cumsum(lens) - lens
        for j in np.flatnonzero(lens > 1).tolist():
            out[begin[j] : begin[j] + lens[j]] = table[int(ids[j])]
        return out, at


def _roll(k: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n."""
    m = max(0, len(k) - n + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * _M + k[j : j + m]
    return mix(h)


def windows(lex: Lexicon, ids: np.ndarray, doc: np.ndarray, n: int, keep) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Windows of n of all texts at once. ids: tokens of text after text; doc: each token's text.

    Rows (text, family, position, hash, tokens, kinds) of those whose hash is kept, in two families. Family 1: windows of n
    words with every number a placeholder. Family 2: windows of n template tokens: numbers with their points and commas, units
    right after a number, and names (words that aren't ordinary, or capitals within a sentence; neighbouring ones are
    one) are placeholders. Windows with under LEAST_FIXED words of their own: in family 1 word for word, in family 2 none. Also
    how many windows of either family each text has (those of family 2 with words enough)."""
    flags = lex.flags[ids]
    texts = int(doc[-1]) + 1 if len(doc) else 0
    rows: list[tuple] = []
    # Family 1
    plain = np.flatnonzero((flags & _BOUNDARY) == 0)
    w, at = lex.spread(ids[plain], lex.parts)
    wd = doc[plain][at]
    number = (lex.flags[w] & _NUMBER) > 0
    exact = lex.hash[w]
    h = _roll(np.where(number, _SLOT["n"], exact), n)
    m = len(h)
    inside = wd[:m] == wd[n - 1 :] if m else np.zeros(0, bool)
    one = np.bincount(wd[:m][inside], minlength=texts)
    fixed = np.concatenate([[0], np.cumsum(~number)])
    few = np.flatnonzero((fixed[n:] - fixed[:-n] < LEAST_FIXED) & inside) if m else np.zeros(0, np.int64)
    if len(few):
        h[few] = _roll(exact, n)[few] ^ _PLAIN
    for p in np.flatnonzero(inside & keep(h)).tolist():
        rows.append((int(wd[p]), 1, p, int(h[p].view(np.int64)), " ".join([lex.low[x] for x in w[p : p + n].tolist()]), ""))
    # Family 2
    t, at = lex.spread(ids, lex.glued)
    td, tf = doc[at], lex.flags[t]
    real = np.flatnonzero((tf & _BOUNDARY) == 0)
    if not len(real):
        return rows, one, np.zeros(texts, np.int64)
    new = np.ones(len(real), bool)  # first of a sentence or text
    new[1:] = (np.diff(real) > 1) | (td[real[1:]] != td[real[:-1]])
    t, td, tf = t[real], td[real], tf[real]
    number = (tf & _NUMBER) > 0
    after = np.zeros(len(t), bool)
    after[1:] = number[:-1] & ~new[1:]
    unit = ((tf & _UNIT) > 0) & after & ~number
    name = ~number & ~unit & (((tf & _ORDINARY) == 0) | (((tf & _CAP) > 0) & ~new))
    first = np.ones(len(t), bool)
    first[1:] = ~(name[1:] & name[:-1] & ~new[1:])
    seq = np.flatnonzero(first)
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))[seq]
    value = np.where(kind == 0, lex.hash[t[seq]], np.array([0, _SLOT["n"], _SLOT["u"], _SLOT["p"]], np.uint64)[kind])
    h = _roll(value, n)
    m = len(h)
    sd = td[seq]
    fixed = np.concatenate([[0], np.cumsum(kind == 0)])
    ok = (sd[:m] == sd[n - 1 :]) & (fixed[n:] - fixed[:-n] >= LEAST_FIXED) if m else np.zeros(0, bool)
    two = np.bincount(sd[:m][ok], minlength=texts)
    ends = np.append(seq[1:], len(t))
    for p in np.flatnonzero(ok & keep(h)).tolist():
        tokens = ["_".join([lex.low[x] for x in t[a:b].tolist()]) for a, b in zip(seq[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True)]
        rows.append((int(sd[p]), 2, p, int(h[p].view(np.int64)), " ".join(tokens), "".join("wnup"[k] for k in kind[p : p + n].tolist())))
    return rows, one, two


def _slices(text: str) -> Iterator[list[str]]:
    """The tokens of a text, or of its slices."""
    if len(text) <= SLICE:
        yield TOKEN.findall(text)
        return
    tail: list[str] = []
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and (text[end].isalnum() or text[end - 1].isdigit()):  # cut beside a word, and in no number
            end += 1
        tail = tail[-OVERLAP:] + TOKEN.findall(text, at, min(end, len(text)))
        yield tail
        at = end


def _ids(lex: Lexicon, tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(lex.__getitem__, tokens), np.int64, len(tokens))


def _batches(pdf: pd.DataFrame, lex: Lexicon, whole: bool = False, size: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, tokens, each token's place in rows) of about `size` code points at a time; whole: all slices of a text together."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    n = 0

    def flush():
        return np.array(rows), np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    for i, text in enumerate(pdf["text"]):
        slices = -(-len(text) // SLICE)
        for k, tokens in enumerate(_slices(text), 1):
            rows.append(i)
            parts.append(_ids(lex, tokens))
            n += min(len(text), SLICE)
            if n >= size and (not whole or k >= slices):
                yield flush()
                rows, parts, n = [], [], 0
                if len(lex) > 500_000:
                    lex.reset()
    if parts:
        yield flush()


def _word_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mapper: hash of each word and in how many of the batch's texts (text, times) it stands."""
    lex = Lexicon(None)
    for pdf in batches:
        times = pdf["times"].to_numpy(np.int64)
        for rows, ids, doc in _batches(pdf, lex, whole=True):
            w, at = lex.spread(ids, lex.parts)
            w, d = (x[(lex.flags[w] & _BOUNDARY) == 0] for x in (w, rows[doc[at]]))
            h = lex.hash[w]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            u, back = np.unique(h[first], return_inverse=True)
            yield pd.DataFrame({"word": u.view(np.int64), "texts": np.bincount(back, weights=times[d[first]], minlength=len(u)).astype(np.int64)})


def ordinary_words(docs: DataFrame, items: DataFrame, share: float = ORDINARY_SHARE) -> DataFrame:
    """word (hash): those that at least this share of all documents and items use. A text has a bounded number of different words,
    so there are at most that many divided by share, whatever the corpus."""
    both = docs.select("text", F.lit(1).cast("bigint").alias("times")).unionByName(items.select("text", "times"))
    total = docs.agg(F.count("text").alias("n")).unionByName(items.agg(F.sum("times").alias("n"))).agg(F.sum("n").alias("_total"))
    use = both.mapInPandas(_word_texts, "word bigint, texts bigint").groupBy("word").agg(F.sum("texts").alias("texts"))
    return use.crossJoin(F.broadcast(total)).where(F.col("texts") >= F.col("_total") * share).select("word")  # one row


def _item_windows(ordinary, n: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(ordinary.value)
        for pdf in batches:
            out = []
            for rows, ids, doc in _batches(pdf, lex):
                found, one, two = windows(lex, ids, doc, n, lambda h: np.ones(len(h), bool))
                out += [(int(pdf["item_id"].iat[rows[d]]), int(pdf["key"].iat[rows[d]]), int(pdf["times"].iat[rows[d]]), int(one[d]), int(two[d]), f, q, h, t, k) for d, f, q, h, t, k in found]
            yield pd.DataFrame(out, columns=["item_id", "key", "times", "item_windows", "template_windows", "family", "q", "hash", "item", "kinds"])

    return build


def _candidates(ordinary, sieve, n: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, bits = Lexicon(ordinary.value), sieve.value
        mask = np.uint64(len(bits) - 1)
        keep = lambda h: (bits[((h >> np.uint64(6)) & mask).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0
        for pdf in batches:
            ids_of = pdf["doc_id"].to_numpy(np.int64)
            out = []
            for rows, ids, doc in _batches(pdf, lex):
                out += [(ids_of[rows[d]], f, p, h, t, k) for d, f, p, h, t, k in windows(lex, ids, doc, n, keep)[0]]
            yield pd.DataFrame(out, columns=["doc_id", "family", "p", "hash", "doc", "doc_kinds"])

    return build


def _agree(hits: list[tuple[int, int, str, str, str]], n: int) -> tuple[int, int]:
    """Distinct template windows of the item that match, and of these, on the alignment where most agree, those whose slots
    agree: the same name, number or unit of the item is always the same of the document, and two names are never one."""
    diagonals: dict[int, dict[int, tuple[list[str], list[str], str]]] = {}
    for p, q, doc, item, kinds in hits:
        diagonals.setdefault(p - q, {})[q] = (doc.split(" "), item.split(" "), kinds)
    best = 0
    for found in diagonals.values():
        there: dict[tuple[str, str], str] = {}
        back: dict[str, str] = {}
        good = 0
        for q in sorted(found):
            doc, item, kinds = found[q]
            a, b, fine = dict(there), dict(back), True
            for k, x, y in zip(kinds, item, doc, strict=True):
                if k == "w":
                    fine = x == y
                else:
                    fine = a.setdefault((k, x), y) == y and (k != "p" or b.setdefault(y, x) == x)
                if not fine:
                    break
            if fine:
                there, back, good = a, b, good + 1
        best = max(best, good)
    return len({h[1] for h in hits}), best


def _pairs(n: int):
    """Mapper over hits sorted by document and item: one row a pair."""
    columns = ["doc_id", "item_id", "key", "times", "item_windows", "template_windows"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                yield from pdf[[*columns, "family", "p", "q", "doc", "item", "kinds"]].itertuples(index=False, name=None)

        out: list[tuple] = []
        for pair, group in groupby(rows(), key=lambda r: r[:6]):
            verbatim, hits = set(), []
            for r in group:
                if r[6] == 1:
                    verbatim.add(r[8])
                else:
                    hits.append(r[7:])
            templates, consistent = _agree(hits, n)
            doc, item, _, times, one, two = pair
            out += [(doc, item, len(verbatim), templates, consistent, one, two)] * times
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=_COLUMNS)

    return build


_COLUMNS = ["doc_id", "item_id", "verbatim", "templates", "consistent", "item_windows", "template_windows"]


def template_matches(docs: DataFrame, items: DataFrame, n: int = 12, ordinary_share: float = ORDINARY_SHARE) -> DataFrame:
    """doc_id, item_id, verbatim, templates, consistent, item_windows, template_windows for every pair of a document and an item
    that share a window, verbatim or as a template.

    verbatim counts the item's windows of n words that stand in a row in the document, whatever the case and punctuation, of
    item_windows that it has; templates its windows of n template tokens whose template stands in the document, of template_windows;
    consistent those of them whose slots agree along one alignment (a re-parameterised question has consistent > 0 without verbatim
    windows). Words are longest runs of letters and digits, lower case. Placeholders are typed: <number> (digits, with their
    points and commas), <unit> (a word of UNITS right after a number, or glued to it), <name> (a word that under
    ordinary_share of all documents and items use, or that stands in capitals within a sentence; neighbours are one name). A
    template window has at least LEAST_FIXED words of its own. Null or short texts and null ids match nothing; an empty side
    gives no rows. Items that share an id count as one per row.

    How often words are used is counted over all documents and items. Items' windows are hashed and become a table and a sieve of
    their bits (at most 32 MB). One pass over the documents hashes every window, word templates for verbatim leaks and full
    templates for the others; what passes the sieve is hash-joined with the items' windows, so any number of items takes one
    pass and no index of items is held anywhere. Hits, with their words, are then checked pair by pair."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.groupBy(F.col("item_id").cast("bigint").alias("item_id"), "text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.xxhash64("text"))
    common = ordinary_words(docs, items, ordinary_share).toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    ordinary = spark.sparkContext.broadcast(np.sort(common))
    schema = "item_id bigint, key bigint, times bigint, item_windows int, template_windows int, family int, q int, hash bigint, item string, kinds string"
    table = written(items.mapInPandas(_item_windows(ordinary, n), schema))
    count, size = table.count(), SIEVE_LEAST
    while size < SIEVE_MOST and size < count:
        size *= 2
    place, bit = F.shiftright("hash", 6).bitwiseAND(F.lit(size - 1)).cast("int"), F.expr("shiftleft(1L, cast(hash & 63L as int))")
    set_bits = table.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most `size` rows
    bits = np.zeros(size, np.uint64)
    bits[set_bits["place"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).view(np.uint64)
    sieve = spark.sparkContext.broadcast(bits)
    hits = docs.mapInPandas(_candidates(ordinary, sieve, n), "doc_id bigint, family int, p int, hash bigint, doc string, doc_kinds string")
    hits = hits.join(table, ["family", "hash"]).where(F.when(F.col("family") == 1, F.col("doc") == F.col("item")).otherwise(F.col("doc_kinds") == F.col("kinds")))
    keys = ["doc_id", "item_id", "key"]
    placed = hits.drop("hash", "doc_kinds").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(_pairs(n), "doc_id bigint, item_id bigint, verbatim int, templates int, consistent int, item_windows int, template_windows int")
