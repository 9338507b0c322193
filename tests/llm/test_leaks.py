"""Leaked items against brute force; re-parameterised items by their slots."""

import random

import pytest

from tempestry.llm import leaks


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, s in items:
            v = leaks.words(s)
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = ["the", "a", "of", "which", "keeps", "from", "once", "has", "been", "valve", "5", "42", "mm", "rpm", "Straße", "naïve", "x1"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "  ", "-", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.randint(5, 30))) for i in range(12)]
    docs = []
    for d in range(30):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split(" ")
            a = rng.randint(0, 3)
            t += " " + (" ".join(w[a : a + rng.randint(8, 30)])).upper()
        docs.append((d, t))
    return [*docs, (100, None), (101, "")], [*items, (50, None), (51, "short"), (3, items[0][1])]


@pytest.mark.parametrize("seed", range(4))
def test_brute(spark, seed):
    docs, items = make(seed)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    k = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.template_matches(d, k).where("verbatim > 0").collect()}
    assert got == brute([x for x in docs if x[1]], [x for x in items if x[1]])


def test_parameters_changed(spark):
    items = [(i, f"which {n} valve of the {m} turbine keeps the coolant at {t} degrees from the {n} valve when it is open") for i, (n, m, t) in enumerate([("alma", "brin", 5), ("corv", "dask", 6), ("ekto", "fumo", 7), ("gira", "hask", 8)])]
    docs = [
        (1, "so which zorl valve of the quib turbine keeps the coolant at 99 degrees from the zorl valve when it is open"),
        (2, "so which zorl valve of the quib turbine keeps the coolant at 99 degrees from the pock valve when it is open"),
        (3, items[2][1]),
        (4, "nothing of the kind"),
    ]
    got = {}
    for r in leaks.template_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ordinary_share=0.3).collect():
        got[r["doc_id"], r["item_id"]] = r
    assert got[1, 0]["verbatim"] == 0 and got[1, 0]["consistent"] == got[1, 0]["template_windows"]
    assert got[2, 0]["consistent"] < got[2, 0]["template_windows"]
    assert got[3, 2]["verbatim"] == got[3, 2]["item_windows"] > 0
    assert not any(d == 4 for d, _ in got)


@pytest.mark.parametrize("words", [1 << 4, 1 << 18])
def test_sieve_size_changes_nothing(spark, rows, monkeypatch, words):
    """However many items share the sieve, every column is the same; an id may have many rows, and equal rows count each."""
    frame = "the pump at {} lifts {} litres for the owner of the old mill in {}"
    items = [(1, frame.format("Aro", 5, "Bex")), (2, frame.format("Cil", 6, "Dov")), (3, frame.format("Eda", 7, "Fum"))]
    items += [(4, "a b c d e f g h i j k " + w) for w in ("l", "m", "n", "o")] + [(4, "a b c d e f g h i j k l")]
    docs = [(10, "so " + frame.format("Gil", "8.5", "Hux") + " it says"), (11, items[0][1]), (12, "a b c d e f g h i j k o"), (13, items[2][1].replace("Fum", "owner"))]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leaks, "SIEVE_LEAST", words)
    monkeypatch.setattr(leaks, "SIEVE_MOST", words)
    got = rows(leaks.template_matches(d, i))
    assert {(r[0], r[1]): (r[2] > 0, r[4]) for r in got if r[0] != 13} == {(10, 1): (False, 5), (10, 2): (False, 5), (10, 3): (False, 5), (11, 1): (True, 5), (11, 2): (False, 5), (11, 3): (False, 5), (12, 4): (True, 1)}
    assert sum(r[:2] == (12, 4) for r in got) == 1
    twice = rows(leaks.template_matches(d, i.unionByName(i)))
    assert twice == sorted(got * 2)


def test_unrelated_texts(spark):
    """Words that an item doesn't know fill no window; units only follow numbers; articles are none."""
    items = [(1, "adhesive amplifier anchor baffle bearing blade bracket buffer burner cable carriage casing"), (2, "a second valve is set in a third pipe in a fourth tank in a mill")]
    docs = [
        (1, "Ein Gehäuse nach Anspruch eins wobei der Deckel durch eine Feder gegen den Rahmen gedrückt wird und bleibt"),
        (2, "dispositivo según la reivindicación primera donde el muelle empuja la tapa contra el bastidor inferior del aparato"),
        (3, "a first valve is set in a fifth pipe in a sixth tank in a mill"),
        (4, " ".join(str(n) for n in range(40))),
    ]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leaks.template_matches(d, i).count() == 0
    assert leaks.template_matches(d, i, ordinary_share=0.9).count() == 0  # nearly all words are names: no window has words of its own


def test_numbers_and_units(spark):
    """A number is one whatever its points and commas, a unit may be glued to it, and slots must agree."""
    item = "the old valve at Kelm opens at 3.5 mm and closes again at 3.5 mm when the pump is off"
    docs = [
        (1, "the old valve at Zorn opens at 1,200 inch and closes again at 1,200 inch when the pump is off"),
        (2, "the old valve at Zorn opens at 7kg and closes again at 7kg when the pump is off"),
        (3, "the old valve at Zorn opens at 7 kg and closes again at 8 kg when the pump is off"),
        (4, "the old valve at New Zorn opens at 7 kg and closes again at 7 kg when the pump is off"),
    ]
    got = {r["doc_id"]: r for r in leaks.template_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    n = got[1]["template_windows"]
    assert n == len(item.split()) - 11
    assert [(got[d]["templates"], got[d]["verbatim"]) for d in (1, 2, 3, 4)] == [(n, 0)] * 4
    assert [got[d]["consistent"] for d in (1, 2, 4)] == [n] * 3 and got[3]["consistent"] < n


def plant(documents, items, share, seed=3):
    """(documents, pairs): every third document gets a copy of an item with other names and numbers; the items' rare words
    are their names."""
    rng = random.Random(seed)
    use = {}
    for t in [t for _, t in documents] + [t for _, t in items]:
        for w in set(leaks.words(t)):
            use[w] = use.get(w, 0) + 1
    least = share * (len(documents) + len(items))
    pairs, out = set(), []
    for k, (d, t) in enumerate(documents):
        if k % 3 == 0:
            i, s = items[(k // 3) % len(items)]
            new = {w: str(rng.randint(2, 900)) if w.isdigit() else "".join(rng.choices("bcdfgklmnprst", k=9)) for w in set(leaks.words(s)) if w.isdigit() or use[w] < least}
            s = leaks.WORD.sub(lambda m: new.get(m.group().lower(), m.group()), s)  # noqa: B023
            cut = t.find(" ", len(t) // 2)
            t, pairs = t[:cut] + "\n" + s + "\n" + t[cut:], pairs | {(d, i)}
        out.append((d, t))
    return out, pairs


def quality(spark, folder, share):
    """(recall of planted pairs, share of documents reported as re-parameterised that are planted)"""
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 100").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/eval_items.parquet").orderBy("item_id").collect()]
    known = {(r["doc_id"]) for r in leaks.template_matches(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), ordinary_share=share).collect()}
    planted, pairs = plant([x for x in documents if x[0] not in known], items, share)
    got = leaks.template_matches(spark.createDataFrame(planted, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), ordinary_share=share).where("consistent > 0").collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    reported = {d for d, _ in found}
    return len(pairs & found) / len(pairs), len(reported & {d for d, _ in pairs}) / max(1, len(reported)), len(pairs)


def test_planted_parameters(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test data here")
    recall, precision, n = quality(spark, folder, 0.02)
    assert n > 200 and recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 400_000 + "one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string")
    assert leaks.template_matches(docs, none).count() == 0
    item = spark.createDataFrame([(1, "One, two; THREE four five six seven eight nine ten eleven twelve.")], "item_id long, text string")
    assert [r["verbatim"] for r in leaks.template_matches(docs, item).collect()] == [1]
    assert leaks.template_matches(docs.limit(0), item).count() == 0


def test_slices_change_nothing(spark, rows, monkeypatch):
    docs, items = make(11)
    d, k = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = rows(leaks.template_matches(d, k))
    monkeypatch.setattr(leaks, "SLICE", 40)
    monkeypatch.setattr(leaks, "OVERLAP", 64)
    assert rows(leaks.template_matches(d, k).select("doc_id", "item_id", "verbatim", "templates")) == [r[:4] for r in want]
