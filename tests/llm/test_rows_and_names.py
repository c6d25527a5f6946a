"""Repeated keys with different texts, clashing names and many sources, against brute force."""

import random
from collections import Counter as Bag

import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, brute_targets

from rondo.llm import common, mixing, neardup

WORDS = [f"w{i}" for i in range(120)]
A, B = (" ".join(p + w for w in WORDS) for p in "ab")
NEAR_A, NEAR_B = A.replace("aw60", "other"), B.replace("bw60", "other")


def brute_documents(rows, words=4):
    """Components of doc_ids: rows of one doc_id belong together, and rows linked by their sets."""
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    sets = brute_components(list(enumerate(t for _, t in rows)), words)
    for i, (k, _) in enumerate(rows):
        for other in (("row", sets[i][1]),):
            a, b = root(("row", i)), root(other)
            label[a] = b
        if k is not None and sets[i][0]:
            a, b = root(("row", i)), root(("doc", k))
            label[a] = b
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i][0]:
            r = root(("row", i))
            least[r] = min(k, least.get(r, k))
    return Bag((k, sets[i][0], (least[root(("row", i))] if sets[i][0] else k) if k is not None else None) for i, (k, _) in enumerate(rows))


CASES = {
    "two texts": [(1, A), (1, B), (2, NEAR_A), (3, NEAR_B)],
    "chain": [(5, A), (4, NEAR_A), (4, B), (3, NEAR_B), (3, "c d e f g"), (2, "C D E F G"), (9, "x")],
    "empty beside": [(1, A), (1, None), (1, ""), (2, NEAR_A), (7, None), (7, B)],
    "same set": [(8, "p q r s t"), (8, "P q r s t"), (8, "p q r s t"), (9, "p  q r S t")],
    "largest ids": [((1 << 63) - 1, A), ((1 << 63) - 1, B), (5, NEAR_A), (6, NEAR_B)],
    "no ids": [(None, A), (None, B), (3, A)],
}


def together(names):
    """The rows of several cases, each with doc_ids and words of its own."""
    out = []
    for n, name in enumerate(names):
        out += [(None if k is None else k + 1000 * n, t and " ".join(w and (f"c{n}{w}" if w.islower() else f"C{n}{w}") for w in t.split(" "))) for k, t in CASES[name]]
    return out


@pytest.mark.parametrize("names", [["largest ids"], [n for n in CASES if n != "largest ids"]])
@pytest.mark.parametrize("turned", [False, True])
def test_documents_of_several_texts(spark, names, turned):
    rows = together(names)[::-1] if turned else together(names)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(d).collect()
    assert Bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_documents(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_random_documents_of_several_texts(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 6))):
                w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = [(rng.randrange(40), t) for t in texts]
    for r in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(r, "doc_id long, text string")).collect()
        assert Bag((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_documents(r)


@pytest.mark.parametrize("words, turned", [(4, False), (5, True)])
def test_deduplicate(spark, words, turned):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1, A), (5, NEAR_A), (5, B), (5, B), (9, B), (9, "something else that nothing is like"), (None, A), (None, A), (11, None), (12, ""), (12, ""), (13, "P q r s t u"), (13, "p q r s t u")]
    for i in range(20):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i % 15, " ".join(w)))
    rows = rows[::-1] if turned else rows
    extra = [(k, t, k, t, 7) for k, t in rows]
    d = spark.createDataFrame(extra, "doc_id long, text string, digest long, doc_id_ string, other int")
    got = neardup.deduplicate(d, words=words)
    assert got.columns == d.columns
    kept = got.collect()
    assert all(r["digest"] == r["doc_id"] and r["doc_id_"] == r["text"] and r["other"] == 7 for r in kept)
    # By brute force: each distinct (doc_id, text) is a document, and of each group one of the smallest doc_id stays.
    distinct = sorted({(k, t) for k, t in rows if k is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = brute_components([(i, t) for i, (_, t) in enumerate(distinct)], words)
    group = {}
    for i, x in enumerate(distinct):
        group.setdefault((sets[i][1],) if sets[i][0] else ("alone", x), []).append(x)
    found = Bag((r["doc_id"], r["text"]) for r in kept)
    assert found[(None, A)] == 2 and len(kept) == len(group) + 2
    for members in group.values():
        stay = [x for x in members if x in found]
        assert len(stay) == 1 and found[stay[0]] == 1 and stay[0][0] == min(k for k, _ in members)


def test_mix_with_clashing_names(spark):
    rows = [(i, "a b c " * (i % 7), f"s{i % 4}", "mine", 5, 6, 7, 8) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, __source string, at int, whole int, cut int, copies int")
    got = mixing.with_copies(d, mixing.source_cuts(d), copies="taken_")
    assert got.columns == [*d.columns, "taken_"] and got.filter("__source = 'mine' and at = 5 and copies = 8").count() == 60


def test_rows_without_a_key_are_told_apart_by_their_text(spark):
    rows = [(None, f"{i} b c", "s") for i in range(400)] + [(i, "a b c", "t") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(d).collect()
    taken = sum(r["taken"] for r in got if r["source"] == "s")
    target = next(r["target"] for r in got if r["source"] == "s")
    assert abs(taken - target) <= 3 and len({r["copies"] for r in got if r["source"] == "s"}) == 2


def test_many_sources_go_by_range(spark, monkeypatch):
    rng = random.Random(4)
    sizes = {f"host{i}.example": rng.choice((0, 1, 3, 10, 200)) for i in range(300)} | {None: 40, "": 9}
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    few = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    many = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    want = brute_targets(sizes)
    assert few == pytest.approx(many) and {s: many[s] for s in want} == pytest.approx(want)


def test_fresh_names(spark):
    d = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert common.fresh(d, "a", "a", "b") == ["a__", "a___", "b"]
    assert d.withColumn(common.fresh(d, "A")[0], F.lit(1)).count() == 1


def test_workers_forget_what_other_operators_kept():
    from rondo.llm import bpe_words, langid, wordhash
    from rondo.llm.queries import public_tokenizer

    kept = lambda: {k for k, (n, _) in common._kept.items() if n()}
    bpe_words.encoder(public_tokenizer("byte_bpe_50k.json"))
    wordhash.word_hashes(b"a b")
    langid.tables()
    assert {"bpe_words", "wordhash", "langid"} <= kept()
    common.forget_others("rondo.llm.token_output")
    assert kept() == {"bpe_words"}
    wordhash.word_hashes(b"a b")
    common.forget_others("rondo.llm.neardup")
    assert kept() == {"wordhash"} and len(wordhash.word_hashes(b"c d e")) == 3
