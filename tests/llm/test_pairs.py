"""Near duplicates, components and decontamination against brute force."""

import os
import random

import numpy as np
import pytest

from tidebar.llm import decontaminate, neardup, queries
from tidebar.llm.components import components

SF = "/root/testdata/sf0.01"


def shingles(text, k=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, copies, changes, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def families(spark):
    """Families around the threshold, a passage shared by many, ties, short and empty texts."""
    rng = random.Random(3)
    texts = [t for s in range(6) for t in family(s, 40, 9)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 40))) for _ in range(120)]
    texts += [None, "", "  \n", "one", "ONE", "one two", "one  two", "two one", "é é", *texts[:5], *[t.upper() for t in texts[5:8]]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert len({i for i, _ in rows}) == len(rows)
    return rows


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (2, 60)])
def test_near_duplicates(spark, families, k, percent):
    docs = spark.createDataFrame([(*r, 1, "x") for r in families], "doc_id long, text string, n int, set_key string")
    want = brute_components(families, k, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, k, percent).collect()}
    assert len(got) == len(want)
    for i, (n, c) in want.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_near_duplicates_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows, 2, 80)
    for r in queries.QUERIES["op5_near_duplicates"](spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_odd_documents(spark, odd_docs):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    got = neardup.near_duplicates(docs, 2, 80).collect()
    assert len(got) == docs.count()
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
    want = brute_components(list(rows), 2, 80)
    for r in got:
        assert r.doc_id is None and not r.kept or (r.n_shingles, r.component_id) == want[r.doc_id]
    assert queries.QUERIES["op5_near_duplicates"](spark, f"{odd_docs}/empty").collect() == []
    kept = neardup.drop_near_duplicates(docs, 2, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({i for i, (_, c) in want.items() if c == i})


def test_a_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with up to five changed words: most with four or five are linked with nothing."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 90)}" for _ in range(150)]
    rows = [(200, " ".join(base))]
    for i in range(300):
        w = list(base)
        for _ in range(i % 5 + 1):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i if i < 200 else i + 1, " ".join(w)))
    made, join = [], neardup.prefix_pairs

    def counted(*args):
        made.append(join(*args))
        return made[-1]

    monkeypatch.setattr(neardup, "prefix_pairs", counted)
    want = brute_components(rows, 5, 80)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 50
    assert made[0].count() < len(rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(2))
    assert (neardup.registers(np.union1d(a, b)) == neardup.merged(neardup.registers(a), neardup.registers(b))).all()
    for j in (0.0, 0.3, 0.8, 1.0):
        n = int(3000 * 2 * j / (1 + j))
        other = np.concatenate([a[:n], b[: 3000 - n]])
        got = neardup.likely_similarity(neardup.registers(a)[None], neardup.registers(other)[None], np.array([3000.0]), np.array([3000.0]))
        assert abs(got[0] - j) < 0.12


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    more = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    links = chain + star + more + [(5, 5), (5, 6), (6, 5)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- decontamination -------------------------------------------------------------------------

ITEMS = [
    (1, "Tom has 12 apples and gives Anna 5 of them before lunch. How many apples does Tom have left after 3 days?"),
    (2, "short one here"),
    (3, None),
    (4, "the train from Paris travels 300 km in 2 hours and then waits at the old station for the night"),
    (5, "six plain words only stand here"),
]
SAME = "Here we go. Tom has 12 apples and gives Anna 5 of them before lunch. How many apples does Tom have left after 3 days? End."
RENAMED = "Well. Lisa has 40 apples and gives Bob 7 of them before lunch. How many apples does Lisa have left after 9 days?"
MIXED = "Yes, Lisa has 40 apples and gives Lisa 5 of them before lunch. How many apples does Kurt have left after 5 days?"


def decontaminated(spark, rows, items=ITEMS):
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_reparameterised_questions(spark):
    rows = [(1, SAME), (2, RENAMED), (3, MIXED), (4, None), (5, ""), (6, "nothing of that kind is in this text at all, be sure"),
            (7, "we saw THE TRAIN from Rome travels 250 km in 4 hours and then waits at the old station for the night"),
            (8, SAME), (8, SAME), (9, "and six plain words only stand here too"), (None, SAME), (10, "short one here")]
    got = decontaminated(spark, rows)
    assert set(got) == {(1, 1), (2, 1), (7, 4), (8, 1), (9, 5), (None, 1)}
    assert got[1, 1].exact and got[1, 1].share > 0.9 and not got[2, 1].exact and got[2, 1].share > 0.9


def test_names_at_the_start_of_sentences_and_of_several_words(spark):
    items = [(1, "Tom has 5 green apples. Tom gives Mary 2."),
             (2, "How long does the train take when Tom rides from New York to the city of his old friend?"),
             (3, "Who was it that built and then at last opened the Eiffel Tower for the people?")]
    rows = [(1, "Anna has 7 green apples. Anna gives Paul 3."),
            (2, "How long does the train take when Mary Ann rides from Boston to the city of his old friend?"),
            (3, "Who was it that built\nand then at last opened the\nEiffel  Tower for\nthe people?"),
            (4, "Anna has 7 green apples. Kurt gives Paul 3."), (5, "so who was it that built and then at last opened the London Bridge for the people?")]
    got = decontaminated(spark, rows, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 3)}
    assert got[1, 1].share == got[2, 2].share == got[3, 3].share == 1 and got[3, 3].exact and not got[2, 2].exact


def test_items_rich_in_numbers_or_names(spark):
    items = [(1, "Compute 3 + 4 + 12 + 7 + 9 + 11 + 2 and give the total of the terms."), (2, "What is 17 x 23 - 5 x 11 + 96 / 4 ?"),
             (3, "Which of Paris, London, Berlin, Madrid, Rome, Oslo and Vienna is it?"),
             (4, "A farmer sells 5 cows and then buys 3 sheep at the big market in town")]
    rows = [(10 + i, f"Well now, {t} Indeed.") for i, t in items]
    rows += [(20, "a farmer sells 4 cows and then buys 4 sheep at the big market in town"), (21, "What is 18 x 24 - 6 x 12 + 97 / 8 ?"),
             (22, "Which of Bonn, Lima, Kyiv, Quito, Riga, Cairo and Dakar is it?")]
    got = decontaminated(spark, rows, items)
    assert set(got) == {(11, 1), (12, 2), (13, 3), (14, 4), (20, 4)}
    assert all(got[10 + i, i].exact and got[10 + i, i].share > 0.9 for i, _ in items[1:3]) and not got[20, 4].exact


def test_slots_in_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(SAME + " It weighs 5kg or 12.5 km, said Éva.\n New 1,000 min",)], "t string")
    words, values = df.select(decontaminate.template_words(F.col("t")), decontaminate.slots(F.col("t"))).first()
    holes = [w for w in words if w in (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)]
    assert len(holes) == len(values)
    kinds = {decontaminate.NUMBER: str.isdigit, decontaminate.NAME: str.isupper}
    for hole, value in zip(holes, values):
        assert kinds.get(hole, str.islower)(value[0]), (hole, value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_passages_of_the_benchmark(spark):
    import re

    norm = lambda t: re.findall(r"\w+", t.lower())
    docs = {r.doc_id: " ".join(norm(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: " ".join(norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_benchmark_leaks"](spark, SF).collect()}
    assert got >= want
    assert {d for d, _ in got} == {d for d, _ in want}


def test_empty_and_odd_tables(spark, odd_docs):
    assert decontaminated(spark, []) == {}
    assert decontaminated(spark, [(1, SAME)], [(9, "a b")]) == {}
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    assert decontaminate.contaminated(docs, bench).collect() == []
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()


def test_columns_named_like_the_operators_own(spark):
    docs = spark.createDataFrame([(1, SAME, 5, "x"), (2, "clean words stand here and nothing else at all", 6, "y")], "doc_id long, text string, bad_id int, bad_hash string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()] == [(2, "clean words stand here and nothing else at all", 6, "y")]
