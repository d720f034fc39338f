"""Large groups of near copies in the Jaccard join: pairs leave a list once a member, and no link is lost."""

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import jaccard


def test_best_pairs_of_a_list_are_no_more_than_its_classes(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    rows = []
    for k in range(60):
        s = base.copy()
        s[rng.choice(400, 20, replace=False)] = rng.integers(0, 1 << 62, 20).astype(np.uint64)
        rows.append((k, 400, 0, bytearray(jaccard.sketch(np.sort(s)))))
    prefixes = spark.createDataFrame(rows, "class long, n int, more int, sketch binary")
    lists = prefixes.select(F.lit(7).cast("long").alias("token"), "class", F.col("class").alias("group"))
    every = {tuple(r)[:2] for r in jaccard._open_pairs(lists, prefixes).collect()}
    best = {tuple(r) for r in jaccard._open_pairs(lists, prefixes, best=True).collect()}
    assert len(every) == 60 * 59 // 2  # all are near
    assert 30 <= len(best) <= 60 and best <= every
    assert {c for pair in best for c in pair} == set(range(60))  # nobody is left out


def test_chained_copies_are_joined_as_brute_force_joins_them(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    text, texts = list(rng.choice(words, 120)), []
    for k in range(90):  # each one is near its neighbours, far ones are not
        text = list(text)
        text[int(rng.integers(0, 120))] = str(rng.choice(words))
        texts.append(" ".join(text))
    order = rng.permutation(90)
    docs = spark.createDataFrame([(int(i), texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    sets = {i: set(zip(*[texts[k].split()[n:] for n in range(5)], strict=False)) for i, k in enumerate(order)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: find(i) for i in sets}
