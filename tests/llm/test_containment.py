from __future__ import annotations

import random
import re

from tessera.llm.common import table
from tessera.llm.containment import find_items
from tessera.llm.op10_decontaminate import op10_decontaminate


def brute(docs, items, width=5):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for i, t in items:
        w = cut(t)
        k = min(width, len(w))
        own = grams(w, k) if w else set()
        for d, u in docs:
            n = len(own & grams(cut(u), k)) if own else 0
            if own and n * 10 >= len(own) * 8:
                out[d, i] = (len(own), n)
    return out


def pairs(df):
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in df.collect()}


def test_given_documents(spark, sample):
    docs, items = ([tuple(r) for r in table(spark, sample, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert pairs(op10_decontaminate(spark, sample)) == brute(docs, items)


def test_partial_short_and_shared_items(spark, words, documents):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(words[:80]) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 40, 70])))) for i in range(40)] + [(100, None), (101, "..."), (102, ""), (None, "no id"), (5, "zzz a second text under one id")]
    docs = []
    for d in range(120):
        w = [rng.choice(words[:80]) for _ in range(rng.randint(0, 400))]
        part = rng.choice(items[:40])[1].split()
        for k in range(rng.randint(0, 3)):  # some words of the passage are changed
            part[rng.randrange(len(part))] = "changed" + str(k)
        docs.append((d, " ".join([*w[:50], *part, *w[50:]]).upper() if d % 3 else ", ".join([*w, *part])))
    docs += [(2000 + i, items[7][1]) for i in range(80)]
    kept = {i: min(t for j, t in items if j == i and t is not None) for i, t in items if i is not None and t}
    df, it = documents(docs, edges=False), spark.createDataFrame(items, "item_id int, text string")
    expected = brute(docs, list(kept.items()))
    assert pairs(find_items(df, it)) == expected and len(expected) > 100
    assert pairs(find_items(df, it, broadcast_rows=0)) == expected


def test_edges(spark, documents):
    items = spark.createDataFrame([(1, "first text of this id"), (2, "nothing like it at all")], "item_id int, text string")
    assert set(pairs(find_items(documents(), items))) == {(906, 1)}
    assert find_items(documents(edges=False), items).count() == 0 and find_items(documents(), items.where("false")).count() == 0


def test_no_python_in_the_plan(spark, sample):
    plan = op10_decontaminate(spark, sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
