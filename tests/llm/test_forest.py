from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

from tessera.llm import forest
from tessera.llm.common import materialise, table
from tessera.llm.forest import components, near_duplicates, shingle_sets
from tessera.llm.op7_near_duplicates import op7_near_duplicates

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, width, num, den):
    """doc_id -> (set size, smallest linked doc_id), by comparing all pairs that share a shingle."""
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for group in by.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                shared[group[a], group[b]] += 1
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, docs, width, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute(docs, width, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_given_documents(spark, sample):
    docs = [tuple(r) for r in table(spark, sample, "documents").select("doc_id", "text").collect()]
    check(op7_near_duplicates(spark, sample), docs, 3, 85, 100)


def test_crowded_regions_and_chains(spark, words, documents):
    """Groups whose members differ from each other more than from the next one, and many that share a passage."""
    rng, docs = random.Random(3), []
    base = [rng.choice(words) for _ in range(120)]
    for g in range(40):  # a chain: each replaces more words of the first
        own = list(base)
        for k in range(g):
            own[k * 3] = rng.choice(words) + str(g)
        docs.append((1000 + g, " ".join(own)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    docs += [(2000 + i, shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(150)]
    body = [rng.choice(words) for _ in range(200)]
    for i in range(150):
        own = list(body)
        own[rng.randrange(200)] = f"w{i}"
        docs.append((3000 + i, " ".join(own)))
    docs += [(4000 + i, "Exact Copy of These words") for i in range(60)]
    rng.shuffle(docs)
    df = documents(docs, edges=False)
    check(near_duplicates(df, 3, 85, 100, crowd=12), docs, 3, 85, 100)
    check(near_duplicates(df), docs, 5, 80, 100)


def test_links_left_in_crowded_regions(spark, documents, monkeypatch):
    """One template; two texts just reach the threshold if they replace almost the same words, and no other two do.

    No forest is asked: what it leaves as crowded is compared whole, here in many blocks.
    """
    docs, rng = [], random.Random(8)

    def varied(name, places):
        out = [f"t{k}" for k in range(200)]
        for at in places:
            out[at : at + 2] = f"{name}x{at}", f"{name}y{at}"
        return " ".join(out)

    for i, places in enumerate(rng.sample(list(combinations(range(8, 190, 10), 3)), 150)):
        docs.append((i, varied(f"a{i}", places)))
        if i < 30:
            docs.append((1000 + i, varied(f"b{i}", [at + 1 for at in places])))
    want = brute(docs, 5, 80, 100)
    assert sum(c != i for i, (_, c) in want.items()) == 30
    monkeypatch.setattr(forest, "BLOCK", 40)
    texts = documents(docs, edges=False).select("doc_id", "text")
    sizes = materialise(texts.mapInArrow(forest._describe(5, 8), forest._DESCRIBED).selectExpr("doc_id AS node", "n_shingles AS size"), "sizes")
    rows = sizes.selectExpr("1L AS key", "node", "size").union(sizes.where("node < 1010").selectExpr("2L", "node", "size"))
    # Fifty texts are one component already, of more nodes than a block.
    comps = spark.createDataFrame([(i, 50) for i in range(50, 100)], "node long, component long")
    links, n = forest._exact(rows, comps, texts, 5, 80, 100)
    links = links.collect()
    assert n == len(links) == 30 and sorted(tuple(sorted((r.a, r.b))) for r in links) == sorted((c, i) for i, (_, c) in want.items() if c != i)


def test_blocks_give_what_joins_all_linked_components():
    """Chains and stars, whose ends are not linked with each other, in tiles smaller than they are."""
    import pyarrow as pa

    rng = random.Random(1)
    sets = []
    for i in range(300):
        body = set(range(i % 10 * 100, i % 10 * 100 + 80))
        sets.append((body - set(rng.sample(sorted(body), rng.randint(0, 12)))) | {10**6 + i * 50 + k for k in range(rng.randint(0, 12))})
    comp = [i if i % 7 else 0 for i in range(300)]

    def merged(links):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = find(comp[a]), find(comp[b])
            parent[max(a, b)] = min(a, b)
        return [find(c) for c in comp]

    for side in ([0] * 300, [i // 10 % 2 for i in range(300)]):
        rows = pa.table([pa.array(side), pa.array(range(300)), pa.array(comp), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["side", "node", "comp", "shingles"])
        got = forest._links_between(80, 100, 16)(rows)
        got = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        want = [(a, b) for a, b in combinations(range(300), 2) if (not any(side) or side[a] != side[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert 0 < len(got) < 300 < len(want) and set(got) <= set(want) and merged(got) == merged(want)


def test_edges(spark, documents):
    rows = near_duplicates(documents(), 3, 85, 100).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 12 and [r.component_id for r in by[900]] == [900] and by[900][0].n_shingles == 0 and by[902][0].kept
    assert all(r.component_id is None and r.kept for r in by[None]) and len(by[905]) == 2 and {r.component_id for r in by[905]} == {905} and by[905][0].n_shingles == 1
    assert {r.component_id for r in by[906]} == {906} and by[904][0].n_shingles > 300
    assert near_duplicates(documents(edges=False)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 501 + i) for i in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_shingles_fold_ascii_case_and_blanks_only():
    import pyarrow as pa

    a, b, c, d = shingle_sets(pa.array(["One two  three\tfour", " one TWO three four\n", "one two three É", "one two three é"]), 3)
    assert a.tolist() == b.tolist() and c.tolist() != d.tolist() and len(a) == 2


def test_one_id_of_several_sets(spark, documents):
    """A doc_id that stands for several texts is one document: what any of them is linked with belongs together."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = near_duplicates(documents([(5, a), (5, b), (9, a), (3, b), (7, b + " more"), (8, "something else")], edges=False)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(5, 3, False), (9, 3, False), (3, 3, True), (7, 3, False), (8, 8, True)} and len(rows) == 6


def test_trees_follow_the_threshold():
    assert (1 - 0.85**forest.DEPTH) ** forest.trees_for(85, 100, 1e-6) <= 1e-6 and forest.trees_for(80, 100, 1e-6) > forest.trees_for(85, 100, 1e-6)
