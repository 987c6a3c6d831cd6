import random
from itertools import combinations

import numpy as np
import pytest

from spanlake.llm import embedding_dedup as ed, near_dedup as nd
from spanlake.llm.components import components

EDGE = "a bigint, b bigint"


def plain_components(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, EDGE), "a", "b").collect()}
    fine = [(a, b) for a, b in links if a is not None and a != b]
    assert got == plain_components({x for l in fine for x in l}, fine)
    assert components(spark.createDataFrame([], EDGE), "a", "b").count() == 0


def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for d in range(25):
        out[d] = " ".join(rng.choices(vocabulary, k=rng.randint(30, 160)))
    base = rng.choices(vocabulary, k=220)
    for d in range(100, 160):  # a family around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out[d] = " ".join(copy)
    return [*out.items(), (200, out[3].upper()), (201, out[3]), (202, " ".join(out[4].split()[:-1])), (203, None), (204, ""), (205, " \n "), (206, "one two"), (207, "One TWO"),
            (208, "a b c d e"), (None, out[3]), (5, out[5]), (209, "É a b c d e"), (210, "é a b c d e"), (211, "x " * 30_000), (212, "x " * 30_000)]


def plain_near(docs):
    sets = {}
    for d, text in docs:
        w = [x.lower() for x in nd.words(text)]
        if d is not None:
            sets.setdefault(d, []).append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    return {d: len(s[0]) for d, s in sets.items()}, plain_components(list(sets), links)


@pytest.mark.parametrize("block", [500, 7])
def test_near_duplicates_as_all_pairs(spark, documents, block):
    docs = texts()
    sizes, groups = plain_near(docs)
    rows = nd.near_duplicates(documents(docs), nd.NearDedup(block=block)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None} == {d: (sizes[d], groups[d], d == groups[d]) for d in sizes}
    nameless, = [r for r in rows if r.doc_id is None]
    assert nameless.component_id is None and nameless.kept


def test_deduplicated_keeps_one_of_each_group(spark, documents):
    docs = texts()
    _, groups = plain_near(docs)
    got = nd.deduplicated(documents(docs).selectExpr("*", "1 as _gone", "2 as class")).select("doc_id", "_gone").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(groups.values()))
    assert sum(r.doc_id is None for r in got) == 1 and all(r._gone == 1 for r in got)
    assert nd.near_duplicates(documents([])).count() == 0


def test_posterior_bounds_fall_with_the_miss_probability():
    strict, lax = nd.least_matches(nd.NearDedup(miss=1e-2)), nd.least_matches(nd.NearDedup(miss=1e-9))
    assert all(a > b for a, b in zip(strict, lax)) and sorted(strict) == list(strict)


def vectors():
    rng = np.random.default_rng(3)
    out = []
    for c in range(8):
        center = rng.normal(size=24)
        out += [center + rng.normal(size=24) * 0.35 for _ in range(14)]
    out += [rng.normal(size=24) for _ in range(60)]
    out += [out[0].copy(), out[0].copy(), out[0] * 1e-30, out[1] * 1e30]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]
    return rows + [(900, None), (901, [0.0] * 24), (902, [1.0, None] + [0.0] * 22), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, []), (906, rows[0][1][:23]), (None, rows[0][1])]


def test_vector_links_as_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in ed.near_vectors(df).collect()}
    fine = {i: np.pad(np.array(v), (0, 24 - len(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in fine.items()}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    want = plain_components([r[0] for r in rows if r[0] is not None], links)
    count = {i: sum(i in l for l in links) for i in want}
    found = sum(r.n_links for i, r in got.items() if i is not None)
    assert len(got) == len(rows) and found >= 0.9 * sum(count.values()) > 100
    assert all(got[i].n_links <= count[i] for i in want) and {i: got[i].component_id for i in want} == want
    assert got[None].n_links == 0 and got[None].kept
    empty = ed.near_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("n", [2, 3])
def test_links_of_two_or_three_distinct_vectors(spark, n):
    distinct = [[1.0, 0.0, 0.0], [0.95, 0.3122499, 0.0], [0.0, 0.0, 1.0]][:n]
    rows = [(10 * i + k, v) for i, v in enumerate(distinct) for k in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    groups = plain_components(list(unit), links)
    assert got == {i: (sum(i in l for l in links), groups[i], i == groups[i]) for i in unit}
