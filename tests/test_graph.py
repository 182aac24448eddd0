import random

import pandas as pd
import pytest

from codelode.operators import graph as gr


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [(0, 0)], "source long, target long")


def brute_components(ids, pairs):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components_like_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.id: r.component for r in gr.components(spark.range(60), edges(spark, pairs)).collect()}
    assert got == brute_components(range(60), pairs)


def test_components_of_a_chain_and_of_nothing(spark):
    got = gr.components(spark.range(200), edges(spark, [(i, i + 1) for i in range(199)]))
    assert [r.component for r in got.select("component").distinct().collect()] == [0]
    assert gr.components(spark.range(3), edges(spark, [])).select("component").distinct().count() == 3


def test_cycles_once_each(spark):
    got = {tuple(r.path) for r in gr.cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)]), 4).collect()}
    assert got == {(1, 2), (1, 2, 3)}


def test_two_triangles_are_two_communities(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    df = spark.createDataFrame([(a, b, 0.72) for a, b in pairs], "a long, b long, weight double")
    m = {r.id: r.community for r in gr.communities(df).collect()}
    assert m[0] == m[1] == m[2] != m[3] and m[3] == m[4] == m[5]
    typed = spark.createDataFrame([(a, b, 0.72, "publishes" if (a, b) == (2, 3) else "uses") for a, b in pairs], "a long, b long, weight double, type string")
    links = gr.context_links(typed, gr.communities(df)).collect()
    assert [x.relationship for x in links] == ["published_language"]


def test_label_propagation_keeps_cliques_together(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    m = {r.id: r.community for r in gr.communities(df, rounds=8, small=1).collect()}
    assert len({m[i] for i in range(4)}) == 1 and len({m[i] for i in range(11, 15)}) == 1


def test_louvain_is_deterministic():
    pdf = pd.DataFrame({"a": [0, 1, 0, 3, 4, 3, 2], "b": [1, 2, 2, 4, 5, 5, 3], "weight": [1.0] * 7})
    assert gr.louvain(pdf).equals(gr.louvain(pdf))


def test_communities_are_the_same_at_every_size(spark):
    rng = random.Random(4)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(16), rng.randrange(16)) for _ in range(60)) if a != b and (a % 2 == b % 2 or rng.random() < 0.2)})
    df = spark.createDataFrame([(a, b, round(0.3 + 0.7 * rng.random(), 6)) for a, b in pairs], "a long, b long, weight double")
    small = {r.id: r.community for r in gr.communities(df).collect()}
    large = {r.id: r.community for r in gr.communities(df, small=1).collect()}
    assert small == large and 1 < len(set(small.values())) < 16


def test_communities_of_a_long_path_end_when_nothing_moves():
    """Modularity of a path of 300 is highest, at 0.889, with about 17 parts; a fixed number of passes stays far below."""
    n = 300
    pdf = pd.DataFrame({"a": range(n - 1), "b": range(1, n), "weight": [1.0] * (n - 1)})
    c = dict(zip(*gr.louvain(pdf).to_dict("list").values()))
    inside, size = 0, {}
    for a, b in zip(pdf.a, pdf.b):
        inside += c[a] == c[b]
        size[c[a]] = size.get(c[a], 0) + 1
        size[c[b]] = size.get(c[b], 0) + 1
    m = n - 1
    assert inside / m - sum(x * x for x in size.values()) / (4 * m * m) >= 0.85
