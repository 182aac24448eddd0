import math

import numpy as np
import pytest

from codelode.llm import vamana as vm


def brute(rows, k=10):
    """Pairs of the k nearest by the table's definition."""
    seen = {}
    for i, t, e, v in rows:
        if i in seen or v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        seen[i] = ((t, e), np.asarray(np.float32(v), float))
    ids = sorted(seen)
    x = np.stack([seen[i][1] / np.linalg.norm(seen[i][1]) for i in ids])
    s = np.round(x @ x.T, 9)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if seen[ids[b]][0] != seen[i][0]), key=lambda b: (-s[a, b], ids[b]))
        out[i] = [ids[b] for b in order[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, entity_type string, entity_id long, embedding array<float>, node string")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    out = [(i, "function" if i % 2 else "class", i // 2, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=64)]) for i in range(1, 400)]
    same = out[0][3]
    out += [(1000 + i, "module", i, same) for i in range(40)] + [(2000 + i, "module", 7, same) for i in range(15)]
    out += [(3000, "file", 1, None), (3001, "file", 2, [0.0] * 64), (3002, "file", 3, [1.0] * 3), (3003, "file", 4, [float("nan")] + [1.0] * 63), (3004, None, None, [2 * x for x in same]), (3005, None, None, [-x for x in same])]
    return out + out[5:9]


def test_like_brute_force(spark, rows):
    got = {}
    for r in vm.nearest(frame(spark, rows)).collect():
        got.setdefault(r.id, []).append((-r.similarity, r.neighbour))
    want = brute(rows)
    assert set(got) == set(want)
    hits = sum(len({n for _, n in got[i]} & set(want[i])) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    # of copies the smallest ids of other entities
    assert [n for _, n in sorted(got[1005])] == want[1005] and [n for _, n in sorted(got[2003])] == want[2003]


def test_fewer_vectors_than_the_beam_is_exact(spark, rows):
    few = rows[:30]
    got = {(r.id, r.neighbour) for r in vm.nearest(frame(spark, few)).collect()}
    assert got == {(i, n) for i, ns in brute(few).items() for n in ns}


def test_several_shards_and_blocks(spark, rows):
    got = {(r.id, r.neighbour) for r in vm.nearest(frame(spark, rows), shard_rows=100, query_rows=64).collect()}
    want = {(i, n) for i, ns in brute(rows).items() for n in ns}
    assert len(got & want) / len(want) >= 0.97


def test_nothing_and_one_entity(spark):
    assert vm.nearest(frame(spark, [])).count() == 0
    assert vm.nearest(frame(spark, [(1, "a", 1, None)])).count() == 0
    assert vm.nearest(frame(spark, [(1, "a", 1, [1.0] * 64), (2, "a", 1, [2.0] * 64)])).count() == 0


@pytest.mark.parametrize("shard_rows", [100, 32768])
def test_an_entity_larger_than_the_beam(spark, rows, shard_rows):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    big = [(5000 + i, "file", 77, [float(x) for x in centre + 0.01 * rng.normal(size=64)]) for i in range(200)]
    # copies of one of its vectors in another entity, and a row of its own that is a copy of others'
    big += [(5300, "file", 78, big[0][3]), (5301, "file", 79, big[0][3]), (5302, "file", 77, rows[0][3])]
    got = {}
    for r in vm.nearest(frame(spark, rows + big), shard_rows=shard_rows).collect():
        got.setdefault(r.id, []).append((-r.similarity, r.neighbour))
    want = brute(rows + big)
    own = [i for i, _, e, _ in big if e == 77]
    assert {i: [n for _, n in sorted(got.get(i, []))] for i in own} == {i: want[i] for i in own}
    hits = sum(len({n for _, n in got.get(i, [])} & set(want[i])) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.97


def test_graph_is_searchable():
    rng = np.random.default_rng(1)
    x = vm._unit(rng.normal(size=(3000, 64)) @ np.diag(np.linspace(2, 0.05, 64)))
    g = vm.build_graph(x)
    assert g.shape == (3000, 32) and (g < 3000).all() and not (g == np.arange(3000)[:, None]).any()
    ids, sims = vm.beam_search(x, g, vm.entry_points(3000), x[:200], 48)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_work_grows_with_the_rows_not_with_rows_times_shards(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    for n in (800, 1600, 3200):
        some = [(i, "f", i, [float(x) for x in centres[i % 40] + 0.5 * rng.normal(size=64)]) for i in range(n)]
        got = {(r.id, r.neighbour) for r in vm.nearest(frame(spark, some), shard_rows=64, fan=6).collect()}
        want = {(i, m) for i, ns in brute(some).items() for m in ns}
        assert len(got & want) / len(want) >= 0.95 and len(got) == 10 * n


def test_one_entity_with_most_rows_finds_others(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    big = [(i, "file", 1, [float(x) for x in centre + 0.05 * rng.normal(size=64)]) for i in range(300)]
    rest = [(1000 + i, "class", i, [float(x) for x in rng.normal(size=64)]) for i in range(50)]
    for shard_rows in (40, 32768):
        got = {}
        for r in vm.nearest(frame(spark, big + rest), shard_rows=shard_rows).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        assert len(got) == 350 and all(len(v) == 10 for v in got.values())
        assert all(min(got[i]) >= 1000 for i, *_ in big)
