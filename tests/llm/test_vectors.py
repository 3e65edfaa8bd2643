import math

import numpy as np
import pytest

from shardkit.llm import embedding_lsh, hamming_index
from shardkit.llm.common import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, rep string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[40:90] = x[0]
    x[90:200] = x[1] + 0.12 * rng.standard_normal((110, 16)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2) if i >= 90 else 0, 1, "r") for i, v in enumerate(x)]
    rows += [
        (300, None, 0, 1, "r"), (301, [0.0] * 16, 0, 1, "r"), (302, [None] + [1.0] * 15, 0, 1, "r"), (303, [math.nan] + [1.0] * 15, 0, 1, "r"),
        (304, [math.inf] + [1.0] * 15, 0, 1, "r"), (305, [], 0, 1, "r"), (306, [1.0, 2.0], 0, 1, "r"), (307, x[0].tolist(), None, 1, "r"),
        (None, x[0].tolist(), 0, 1, "r"), (40, x[0].tolist(), 0, 1, "r"), (308, (2 * x[0]).tolist(), 0, 1, "r"),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def unit(v):
    v = np.array(v, dtype=np.float64)
    return v / np.sqrt((v * v).sum())


def usable(r, size=None):
    return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) and (size is None or len(r[1]) == size)


@pytest.mark.parametrize("block", [7, 2000])
def test_links_are_those_of_all_pairs(odd, block):
    rows, df = odd
    own = [r for r in rows if usable(r, 16) and r[2] is not None]
    u, labels = np.array([unit(r[1]) for r in own]), np.array([r[2] for r in own])
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = sorted((r[0], int(n)) for r, n in zip(own, near.sum(axis=1)))
    reach = np.arange(len(own))
    for _ in range(len(own)):
        new = np.array([min(reach[i], *reach[near[i]]) if near[i].any() else reach[i] for i in range(len(own))])
        if (new == reach).all():
            break
        reach = new
    got = embedding_lsh.link_vectors(df, block=block).collect()
    assert len(got) == len(rows)
    used = {r[0] for r in own}
    assert sorted((r.vec_id, r.n_links) for r in got if r.vec_id in used) == want
    component = {r[0]: own[i][0] for r, i in zip(own, reach)}
    for r in got:
        assert r.component_id == component.get(r.vec_id, r.vec_id) and r.kept == (r.vec_id == r.component_id)
        assert r.vec_id in used or r.n_links == 0


def test_repeated_ids_with_other_vectors_and_labels(spark):
    """An id that stands for two classes: links are those of each row, and no component goes over labels."""
    rng = np.random.default_rng(5)
    u, v, w = rng.standard_normal((3, 16))
    near = lambda x: (x + 0.02 * rng.standard_normal(16)).tolist()
    rows = [
        (1, near(v), 0), (1, near(u), 1), (2, near(v), 0), (3, near(u), 1), (4, near(w), 0), (4, near(w), 0), (5, near(u), 0),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_lsh.link_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 0, 5)]


@pytest.mark.parametrize("classes", [3, 1000, 100_000, 10_000_000])
def test_pairs_at_the_threshold_are_met(classes):
    """Whatever the size of a label, hardly a pair right at the threshold is missed, and chance meetings stay bounded."""
    tables, projections = embedding_lsh.parameters(classes)
    rng, n = np.random.default_rng(2), 3000
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    signs = [embedding_lsh._signatures(x, tables, projections, embedding_lsh.WIDTH) for x in (a, near)]
    missed = ~(signs[0] == signs[1]).any(axis=1)
    assert missed.sum() <= 3
    by_chance = (signs[0][:-1] == signs[0][1:]).mean()
    assert by_chance * classes < 3 * embedding_lsh.CHANCE or classes < embedding_lsh.CHANCE


def test_links_of_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    u, labels = np.array([unit(r.embedding) for r in rows]), np.array([r.label for r in rows])
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    got = {r.vec_id: r.n_links for r in embedding_lsh.link_vectors(table).collect()}
    assert got == {r.vec_id: int(n) - 1 for r, n in zip(rows, near.sum(axis=1))}


def test_neighbours_are_nearly_always_the_nearest(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    u = np.array([unit(r.embedding) for r in rows])
    found = {}
    for r in hamming_index.nearest(table).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, len(rows), 50):
        score = u @ u[q]
        score[q] = -2
        best = np.lexsort((np.arange(len(rows)), -score))[:5]
        own = found[rows[q].vec_id]
        assert len(own) == 5 and [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        for v, s in own:
            assert abs(s - score[v]) < 1e-12
        hits += len({v for v, _ in own} & {rows[b].vec_id for b in best})
        total += 5
    assert hits / total >= 0.95


@pytest.mark.parametrize("at_once", [3, 4096])
def test_each_length_has_its_own_candidates(spark, at_once):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16 if i % 3 else 8).tolist()) for i in range(400)] + [(1000, [1.0, 2.0, 3.0]), (1050, [0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    index, codes = hamming_index.build(df, 5, block=70)
    for r in hamming_index.search(index, codes, 5, 50, at_once).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    hits = 0
    for q, x in rows:
        if q % 50:
            continue
        u = unit(x)
        want = sorted(((-float(u @ unit(y)), v) for v, y in rows if v != q and len(y) == len(x)))[:5]
        own = got.get(q, [])
        assert len(own) == len(want)
        hits += len({v for v, _ in own} & {v for _, v in want}) - len(want)
    # recall over 8 queries of five each
    assert hits >= -2


def test_every_code_in_the_radius_is_retrieved():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    order = [np.argsort(codes[:, j], kind="stable").astype("<u4") for j in range(8)]
    offsets = [np.searchsorted(codes[o, j], np.arange(257)).astype("<u4") for j, o in enumerate(order)]
    block = hamming_index.Block({
        "n": 3000, "ids": np.arange(3000, dtype="<i8").tobytes(), "vectors": np.ones((3000, 2)).tobytes(), "codes": codes.tobytes(),
        "by_value": np.stack(order).tobytes(), "offsets": np.stack(offsets).tobytes(),
    })
    for radius in (0, 9, 20, 27, 64):
        apart = np.bitwise_count(codes ^ codes[5]).sum(axis=1)
        assert block.within(codes[5], radius).tolist() == np.nonzero(apart <= radius)[0].tolist()


def test_neighbours_of_odd_rows(spark, odd):
    rows, df = odd
    got = hamming_index.nearest(df, k=5, every=20).collect()
    asked = [r for r in rows if usable(r, 16) and r[0] % 20 == 0]
    assert len(got) == 5 * len(asked)  # id 40 is there twice
    zero = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert [v for _, v in zero] == [40, 40, 41, 42, 43]
    assert not {r.vec_id for r in got} & set(range(300, 307))
    few = hamming_index.nearest(df.where("vec_id in (0, 1, 2)"), k=5, every=50).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert hamming_index.nearest(df.where("vec_id in (0)")).count() == 0
    assert hamming_index.nearest(df.where("1 = 0")).count() == 0 and embedding_lsh.link_vectors(df.where("1 = 0")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 700)}}
