"""A pair counts once, however coarse the index of a block is, and the index opens few pairs."""

import os

import duckdb
import numpy as np
import pytest

from fleetfootprint.llm import catalog, sql, vectors

SF = "/root/testdata/sf0.01"


def planted(seed=8, length=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, length))
    return np.concatenate([b + rng.normal(size=(30, length)) * rng.uniform(0.2, 0.5, size=(30, 1)) for b in base]).astype("f4")


@pytest.mark.parametrize("turns, slices", [(0, 1), (0, 3), (3, 64)])
def test_pairs_beyond_a_share_count_once(spark, monkeypatch, turns, slices):
    monkeypatch.setattr(vectors, "TURNS", turns)
    monkeypatch.setattr(vectors, "SLICES", slices)
    x = planted()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    assert linked.any() and [got[i] for i in range(len(x))] == linked.sum(axis=1).tolist()


@pytest.mark.parametrize("same", [True, False])
def test_index_finds_every_pair_within_the_radius(same):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(500, 6)), rng.normal(size=(200, 6)) * 0.1, np.zeros((60, 6))])
    left = np.arange(len(points)) if same else np.arange(0, len(points), 2)
    right = left if same else np.arange(1, len(points), 2)
    found = [np.stack(p, axis=1) for p in vectors.block_pairs(points, 0.5, left, right)]
    pairs = {tuple(p) for p in np.concatenate(found).tolist()}
    assert len(pairs) == sum(map(len, found))
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= 0.25
    want = {(i, j) for i in left.tolist() for j in right.tolist() if near[i, j] and (i < j or not same)}
    assert want <= pairs and all(i < j for i, j in pairs) if same else want <= pairs


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_few_distances_are_evaluated(spark):
    """On the given vectors, summed over all blocks, less than a twentieth of all pairs."""
    x = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = vectors.Blocks(x, 2 - 2 * vectors.THRESHOLD)
    rows = np.arange(len(x))
    opened = 0
    for block in range(len(blocks.shares)):
        radius = float(np.sqrt(blocks.shares[block]))
        opened += sum(len(i) for i, _ in vectors.block_pairs(blocks.project(x, block), radius, rows, rows))
    share = opened / (len(x) * (len(x) - 1) / 2)
    print("evaluated", opened, "share", share)
    assert share < 0.05


def test_query_with_links_against_sql(spark, tmp_path):
    x = planted(5, 64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(40)] + [(2000, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({sql.ORACLE['op4_vector_neighbours']})").fetchall())
    got = sorted(tuple(r) for r in catalog.op4_vector_neighbours(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(r[1] for r in got) > 1000
