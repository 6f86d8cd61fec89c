"""Keys that hold most rows, ids that are null or repeat, and numbers near the ends of the double range."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import chat_format, embedding_join, packing, quality


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vectors_from_1e200_down_to_1e_200(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 6))
    rows, unit = [], []
    for i in range(120):
        v = base[rng.integers(0, 12)] + rng.normal(size=6) * 0.2
        unit.append(v / np.linalg.norm(v))
        rows.append((i, [float(x) for x in v * 10.0 ** rng.choice([-300, -200, -30, 0, 30, 200, 300])]))
    link = np.array(unit) @ np.array(unit).T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.near_vectors(_vectors(spark, rows), 0.9).collect()}
    assert got == {i: int(link[i].sum()) for i in range(120)} and link.any()
    ends = [(1, [1e200, 0.0]), (2, [1e200, 1.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 1e300])]
    assert [tuple(r)[1:3] for r in embedding_join.near_vectors(_vectors(spark, ends), 0.9).orderBy("vec_id").collect()] == [(5, 1)] * 6


def test_vectors_without_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (None, None), (7, [2.0, 0.0]), (9, [1.0, 0.02]), (8, [0.0, 0.0])]
    got = sorted((tuple(r) for r in embedding_join.near_vectors(_vectors(spark, rows), 0.9).collect()), key=repr)
    want = [(7, 3, 7, True), (8, 0, 8, True), (9, 3, 7, False), (None, 3, 7, False), (None, 3, 7, False), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=repr)


def test_clustered_vectors_are_not_replicated_everywhere(spark):
    """Far fewer replicas than cells times vectors, and the links of brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 48))
    v = np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 48)) * 0.1
    seen: dict = {}
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.near_vectors(_vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)]), 0.9, cell_rows=60, seen=seen).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    assert seen["pivots"] == 20 and seen["classes"] == 1200 and seen["replicas"] < 0.5 * 20 * 1200


def test_vectors_without_structure_travel_to_blocks(spark, monkeypatch):
    """All cells are in reach of all vectors here; what is shuffled is a vector times the blocks, not times cells and their parts."""
    monkeypatch.setattr(embedding_join, "HOME_BLOCK", 100)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1000, 64)).astype(np.float32).astype(float)
    v[500:520] = v[3] + rng.normal(size=(20, 64)) * 0.2  # not of single precision
    seen: dict = {}
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.near_vectors(_vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)]), 0.9, cell_rows=25, seen=seen).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist())) and sum(got.values()) > 20
    assert seen["pivots"] == 40 and seen["replicas"] > 20 * 1000 and seen["sent"] <= 20 * 1000


def test_one_labelled_id_in_most_rows(spark):
    """What the driver gets is a row an id."""
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma", "delta!", "42"]
    some = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30)) if i % 2 else "$$$ !!! ### " * 8) for i in range(60)], "doc_id long, text string")
    many = spark.range(100_000, numPartitions=8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("alpha beta Gamma").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(some.unionByName(many), labels)
    assert len(model.labels) == 60
    scores = {r["doc_id"]: r["score"] for r in quality.score(some, model).collect()}
    assert scores[3] > 0.5 > scores[2]


def test_one_first_turn_in_all_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "HOT", 50)
    rows = [(c, t, ["user", "assistant"][t % 2], "the same start" if t < 2 else f"turn {t} of {c % 40}") for c in range(400) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, paths = chat_format.build_tree(df)
    hot = chat_format.read_back(nodes, paths).select("conv_id", "n_turns", "turns_sha256", "loss_sha256", "formatted_chars").collect()
    starts = [r["text"] for r in nodes.where("depth < 2").collect()]
    assert len(starts) == 2 and nodes.count() == 2 + 2 * 40
    monkeypatch.setattr(chat_format, "HOT", 50_000)
    plain = chat_format.read_back(*chat_format.build_tree(df)).select("conv_id", "n_turns", "turns_sha256", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(tuple, hot)) == sorted(map(tuple, plain)) and len(hot) == 400


def test_a_million_pieces_are_planned_by_pattern():
    lengths = np.random.default_rng(1).integers(600, 1101, 200_000)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    first = packing.best_fit(histogram, 2048)
    done = packing.local_search(first, 2048)
    placed: dict = {}
    for pattern, bins in done.items():
        assert sum(pattern) <= 2048
        for n in pattern:
            placed[n] = placed.get(n, 0) + bins
    assert placed == histogram
    assert sum(done.values()) < 0.99 * sum(first.values())
