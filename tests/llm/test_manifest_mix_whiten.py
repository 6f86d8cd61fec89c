"""Merkle manifest, source mixing and whitening against plain loops and numpy, on odd input."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import merkle, mixing, whitening
from lexmill.llm.common import crc32_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, at int"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, low=False):
    text = r[1]
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def _reduce(nodes):
    """The root and, for each node, its siblings level by level with its place among them."""
    paths, place, cur = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(cur) > 1:
        for i, p in enumerate(place):
            run = cur[p - p % 8 : p - p % 8 + 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        cur = [h("".join(cur[a : a + 8])) for a in range(0, len(cur), 8)]
        place = [p // 8 for p in place]
    return cur[0], paths


def _manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[k] = _reduce([_leaf(r) for r in by[k]])
    root, tops = _reduce([trees[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops, strict=True):
        for r, path in zip(by[k], trees[k][1], strict=True):
            path = path + top
            own = _leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                own = h("".join(left) + own + "".join(right))
            proof = h("".join("".join(a + b) for a, b in path))
            out.append((r[0], _leaf(r), trees[k][0], root, proof, own, own == root))
    return sorted(out, key=repr)


def _verified(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], DOCS)
    made = merkle.manifest(docs, F.coalesce(crc32_mod("doc_id", 3) == 0, F.lit(False)), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    got = merkle.verify(made).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest_equals_plain_trees(spark):
    """Two superblock levels in one language, one node in others, nulls in every column, repeated and null ids."""
    rows = [(i, f"Text {i} é", "en", f"s{i % 3}", i) for i in range(1, 1300)]
    rows += [(2000, None, None, None, None), (2001, "", "", "", 0), (2002, "Ünï " * 30_000, "fr", "a", 5), (None, "No id", "en", "a", 5), (5, "Text 5 é", "en", "s2", 5), (5, "Other", "en", "s2", 5), (2003, "Z", "\U0001f600", "z", 1), (2004, "Z", "￿", "z", 1)]
    got = _verified(spark, rows)
    assert got == _manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "Abc", "en", "s", 3) for i in range(n)]
    assert _verified(spark, rows) == _manifest(rows) if n else _verified(spark, rows) == []


def test_manifest_does_not_hang_on_languages(spark):
    rows = [(i, "Abc", f"l{i}", "s", 3) for i in range(700)]
    assert _verified(spark, rows) == _manifest(rows)


def _fill(sizes, weights, share, most):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, free, left = {}, list(keys), share * sum(sizes.values())
    while free:
        each = left / sum(w[k] for k in free)
        over = [k for k in free if each * w[k] > most * sizes[k]]
        if not over:
            return target | {k: each * w[k] for k in free}
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
            free.remove(k)
    return target


def _mixed(spark, rows, parts=3):
    d = spark.createDataFrame([(*r, 1, "k", 2.5) for r in rows], "doc_id long, text string, source string, size int, key string, rate double").repartition(parts)
    return mixing.mix(d, [3, 1, 2], 1.5, 2).collect()


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(int(rng.pareto(1.1) * 20) + 1)), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", "s1"), (5002, "a\tb\nc\x0bd", None), (5002, "a\tb\nc\x0bd", None), (None, "one two", "s2"), (5004, "long " * 60_000, "s3"), (5005, " \n", "blank")]
    got = _mixed(spark, rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, _mixed(spark, rows, 7)), key=repr)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = _fill(sizes, [3, 1, 2], 1.5, 2)
    assert len(got) == len(rows)
    name = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        source = name[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, n in taken.items():  # s3 is one document of 60,000 words and a few short ones: no copies meet its target
        assert abs(n - want[source]) <= (30_000 if source == "s3" else 2 + 0.002 * want[source]), source
    assert taken["s3"] == 60_000 + 2 * (sizes["s3"] - 60_000)


def test_rates_are_the_exponential_tilt(spark):
    """One lambda a source: ln(rate) / size is the same for all documents under the bound."""
    rows = [(i, "w " * (i % 40 + 1), "ab"[i % 2]) for i in range(300)]
    by = {}
    for r in _mixed(spark, rows):
        if r["rate"] < 2:
            by.setdefault(r["source_size"], []).append(math.log(r["rate"]) / r["size"])
    assert by and all(max(v) - min(v) < 1e-12 for v in by.values())
    got = _mixed(spark, rows)
    for source in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == source]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-8)


def test_mix_of_nothing(spark):
    assert _mixed(spark, []) == []
    assert [(r["size"], r["target"], r["taken"]) for r in _mixed(spark, [(1, None, "a"), (2, "", None)])] == [(0, 0.0, 0)] * 2


def _white(spark, rows):
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<double>, id string, component int")
    return whitening.whiten(d, 8).collect()


def _brute(vectors):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:8]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True)) for row in x.tolist()]
    return dev, e[order], np.trace(v), c @ u[:, order] / np.sqrt(e[order])


@pytest.mark.parametrize("gap", [1.0, 0.2])
def test_whitening_equals_the_eigenvectors(spark, gap):
    """gap under 1: a falling spectrum, which power passes resolve; without one the whole space is needed."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 24)) * gap ** np.arange(24) * 4
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist()), (3, vectors[3].tolist())]
    odd = [(900, None), (901, []), (902, [None] + [0.0] * 23), (903, [math.nan] * 24), (904, [math.inf] + [0.0] * 23), (905, [1e30] * 24)]
    got = _white(spark, rows + odd)
    dev, e, trace, w = _brute([r[1] for r in rows])
    live = int((e > 1e-12 * trace).sum())
    assert len(got) == len(rows) * live
    sign = {}
    for r in got:
        i = r["vec_id"] if r["vec_id"] is not None else 0
        k = r["component"]
        assert r["n"] == len(rows) and r["deviation"] == dev[i]
        if k <= min(live, 4) or gap == 1.0:
            sign.setdefault(k, np.sign(r["whitened"] * w[i][k - 1]))
            assert r["whitened"] == pytest.approx(sign[k] * w[i][k - 1], abs=1e-6)
            assert r["explained"] == pytest.approx(e[k - 1] / trace, rel=1e-9)
        assert r["identity_error"] <= 1e-4


def test_range_finder_stops_early_on_a_gap(spark, monkeypatch):
    """With a gap behind the columns the covariance is never built."""
    seen = []
    inner = whitening.covariance_times
    monkeypatch.setattr(whitening, "covariance_times", lambda rows, d, n, total, q: seen.append(q.shape[1]) or inner(rows, d, n, total, q))
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 8)) @ rng.standard_normal((8, 40)) * 900 + 1e-3
    _white(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    assert max(seen) in (16, 40) and seen[0] == 16


def test_whitening_of_odd_tables(spark):
    assert _white(spark, []) == []
    assert _white(spark, [(1, [2.0, 3.0])] * 3) == []
    two = _white(spark, [(1, [0.0, 1.0]), (2, [4.0, 1.0]), (3, [7.0]), (4, [9.0])])
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]
    far = _white(spark, [(1, [2.0**41, 1.0]), (2, [-(2.0**41), 1.0]), (3, [0.0, 1.0])])
    assert {r["deviation"] for r in far} == {None, 0} and all(r["identity_error"] < 1e-9 for r in far)
