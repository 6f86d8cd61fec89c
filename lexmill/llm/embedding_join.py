"""Embedding near-duplicates by an exact metric range join.

Angles between vectors are a metric, and cosine >= c means an angle of at most r = arccos(c). Pivots
(a bounded, hashed choice of vectors) partition the vectors: each goes home to its nearest pivot.
By the triangle inequality, a vector x can have a neighbour at home in cell j only if

    angle(x, p_j) <= radius_j + r        (radius_j: the widest home vector of the cell) and
    angle(x, p_j) <= angle(x, p_home) + 2 r,

so x has to meet the home vectors of just these cells. Cells are put together to blocks of bounded size (a hot cell is
split over several), alike cells side by side, and x travels once to every pair of its own block and one that holds such a cell, not to
every cell: what is shuffled is a vector times the blocks in reach, about BLOCKS of them until the tables are BLOCKS times the largest block.
A pair of blocks is looked at once, for both sides, cell by cell with the same two bounds. Equal vectors are collapsed first, so copies are
counted, not compared. A pair of blocks returns link counts and a spanning forest of what it found, never its pairs.

Vectors of each length have pivots, and so cells, of their own: one for each cell_rows vectors, as long as those that all tasks
get take PIVOT_BYTES. Beyond that cells grow: the result is the same. Angles to pivots are worked out
twice, once for the home cells and their radii and once for the cells in reach, and never stored.

Semantics: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and
form components of their own, and so do vectors of different lengths with each other. All other doubles count, from the least to the
greatest: vectors are scaled by a power of two before they are measured. Repeated rows count as vectors of their own. Rows without an id link
like others; their component is the least id reachable, null if there is none, and they are never kept. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, map_batches, mix
from .components import components

#: Rows of a block at least (a smaller table is one block) and at most, its bytes at most, and the blocks that a table is cut to in between.
HOME_BLOCK, FAR_BLOCK, BLOCK_BYTES, BLOCKS = 2048, 1 << 16, 1 << 25, 10
#: What the pivots of one length of vectors may take in every task.
PIVOT_BYTES = 1 << 24


def _unit(blobs: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component below 1, where squares neither over- nor underflow."""
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def _short(blob: bytes) -> bytes:
    """The vector in single precision, if that holds it."""
    v = np.frombuffer(blob, np.float64)
    w = v.astype(np.float32)
    return w.tobytes() if (w == v).all() else blob


def _long(blob: bytes, size: int) -> bytes:
    return blob if len(blob) == size else np.frombuffer(blob, np.float32).astype(np.float64).tobytes()


def _angles(blobs: list[bytes], pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(blobs) @ pivots.T, -1, 1))


def prepare(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, sig, v): usable vectors, scaled, as bytes and the digest of what they were; null for the others."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, blob = [], []
        for x in batch.column(1):
            v = None
            if x.is_valid and len(x) and not x.values.null_count:
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not (np.isfinite(v).all() and v.any()):
                    v = None
            sig.append(None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest())
            blob.append(None if v is None else scaled(v).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), pa.array(blob, pa.binary())], names=["id", "sig", "v"])

    src = vectors.select(vectors[key].cast("long").alias("id"), vectors[column].cast("array<double>").alias("e"))
    return map_batches(src, run, "id long, sig binary, v binary")


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of all pairs of unit vectors that reach the threshold, in runs. Single precision, with a margin over its error, says what
    double precision has to decide."""
    small_a, small_b = a.astype(np.float32), b.astype(np.float32)
    margin = 2e-7 * (a.shape[1] + 8)
    step = max(1, (1 << 22) // len(b))
    for s in range(0, len(a), step):
        near = small_a[s : s + step] @ small_b.T >= threshold - margin
        many = np.count_nonzero(near)
        if not many:
            continue
        if 16 * many > near.size:
            row, col = np.nonzero(a[s : s + step] @ b.T >= threshold)
            row += s
        else:
            row, col = np.nonzero(near)
            row += s
            cut = max(1, (1 << 20) // a.shape[1])
            sure = [np.einsum("ij,ij->i", a[row[i : i + cut]], b[col[i : i + cut]]) >= threshold for i in range(0, len(row), cut)]
            row, col = row[np.concatenate(sure)], col[np.concatenate(sure)]
        yield row, col


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The roots of a forest of depth one after x[i] and y[i] have met."""
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _join(threshold: float, r: float, pivots: dict[int, np.ndarray], first: dict[int, int], radius: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        home, least = group.column("home").to_numpy(), group.column("angle").to_numpy()
        own = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        size = group.column("length")[0].as_py()
        v = _unit([_long(b, size) for b in group.column("v").to_pylist()])
        low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if own else side == 1)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for cell in np.unique(home[high]).tolist():
            there = high[home[high] == cell]
            angle = np.arccos(np.clip(v[low] @ pivots[size][cell - first[size]], -1, 1)) if len(low) else np.zeros(0)
            here = low[(angle <= radius[cell] + r) & (angle <= least[low] + 2 * r)]
            if not len(here):
                continue
            for row, col in _linked(v[here], v[there], threshold):
                row, col = here[row], there[col]
                if own:
                    other = row != col
                    row, col = row[other], col[other]
                np.add.at(links, row, n[col])
                if not own:
                    np.add.at(links, col, n[row])
                root = _united(root, row, col)
        some = np.flatnonzero(links)
        return pa.table({"u": pa.array(ids[some]), "v": pa.array(ids[root[some]]), "links": pa.array(links[some])})

    return run


def _blocks(sizes: list[tuple[int, int]], pivots: dict[int, np.ndarray], first: dict[int, int], cells: dict[int, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell, and over how many blocks it is dealt: cells of one length share a block, neighbours on the
    line along which their pivots differ most side by side."""
    at, parts, block = np.zeros(sum(len(p) for p in pivots.values()), np.int64), np.ones(sum(len(p) for p in pivots.values()), np.int64), -1
    for n, total in sizes:
        most = max(1, min(FAR_BLOCK, BLOCK_BYTES // n, max(HOME_BLOCK, -(-total // BLOCKS))))
        centred = pivots[n] - pivots[n].mean(0)
        held = most  # so that each length begins a block
        for j in np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable").tolist():
            j += first[n]
            rows = cells.get(j, (0, 0.0))[0]
            if held + rows > most:
                block, held = block + 1, 0
            at[j], parts[j] = block, max(1, -(-rows // most))
            block, held = block + int(parts[j]) - 1, held + rows if parts[j] == 1 else most
    return at, parts


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding", cell_rows: int = 4096, seen: dict | None = None) -> DataFrame:
    """key, n_links, component_id, kept for every row of vectors. seen: gets the numbers of pivots, of classes of equal vectors, of
    the cells in their reach and of the rows that are shuffled."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    r = math.acos(threshold) + 1e-9
    rows = scratch.save(prepare(vectors, key, column))
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))
    sizes = sorted((r["n"], r["count"]) for r in classes.groupBy(F.length("v").alias("n")).count().collect())  # one row a length of vectors
    pivots, first, count = {}, {}, 0
    for n, total in sizes:
        some = classes.where(F.length("v") == n).orderBy(F.xxhash64("sig"), "sig").limit(max(1, min(total // cell_rows, PIVOT_BYTES // n)))
        pivots[n], first[n] = _unit([x["v"] for x in some.collect()]), count
        count += len(pivots[n])

    def alike(batch: pa.RecordBatch):
        """(rows, first pivot, angles) of runs of rows of one length, as many as 2**22 angles allow."""
        blobs = batch.column(2).to_pylist()
        length = np.array([len(v) for v in blobs])
        for n in np.unique(length).tolist():
            who = np.flatnonzero(length == n)
            step = max(1, (1 << 22) // len(pivots[n]))
            for a in range(0, len(who), step):
                yield who[a : a + step], first[n], _angles([blobs[i] for i in who[a : a + step]], pivots[n])

    def homes(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, least = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        for who, at, angle in alike(batch):
            home[who], least[who] = at + angle.argmin(1), angle.min(1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(least)], names=["node", "n", "v", "home", "angle"])

    placed = scratch.save(map_batches(classes.select("node", "n", "v"), homes, "node long, n long, v binary, home int, angle double"))
    cells = {x["home"]: (x["m"], x["w"]) for x in placed.groupBy("home").agg(F.count("*").alias("m"), F.max("angle").alias("w")).collect()}  # one row a pivot
    radius = np.array([cells.get(j, (0, -9.0))[1] for j in range(count)])

    at, parts = _blocks(sizes, pivots, first, cells)

    def reached(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, least = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        block = at[home] + (mix(batch.column(0).to_numpy().astype(np.uint64)) % parts[home].astype(np.uint64)).astype(np.int64)
        found, cells_near, blobs = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32), batch.column(2).to_pylist()
        lengths = [len(v) for v in blobs]
        for who, begin, angle in alike(batch):
            near = (angle <= radius[begin : begin + angle.shape[1]] + r) & (angle <= least[who, None] + 2 * r)
            cells_near[who] = near.sum(1)
            for i, x in zip(who.tolist(), near, strict=True):
                j = begin + np.flatnonzero(x)
                blobs[i] = _short(blobs[i])
                found[i] = np.unique(np.repeat(at[j] - np.cumsum(parts[j]) + parts[j], parts[j]) + np.arange(parts[j].sum())).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blobs, pa.binary()), *batch.columns[3:], pa.array(lengths, pa.int32()), pa.array(block.astype(np.int32)), pa.array(found, pa.list_(pa.int32())), pa.array(cells_near)], names=["node", "n", "v", "home", "angle", "length", "block", "near", "cells"])

    spread = scratch.save(map_batches(placed, reached, "node long, n long, v binary, home int, angle double, length int, block int, near array<int>, cells int"))
    if seen is not None:
        total = spread.agg(F.sum("cells"), F.sum(F.size("near"))).first()
        seen |= {"pivots": count, "classes": sum(n for _, n in sizes), "replicas": total[0] or 0, "sent": total[1] or 0}
    sent = spread.select("node", "n", "v", "home", "angle", "length", "block", F.explode("near").alias("to"))
    met = sent.select(F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi"), (F.col("block") > F.col("to")).cast("int").alias("side"), "node", "n", "v", "home", "angle", "length")
    found = scratch.save(met.groupBy("lo", "hi").applyInArrow(_join(threshold, r, pivots, first, radius), "u long, v long, links long"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.select("u", "v"), scratch).withColumnRenamed("id", "node").groupBy("node").agg(F.min("component").alias("component"))
    joined = scratch.save(
        classes.select("sig", "node", "least", "n").join(links, "node", "left").join(comp, "node", "left")
        .select("sig", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.save(joined.join(ids, "component").select("sig", "n_links", "component_id", F.lit(True).alias("usable")))
    return (
        rows.select("id", "sig").join(known, "sig", "left")
        .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )
