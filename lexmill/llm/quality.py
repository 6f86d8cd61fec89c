"""Quality scores by similarity-weighted votes of the nearest labelled texts in a latent-semantic space.

Terms are trigrams of character classes (letters by case, digits, punctuation marks in 43 groups), and how
often words repeat; a text is the square roots of its term shares, weighted by inverse document
frequency. A truncated singular value decomposition of a bounded labelled sample gives the latent
space. The labelled vectors are broadcast (at most 2 * PER_CLASS of them); every document is
compared with all of them in exact blocked cosine products.

Semantics: texts that are null or hold no word score 0 (rejected); without labelled rows every other
text scores 0.5; ids labelled twice take the lower label; labels other than 0 and 1, null ids and ids without a row are ignored;
of rows of one labelled id one is learned from, that of the least term counts; neighbours tied with the last one all vote; repeated rows each get
a row, and so do rows without an id. Texts are scored whole, 256 at a time; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BYTE, append_columns, crc32_mod, map_batches, mix, powers, text_bytes

#: The bound of the labelled sample: so many rows of each label, by the hash of the id.
PER_CLASS = 1500
DIMS, TERMS, NEIGHBOURS = 48, 4096, 15


def _classes() -> np.ndarray:
    c = np.zeros(256, np.int64)
    for b in range(256):
        ch = chr(b)
        c[b] = 0 if ch.islower() or b >= 128 else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch == " " else 4 if b < 32 else 5 + b % 43
    return c


CLASS = _classes()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, TERMS) term counts, and the number of words of each text."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    c = CLASS[raw]
    out = np.zeros((n, TERMS), np.float32)
    words = np.zeros(n, np.int64)
    if len(raw):
        code = mix((c[:-2] * 2304 + c[1:-1] * 48 + c[2:]).astype(np.uint64)) % np.uint64(TERMS - 64) if len(raw) > 2 else np.zeros(0, np.uint64)
        whole = doc[:-2] == doc[2:]
        out += np.bincount(doc[:-2][whole] * TERMS + code[whole].astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)
        gap = SPACE[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        edge[1:] = gap[:-1] | (doc[1:] != doc[:-1])
        start = np.flatnonzero(edge & ~gap)
        stop = np.empty(len(raw), bool)
        stop[-1] = True
        stop[:-1] = gap[1:] | (doc[1:] != doc[:-1])
        end = np.flatnonzero(stop & ~gap) + 1
        if len(start):
            p, inv = powers(len(raw) + 1)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * p[: len(raw)], dtype=np.uint64)])
            h, d = (run[end] - run[start]) * inv[start], doc[start]
            words = np.bincount(d, minlength=n)
            for lag in (1, 2, 4):  # how many words repeat a near predecessor
                same = (h[lag:] == h[:-lag]) & (d[lag:] == d[:-lag])
                out[:, TERMS - lag] = np.bincount(d[lag:][same], minlength=n) * 8
            order = np.lexsort((h, d))
            hs, ds = h[order], d[order]
            again = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
            out[:, TERMS - 5] = np.bincount(ds[1:][again], minlength=n)
            size = np.minimum(end - start, 15)
            out += np.bincount(d * TERMS + TERMS - 32 + size, minlength=n * TERMS).reshape(n, TERMS)
    return out, words


def weigh(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


class QualityModel:
    def __init__(self, space: np.ndarray | None, vectors: np.ndarray | None, labels: np.ndarray | None):
        self.space, self.vectors, self.labels = space, vectors, labels

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = weigh(counts) @ self.space
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, column: pa.Array, block: int = 256) -> np.ndarray:
        raw, off = text_bytes(column)
        out = np.empty(len(off) - 1)
        for a in range(0, len(out), block):
            b = min(len(out), a + block)
            counts, words = terms(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            if self.space is None:
                out[a:b] = np.where(words > 0, 0.5, 0.0)
                continue
            sim = self.latent(counts) @ self.vectors.T
            k = min(NEIGHBOURS, sim.shape[1])
            least = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k]
            row, col = np.nonzero(sim >= least[:, None])
            w = np.exp(12.0 * (sim[row, col].astype(np.float64) - 1))
            total = np.bincount(row, w, b - a)
            out[a:b] = np.where(words > 0, np.bincount(row, w * self.labels[col], b - a) / np.maximum(total, 1e-300), 0.0)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text", key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Learns the space and the labelled vectors from at most per_class rows of each label."""
    known = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    order = F.xxhash64(F.lit(23), "k")
    part = [known.where(F.col("y") == y).orderBy(order, "k").limit(per_class) for y in (0, 1)]
    sample = part[0].unionByName(part[1])
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).where("t is not null").join(F.broadcast(sample), "k")  # at most 2 * per_class ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n, where, count = [], [], [], []
        for i in range(0, batch.num_rows, 64):
            raw, off = text_bytes(batch.column(1).slice(i, 64))
            c, words = terms(raw, off)
            for r in np.flatnonzero(words).tolist():
                nz = np.flatnonzero(c[r])
                at.append(i + r)
                where.append(nz.astype(np.int16).tobytes())
                count.append(c[r, nz].astype(np.float32).tobytes())
        at_a = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at_a), batch.column(2).take(at_a), pa.array(where, pa.binary()), pa.array(count, pa.binary())], names=["k", "y", "w", "c"])

    counted = map_batches(rows.select(F.col("k").cast("long").alias("k"), "t", F.col("y").cast("int").alias("y")), run, "k long, y int, w binary, c binary")
    got = sorted((r["k"], *r["v"]) for r in counted.groupBy("k").agg(F.min(F.struct("y", "w", "c")).alias("v")).collect())  # one row a sampled id
    if not got:
        return QualityModel(None, None, None)
    x = np.zeros((len(got), TERMS), np.float32)
    y = np.array([r[1] for r in got], np.float64)
    for i, (_, _, w, c) in enumerate(got):
        x[i, np.frombuffer(w, np.int16)] = np.frombuffer(c, np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    a = weigh(x) * idf
    rng = np.random.default_rng(3)
    dims = min(DIMS, *a.shape)
    q = rng.normal(size=(TERMS, dims + 16)).astype(np.float32)
    for _ in range(4):  # subspace iterations of a randomized decomposition
        q, _ = np.linalg.qr(a.T @ (a @ q))
    u, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    space = (idf[:, None] * (q @ vt.T)[:, :dims]).astype(np.float32)
    model = QualityModel(space, None, y)
    model.vectors = model.latent(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score, for every row; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS x DIMS and 2 * PER_CLASS x DIMS floats

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], names=[key, "score"])

    return map_batches(docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")), run, f"{key} long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, as in score()
    scored = append_columns(docs, text, lambda c: [pa.array(shared.value.score(c))], [("__lexmill_quality", T.DoubleType())])
    return scored.where(F.col("__lexmill_quality") >= least).drop("__lexmill_quality")


def held_out(key: str = "doc_id"):
    return crc32_mod(key, 5) == 0
