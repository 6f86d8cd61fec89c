"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments of SEGMENT positions; from a zero state the network reads each
segment in both directions and labels every position with a distribution over the learned languages.
A document's probabilities are the mean over all its positions, so whole texts count, at a cost in
proportion to their length. Training is backpropagation through time with Adam, in numpy, on a
bounded sample of windows, from a fixed seed.

Semantics: texts that are null or hold no letter get ``und`` with score 0; without any labelled
text nothing is learned and every text gets ``und``; repeated rows each get a row; ties between
languages go to the first in sorted order; long texts are read whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import append_columns, crc32_mod, map_batches, text_bytes

SEGMENT = 128
_COMMON = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_COMMON.search(text) is not None or any(map(str.isalpha, text)))




class ByteGRU:
    """h' = h + z (c - h); z, r = sigmoid(x + h U); c = tanh(x + r (h U)); one such cell a direction."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {
            "X": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "U": rng.normal(0, 0.35, (2, h, 3 * h)).astype(np.float32),
            "O": rng.normal(0, 0.3, (2, h, classes)).astype(np.float32),
            "b": np.zeros(classes, np.float32),
        }

    def states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x, mask: (time, batch); the two directions' states (2, time, batch, hidden), the second in
        reversed time. keep: also what the backward pass needs."""
        h, (steps, n) = self.hidden, x.shape
        gates, rec = self.p["X"], self.p["U"].copy()
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5  # sigmoid(a) = (tanh(a / 2) + 1) / 2
        gates, rec = gates * half, rec * half
        both = np.stack([x, x[::-1]])
        live = np.stack([mask, mask[::-1]])[..., None].astype(np.float32)
        all_live = bool(mask.all())
        out = np.empty((2, steps, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        tape = []
        for t in range(steps):
            a = np.matmul(state, rec)
            zr = np.empty((2, n, 3 * h), np.float32)
            np.take(gates[0], both[0, t], axis=0, out=zr[0], mode="clip")
            np.take(gates[1], both[1, t], axis=0, out=zr[1], mode="clip")
            g = np.tanh(zr[..., : 2 * h] + a[..., : 2 * h])
            g += 1
            g *= 0.5
            z, r = g[..., :h], g[..., h:]
            c = np.tanh(zr[..., 2 * h :] + r * a[..., 2 * h :])
            new = state + z * (c - state)
            if not all_live:
                new *= live[:, t]
            if keep:
                tape.append((state, z, r, c, a[..., 2 * h :]))
            out[:, t] = state = new
        return (out, tape, both, live) if keep else out

    def probabilities(self, out: np.ndarray) -> np.ndarray:
        """(time, batch, classes), one distribution a position."""
        logits = out[0] @ self.p["O"][0] + (out[1] @ self.p["O"][1])[::-1] + self.p["b"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over live positions, and its gradients through time."""
        h, (steps, n) = self.hidden, x.shape
        out, tape, both, live = self.states(x, mask, keep=True)
        p = self.probabilities(out)
        total = max(1, int(mask.sum()))
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, n, 1)), 2)[..., 0] + 1e-9) * mask).sum()) / total
        d = p.copy()
        d[:, np.arange(n), y] -= 1
        d *= mask[..., None] / total
        flat = d.reshape(-1, d.shape[-1])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = flat.sum(0)
        g["O"][0] = out[0].reshape(-1, h).T @ flat
        g["O"][1] = out[1][::-1].reshape(-1, h).T @ flat
        back = np.stack([d @ self.p["O"][0].T, (d @ self.p["O"][1].T)[::-1]])
        dh = np.zeros((2, n, h), np.float32)
        dx = np.empty((2, steps, n, 3 * h), np.float32)
        ut = self.p["U"].transpose(0, 2, 1)
        for t in reversed(range(steps)):
            dh = (dh + back[:, t]) * live[:, t]
            state, z, r, c, hu = tape[t]
            dac = dh * z * (1 - c * c)
            da = np.concatenate([dh * (c - state) * z * (1 - z), dac * hu * r * (1 - r), dac * r], axis=-1)
            g["U"] += np.matmul(state.transpose(0, 2, 1), da)
            dx[:, t, :, : 2 * h], dx[:, t, :, 2 * h :] = da[..., : 2 * h], dac
            dh = dh * (1 - z) + np.matmul(da, ut)
        for k in range(2):
            hot = np.zeros((steps * n, 256), np.float32)
            hot[np.arange(steps * n), both[k].reshape(-1)] = 1
            g["X"][k] = hot.T @ dx[k].reshape(-1, 3 * h)
        return loss, g

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = 160, batch: int = 384, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on batches that hold every class alike; x, mask: (time, windows)."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in np.unique(y)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            at = np.concatenate([rng.choice(k, max(1, batch // len(by))) for k in by])
            loss, g = self.gradients(x[:, at], mask[:, at], y[at])
            lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            for k in self.p:
                a = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return loss

    def pooled(self, raw: np.ndarray, off: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Mean position probabilities of each text; zeros for texts without a byte."""
        n = np.diff(off)
        segs = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), segs)
        first = np.concatenate([[0], np.cumsum(segs)])
        at = off[:-1][text] + (np.arange(len(text)) - first[text]) * SEGMENT
        size = np.minimum(SEGMENT, off[1:][text] - at)
        out = np.zeros((len(n), len(self.p["b"])))
        order = np.argsort(-size, kind="stable")  # whole segments first: their batches need no mask
        steps = np.arange(SEGMENT)[:, None]
        for k in range(0, len(order), chunk):
            who = order[k : k + chunk]
            longest = int(size[who[0]])
            where = at[who] + steps[:longest]
            mask = steps[:longest] < size[who]
            x = raw[np.where(mask, where, 0)]
            p = self.probabilities(self.states(x, mask))
            np.add.at(out, text[who], (p * mask[..., None]).sum(0, dtype=np.float64))
        return out / np.maximum(n, 1)[:, None]


class LanguageModel:
    def __init__(self, languages: list[str], net: ByteGRU | None):
        self.languages, self.net = languages, net

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.to_pylist()
        letters = np.array([has_letter(t) for t in texts], bool)
        if self.net is None or not letters.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        p = self.net.pooled(*text_bytes(column))
        best = p.argmax(1)
        score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def fit(docs: DataFrame, per_language: int = 400, windows: int = 6, width: int = 64, text: str = "text", lang: str = "lang", key: str = "doc_id", languages: int = 256) -> LanguageModel:
    """Learns from at most ``per_language`` texts of each value of lang, those of the least hashes of id and text (the
    bound of the sample; equal rows are one, and each value has one text at least), and ``windows`` windows of each;
    of the ``languages`` most frequent values."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("l")).where("t is not null and l is not null and length(t) > 0")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.col("count").desc(), "l").limit(languages).collect()}
    names = sorted(counts)
    if not names:
        return LanguageModel([], None)
    hashed = rows.withColumn("h", F.xxhash64(F.lit(17), "k", "t"))
    # Twice the share that is wanted, then exactly the least hashes; the very least is always in.
    rate = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, 2 * per_language / counts[n]))])[F.col("l")]
    part = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    some = hashed.where(part < rate).select("l", "h").unionByName(hashed.where(F.col("l").isin(names)).groupBy("l").agg(F.min("h").alias("h"))).distinct()
    chosen = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("r")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, which, out = [], [], []
        for n, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = t.encode()
            rng = np.random.default_rng(h % 2**32)
            for at in rng.integers(0, max(1, len(b) - width + 1), windows).tolist():
                out.append(b[at : at + width])
                name.append(n)
                which.append(h)
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(which, pa.int64()), pa.array(out, pa.binary())], names=["l", "h", "w"])

    # chosen: at most per_language rows a language, languages at most.
    found = map_batches(hashed.join(F.broadcast(chosen), ["l", "h"]).select("l", "h", "t"), cut, "l string, h long, w binary")
    sample = sorted((r["l"], w) for r in found.groupBy("l", "h").agg(F.collect_set("w").alias("ws")).collect() for w in r["ws"])
    size = np.array([len(w) for _, w in sample])
    x = np.zeros((width, len(sample)), np.uint8)
    for i, (_, w) in enumerate(sample):
        x[: len(w), i] = np.frombuffer(w, np.uint8)
    mask = np.arange(width)[:, None] < size
    y = np.array([names.index(n) for n, _ in sample])
    net = ByteGRU(len(names))
    net.train(x, mask, y)
    return LanguageModel(names, net)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every row; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the corpus

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, score = shared.value.predict(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return map_batches(docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")), run, f"{key} long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose language is predicted with at least ``least``; without a
    learned language nothing can be rejected, and all rows stay."""
    if model.net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def predict(column: pa.Array) -> list[pa.Array]:
        name, score = shared.value.predict(column)
        return [pa.array(name, pa.string()), pa.array(score)]

    told = append_columns(docs, text, predict, [("__lexmill_lang", T.StringType()), ("__lexmill_sure", T.DoubleType())])
    return told.where((F.col("__lexmill_lang") != "und") & (F.col("__lexmill_sure") >= least)).drop("__lexmill_lang", "__lexmill_sure")


def held_out(key: str = "doc_id"):
    return crc32_mod(key, 4) == 2
