"""Best-fit packing of tokenized documents into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so everything that packing decides depends on
the histogram of lengths alone (at most ``limit`` counters, whatever the corpus holds). The plan is
made on the histogram: best fit by descending length, many equal bins at a time, then a swap-based
local search: documents are moved, exchanged one for one or two for one between underfull bins
whenever that raises the sum of squared fills, until bins are empty. Documents then find their place
by their rank among the documents of their length, a distributed numbering.

Semantics: null text is an empty document (one end token); repeated rows are packed as rows of their
own; only documents over the limit are cut, from their end into whole pieces, so that the first piece
may be shorter; rows without an id are packed like others, in the place of null among equal lengths; documents of one length are alike to
the plan and take places by id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, global_order, map_batches, slices

COMMON = re.compile(r"[\x00-ɏ]*")


class ByteTokens:
    """Token ids of a byte-level vocabulary (a tokenizers .json file), by tiktoken's faster engine for the
    same ranks; characters beyond Latin and failures go to the library itself."""

    def __init__(self, path: str, pattern: str | None = None):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from .prefix_counts import _byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        if COMMON.fullmatch(text):
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
            except BaseException as e:  # a panic of the engine's regex on odd, huge texts
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_TOKENS: dict[str, ByteTokens] = {}


def tokens(path: str) -> ByteTokens:
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones from the end, the first may be shorter."""
    head = n % limit or limit
    return [(0, min(head, n))] + [(s, limit) for s in range(head, n, limit)] if n else []


def pieces(docs: DataFrame, path: str, limit: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. The ids are recovered from the spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokens(path)
        row, no, start, length, crc = [], [], [], [], []
        for at, some in slices(batch.column(1)):
            for i, s in enumerate(batch.column(1).slice(at, some).to_pylist(), at):
                ids = np.append(t.ids(s or ""), np.uint32(end_id)).astype("<u4")
                for k, (a, n) in enumerate(cut(len(ids), limit)):
                    row.append(i)
                    no.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=[key, "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")), run, f"{key} long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], limit: int) -> Counter:
    """{pattern: bins} by best fit in descending length; a pattern is a descending tuple of lengths."""
    rest: dict[int, Counter] = {}
    open_ = []  # remaining space, ascending

    def put(pattern: tuple, space: int, bins: int) -> None:
        if space not in rest:
            rest[space] = Counter()
            insort(open_, space)
        rest[space][pattern] += bins

    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        while todo:
            at = bisect_left(open_, n)
            if at < len(open_):
                space = open_[at]
                pattern, bins = next(iter(rest[space].items()))
            else:
                space, pattern, bins = limit, (), todo
            each = min(space // n, todo)  # a bin stays the tightest as long as another one fits
            used = min(bins, todo // each)
            if at < len(open_):
                rest[space][pattern] -= used
                if not rest[space][pattern]:
                    del rest[space][pattern]
                if not rest[space]:
                    del rest[space]
                    open_.pop(at)
            put(pattern + (n,) * each, space - n * each, used)
            todo -= used * each
    return Counter({p: c for group in rest.values() for p, c in group.items()})


def local_search(bins: Counter, limit: int) -> Counter:
    """Empties underfull bins by moves and exchanges that raise the sum of squared fills, each made by all pairs of bins of the
    same two patterns at once: the work depends on the patterns, not on the bins. It ends when no fewer bins can
    hold the tokens, or after a round over all underfull bins that empties none."""
    bins = Counter(bins)
    least = ceil(sum(sum(p) * c for p, c in bins.items()) / limit)

    def change(old: tuple, new: tuple, times: int) -> None:
        bins[old] -= times
        if not bins[old]:
            del bins[old]
        if new:
            bins[new] += times

    def pairs(p: tuple) -> list[tuple[int, int]]:
        """The different pairs of documents of a bin: of lengths, since equal ones are alike."""
        times = Counter(p)
        sizes = sorted(times)
        return [(x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or times[x] > 1]

    def step(s: tuple) -> tuple | None:
        """One improving step for a bin of pattern s; its new pattern, or None."""
        fill = sum(s)
        others = sorted((b for b in bins if limit > sum(b) >= fill and (b != s or bins[b] > 1)), key=sum, reverse=True)
        single, double = sorted(set(s), reverse=True), pairs(s)
        for b in others:  # move
            gap = limit - sum(b)
            if (x := next((x for x in single if x <= gap), 0)) :
                return swap(s, b, (x,), ())
        best = None
        for b in others:
            gap = limit - sum(b)
            items = sorted(set(b))
            for x in single:  # one for one: b gains x - y
                i = bisect_left(items, x - gap)
                if i < len(items) and items[i] < x and (best is None or x - items[i] > best[0]):
                    best = (x - items[i], b, (x,), (items[i],))
            for x, x2 in double:  # two of s for one of b
                k = bisect_left(items, x + x2 - gap)
                if k < len(items) and items[k] < x + x2 and (best is None or x + x2 - items[k] > best[0]):
                    best = (x + x2 - items[k], b, (x, x2), (items[k],))
            for y, y2 in pairs(b):  # one of s for two of b
                k = bisect_left(single, -(y + y2 + gap), key=lambda v: -v)
                if k < len(single) and (x := single[k]) > y + y2 and (best is None or x - y - y2 > best[0]):
                    best = (x - y - y2, b, (x,), (y, y2))
            if best and best[0] == gap:
                break
        return swap(s, *best[1:]) if best else None

    def swap(s: tuple, b: tuple, give: tuple, take: tuple) -> tuple:
        new_s, new_b = Counter(s), Counter(b)
        new_s.subtract(give)
        new_s.update(take)
        new_b.subtract(take)
        new_b.update(give)
        s2 = tuple(sorted(new_s.elements(), reverse=True))
        times = min(bins[s], bins[b]) if s != b else bins[s] // 2  # so many equal pairs of bins take the step at once
        change(s, s2, times)
        change(b, tuple(sorted(new_b.elements(), reverse=True)), times)
        return s2

    while (count := sum(bins.values())) > least:
        for s in sorted((b for b in bins if sum(b) < limit), key=sum):
            while s and s in bins and (n := step(s)) is not None:
                s = n
        if sum(bins.values()) == count:
            break
    return bins


def plan(histogram: dict[int, int], limit: int) -> Counter:
    return local_search(best_fit(histogram, limit), limit)


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's span of its document's
    ids and its place. Sequences have no gaps and hold at most ``limit`` tokens."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut_up = scratch.save(pieces(docs, path, limit, end_id, text, key))
    histogram = {int(r[0]): int(r[1]) for r in cut_up.groupBy("length").count().collect()}  # at most limit rows
    first, start = {}, 0
    for n in sorted(histogram):
        first[n] = start
        start += histogram[n]
    used: Counter = Counter()
    base, segments = 0, []
    for pattern, bins in sorted(plan(histogram, limit).items()):
        offset = 0
        for n, times in sorted(Counter(pattern).items(), reverse=True):
            segments.append((first[n] + used[n], base, times, offset, n))
            used[n] += bins * times
            offset += n * times
        base += bins
    table = np.array(sorted(segments) or [(0, 0, 1, 0, 0)], np.int64)
    ordered = global_order(cut_up, ["length", key, "piece"], scratch)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
        seg = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
        q = rank - seg[:, 0]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(seg[:, 1] + q // seg[:, 2]), pa.array(seg[:, 3] + q % seg[:, 2] * seg[:, 4])],
            names=[*batch.schema.names[:5], "sequence_id", "offset"],
        )

    return map_batches(ordered.select(key, "piece", "start", "length", "ids_crc32", "rank"), place, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
