"""SentencePiece encoding and decoding through a relational lattice.

A text becomes "▁" and its characters, blanks as "▁". Where two neighbours stand side by side in no piece, no
piece can cross, so the text is cut there into words, which are encoded on their own. Every distinct
word's substrings up to the longest piece are exploded and joined by equality to the piece table; the edges found are
grouped by word and folded by a Spark higher-order aggregate:

* fold "merge", for BPE models: edges in descending score; an edge whose span is exactly two current
  segments joins them. A Viterbi fold over the scores of a BPE model does not give the library's ids;
  this one does. If a join makes an edge possible that the fold has passed already (no word of the
  public piece table is known to do so), the word is left to the library;
* fold "viterbi", for unigram models: the path of the greatest sum of scores.

Documents get their ids back chunk by chunk: a chunk is at most CHUNK bytes of one scan task, knows
its own words only, and meets their encodings in a cogroup. Text crosses the network once, packed.
Words over LONG characters, words with characters outside the piece table (byte pieces) and words
that a repeated scan puts elsewhere are encoded by the library in the chunk.

Semantics: null and empty texts have no tokens; repeated rows each get a row; decoding gives the text
back, except that "▁" itself becomes a blank; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import give_back, mix, powers, slices, text_bytes

CHUNK, LONG, MARK = 10_000_000, 60, "▁"
_MODELS: dict = {}


def library(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, score, rank (of the score, equal scores alike) of the ordinary pieces: as many rows as the model's vocabulary."""
    m = library(path)
    skip = lambda i: m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)
    rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in range(m.get_piece_size()) if not skip(i)]
    rank = {s: r for r, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
    return spark.createDataFrame([(p, i, s, rank[s]) for p, i, s in rows], "piece string, id int, score double, rank int")


class Cutter:
    """Cuts texts between characters that are neighbours in no piece: by a table of pairs below EDGE, and by a sorted
    list of the pieces' other pairs."""

    EDGE = 0x250

    def __init__(self, path: str):
        m = library(path)
        n = self.EDGE + 1
        self.joint = np.zeros((n + 1, n + 1), bool)
        wide = set()
        for i in range(m.get_piece_size()):
            if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i)):
                points = self._points(m.id_to_piece(i))
                c = self._classes(points)
                self.joint[c[:-1], c[1:]] = True
                wide.update(self._pairs(points)[(c[:-1] == self.EDGE) | (c[1:] == self.EDGE)].tolist())
        self.joint[self.EDGE] = self.joint[:, self.EDGE] = False
        self.wide = np.array(sorted(wide), np.uint64)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def _pairs(points: np.ndarray) -> np.ndarray:
        p = points.astype(np.uint64)
        return (p[:-1] << np.uint64(32)) | p[1:]

    def _classes(self, points: np.ndarray) -> np.ndarray:
        return np.where(points == ord(MARK), self.EDGE + 1, np.minimum(points, self.EDGE))

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts end to end as one string and as code points, the borders of its words, and how many words each text has."""
        parts = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        s = "".join(parts)
        points = self._points(s)
        if not s:
            return s, points, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
        c = self._classes(points).astype(np.int32)
        joint = self.joint.reshape(-1)[c[:-1] * np.int32(len(self.joint)) + c[1:]]
        odd = c == self.EDGE
        if len(self.wide) and odd.any():
            at = np.flatnonzero(odd[:-1] | odd[1:])
            pairs = (points[at].astype(np.uint64) << np.uint64(32)) | points[at + 1]
            joint[at] = self.wide[np.minimum(np.searchsorted(self.wide, pairs), len(self.wide) - 1)] == pairs
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        joint[ends[(ends > 0) & (ends < len(s))] - 1] = False  # texts end words
        borders = np.concatenate([[0], np.flatnonzero(~joint) + 1, [len(s)]])
        return s, points, borders, np.diff(np.searchsorted(borders, np.append(0, ends)))

    def words(self, text: str) -> list[str]:
        s, _, borders, _ = self.cut([text])
        return [s[i:k] for i, k in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


_CODES = np.random.default_rng(0x51CE).integers(1, 2**63, 1 << 16, dtype=np.uint64)


#: Characters that are hashed at once, one word at least.
BLOCK = 1 << 17


def span_hashes(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """64-bit hashes of what lies between neighbouring borders, which do not depend on where it lies."""
    out = np.zeros(len(borders) - 1, np.uint64)
    a = 0
    while a < len(out):
        z = min(len(out), max(a + 1, int(np.searchsorted(borders, borders[a] + BLOCK, side="right")) - 1))
        at = borders[a : z + 1] - borders[a]
        c = points[borders[a] : borders[z]]
        p, inv = powers(len(c) + 1)
        run = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((_CODES[c & 0xFFFF] + (c >> 16)) * p[: len(c)], out=run[1:])
        run = run[at]
        out[a:z] = mix((run[1:] - run[:-1]) * inv[at[:-1]] + np.diff(at).astype(np.uint64))
        a = z
    return out


class Numbers:
    """Distinct 64-bit hashes numbered as they come (0, 1, ...), in open addressing, whole arrays at a time."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.full(1 << 10, -1, np.int32)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), self._home(h)
        while len(left) and len(self.hashes):
            got = self.slots[at]
            same = (got >= 0) & (self.hashes[got] == h[left])
            out[left[same]] = got[same]
            on = (got >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """h: distinct, and none of them there."""
        left = np.arange(len(self.hashes), len(self.hashes) + len(h), dtype=np.int32)
        self.hashes = np.concatenate([self.hashes, h])
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.hashes)).bit_length(), -1, np.int32)
            left = np.arange(len(self.hashes), dtype=np.int32)
        at = self._home(self.hashes[left])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot, one stays
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)


_CUTTERS: dict[str, Cutter] = {}


def cutter(path: str) -> Cutter:
    if path not in _CUTTERS:
        _CUTTERS[path] = Cutter(path)
    return _CUTTERS[path]


def by_library(words: list[str], path: str) -> list[np.ndarray]:
    """The library's ids of words as they stand inside a text. A newline, which no piece of the model holds, takes
    the blank that the library puts first; both are dropped again."""
    m = library(path)
    return [np.array(x[2:], np.int32) for x in m.encode(["\n" + w.replace(MARK, " ") for w in words], num_threads=1)]


def lattice(words: DataFrame, pieces: DataFrame, longest: int, carry: str, least: int, edge: Column, by: list[str]) -> DataFrame:
    """by (word and what else tells rows apart), carry and edges: ``edge`` for all i, k, rank, score with i:k of the word a piece of ``least`` or more
    characters, sorted. words: one row a word, already distinct; its partitioning is kept, so grouping needs
    no exchange. The carried column rides on one row a word, which meets the empty piece."""
    n = F.length("word")
    starts = words.where(n <= LONG).select(*by, carry, n.alias("n"), F.explode(F.sequence(F.lit(-1), F.greatest(n - least, F.lit(-1)))).alias("i"))
    last = F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.least(F.col("n"), F.col("i") + longest))
    spans = starts.select(*by, F.when(F.col("i") < 0, F.col(carry)).alias(carry), "i", F.explode(F.sequence(F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("i") + least), last)).alias("k"))
    piece = F.when(F.col("i") < 0, F.lit("")).otherwise(F.coalesce(F.substring("word", F.col("i") + 1, F.col("k") - F.col("i")), F.lit("")))  # never null: no filter computes it again
    table = pieces.select("piece", "rank", "score").unionByName(pieces.sparkSession.createDataFrame([("", 0, 0.0)], "piece string, rank int, score double"))
    found = spans.withColumn("piece", piece).join(F.broadcast(table), "piece")  # bounded: one vocabulary
    return found.groupBy(*by).agg(F.first(carry, ignorenulls=True).alias(carry), F.sort_array(F.collect_list(F.when(F.col("i") >= 0, edge))).alias("edges"))


def _bind(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


_LATE = 62


def merge_edge() -> Column:
    """An edge as one number, in the order of joins: the rank of its score, then i and k (six bits each)."""
    return F.shiftleft(F.col("rank").cast("long"), 12).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 6)).bitwiseOR(F.col("k").cast("long"))


def fold_merge(word: Column, edges: Column) -> Column:
    """The borders of a word's pieces as bits, or null if the order of joins is in doubt."""
    one, none, late = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(1 << _LATE).cast("long")
    bit = lambda c: F.call_function("shiftleft", one, c.cast("int"))
    first = lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(63).cast("long"))
    last = lambda e: e.bitwiseAND(F.lit(63).cast("long"))
    inner = lambda e: bit(last(e)) - bit(first(e) + 1)

    def fits(mask: Column, e: Column) -> Column:
        return (F.bit_count(mask.bitwiseAND(inner(e))) == 1) & (mask.bitwiseAND(bit(first(e))) != 0) & (mask.bitwiseAND(bit(last(e))) != 0)

    def step(mask: Column, e: Column) -> Column:
        def joined(left: Column) -> Column:
            return left.bitwiseOR(F.when(F.exists(edges, lambda b: (b < e) & fits(left, b)), late).otherwise(none))

        return F.when(fits(mask, e), _bind(mask.bitwiseAND(F.bitwise_not(inner(e))), joined)).otherwise(mask)

    mask = F.aggregate(edges, bit(F.length(word) + 1) - 1, step)
    return _bind(mask, lambda m: F.when(m.bitwiseAND(late) == 0, m))


def fold_viterbi(word: Column, edges: Column) -> Column:
    """The borders of the pieces on the path of the greatest score sum as bits; null if there is no path. The first of
    equal paths stays. Unigram tables hold single characters as edges, too."""
    low = F.lit(float("-inf"))
    one = F.lit(1).cast("long")

    def forward(by_end: Column) -> Column:
        start = F.transform(F.sequence(F.lit(0), F.length(word)), lambda p: F.struct(F.when(p == 0, F.lit(0.0)).otherwise(low).alias("best"), F.when(p == 0, one).otherwise(F.lit(0).cast("long")).alias("bits")))

        def step(a: Column, e: Column) -> Column:
            before = F.get(a, e["i"])
            score = before["best"] + e["score"]
            bits = before["bits"].bitwiseOR(F.call_function("shiftleft", one, e["k"]))
            return F.transform(a, lambda v, p: F.when((p == e["k"]) & (score > v["best"]), F.struct(score.alias("best"), bits.alias("bits"))).otherwise(v))

        return F.aggregate(by_end, start, step)

    return _bind(forward(edges), lambda a: F.when(F.element_at(a, -1)["best"] > low, F.element_at(a, -1)["bits"]))


FOLDS = {"merge": fold_merge, "viterbi": fold_viterbi}


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, carry: str, fold: str = "merge", by: tuple[str, ...] = ("word",)) -> DataFrame:
    """word, carry, borders (bit p: a piece begins or ends at character p) for words, distinct in ``by``."""
    least, edge = (1, F.struct("k", "i", "score")) if fold == "viterbi" else (2, merge_edge())
    made = lattice(words, pieces, longest, carry, least, edge, list(by))
    return made.select("word", carry, FOLDS[fold](F.col("word"), F.col("edges")).alias("borders"))


def cut(word: str, borders: int | None) -> list[str] | None:
    """The pieces of a word between its borders."""
    if borders is None:
        return None
    at = [p for p in range(len(word) + 1) if borders >> p & 1]
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with their chunk number: the scan task and how many chunks it has filled."""
    from pyspark import TaskContext

    pid, sub, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        off = text_bytes(batch.column(1))[1]
        for a, k in slices(batch.column(1), 256):
            now = int(off[a + k] - off[a])
            if size and size + now > CHUNK:
                sub, size = sub + 1, 0
            size += now
            yield (pid << 24) | sub, batch.slice(a, k)


def _pack(batch: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write(batch)
    return sink.getvalue().to_pybytes()


def _chunk_words(path: str):
    return lambda batches: _distinct(cutter(path), batches)


def _distinct(cut_: Cutter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chunk): the distinct words of each chunk, sorted."""
    now, seen, words = None, Numbers(), []

    def told() -> Iterator[pa.RecordBatch]:
        words.sort()
        for a in range(0, len(words), 50_000):
            part = pa.array(words[a : a + 50_000], pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), now, np.int64))], names=["word", "chunk"])

    for chunk, part in _chunks(batches):
        if chunk != now:
            yield from told()
            now, seen, words = chunk, Numbers(), []
        for a, k in slices(part.column(1), 256, 1 << 18):
            s, points, borders, _ = cut_.cut(part.column(1).slice(a, k).to_pylist())
            h = span_hashes(points, borders)
            fresh = np.flatnonzero(seen.find(h) < 0)
            h, first = np.unique(h[fresh], return_index=True)
            seen.add(h)
            fresh = fresh[first]
            fresh = fresh[borders[fresh + 1] - borders[fresh] <= LONG]
            words += [s[i:j] for i, j in zip(borders[fresh].tolist(), borders[fresh + 1].tolist(), strict=True)]
    yield from told()
    del seen, words
    give_back()


def _chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, blob): packed rows."""
    now, parts = None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_pack(pa.Table.from_batches(parts).combine_chunks())], pa.binary())], names=["chunk", "blob"])

    for chunk, part in _chunks(batches):
        if parts and (chunk != now or len(parts) >= 24):
            yield told()
            parts = []
        now = chunk
        parts.append(part)
    if parts:
        yield told()
    del parts
    give_back()


def _chunk_dictionaries(path: str):
    return lambda batches: _dictionaries(path, batches)


def _dictionaries(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, blob): the encodings each chunk needs, packed. Words in doubt or with characters that are no piece
    are left out, for the library."""
    held, rows = [], 0
    m = library(path)
    small = pa.uint16() if m.get_piece_size() <= 1 << 16 else pa.int32()
    known = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))}

    def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
        out, keep = [], []
        for r, (w, bits) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            ids = [known.get(p) for p in cut(w, bits) or ()]
            if ids and None not in ids:
                out.append(ids)
                keep.append(r)
        some = b.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.list_(small))], names=["word", "chunks", "ids"])

    def told() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("word").combine_chunks()  # in order, words pack well
        held.clear()
        lists = t.column("chunks").combine_chunks()
        t = t.select(["word", "ids"])
        chunk, parent = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(t), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order])) + 1
        for who in np.split(order, cuts) if len(order) else []:
            blob = _pack(t.take(pa.array(np.sort(parent[who]))).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[who[:1]], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    for b in batches:
        held.append(encoded(b))
        rows += held[-1].num_rows
        if rows >= 40_000:
            yield from told()
            held, rows = [], 0
    if rows:
        yield from told()
    del held
    give_back()


def _unpack(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for b in blobs:
        yield pa.ipc.open_stream(b.as_buffer()).read_all()


def _pieces_as_bytes(path: str) -> np.ndarray:
    m = library(path)
    one = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode()
    return np.array([one(i) for i in range(m.get_piece_size())], object)


def _joined(table: np.ndarray, ids: np.ndarray) -> str:
    t = b"".join(table[ids]).decode("utf-8", "replace")
    return t[1:] if t.startswith(" ") else t


class Dictionary:
    """Finds words by hash and compares them character by character, so that equal hashes of different words do no harm."""

    def __init__(self, names: list[pa.Array]):
        words = pa.chunked_array(names, pa.string()).combine_chunks()
        self.n = len(words)
        self.points = Cutter._points(text_bytes(words)[0].tobytes().decode())
        self.borders = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy())]).astype(np.int64)
        h, self.which = np.unique(span_hashes(self.points, self.borders), return_index=True)
        self.numbers = Numbers()
        self.numbers.add(h)

    def find(self, points: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The number of each word between borders, which lie end to end over all points, or -1."""
        which = self.numbers.find(span_hashes(points, borders))
        size = np.diff(borders)
        there = which >= 0
        if not there.any():
            return which
        which[there] = self.which[which[there]]
        there &= np.diff(self.borders)[which] == size
        at = np.repeat(np.where(there, self.borders[which] - borders[:-1], -borders[:-1]), size) + np.arange(len(points))
        apart = np.flatnonzero(self.points[np.minimum(at, len(self.points) - 1)] != points)
        there[np.searchsorted(borders, apart, side="right") - 1] = False
        return np.where(there, which, -1)


def _apply(path: str, key: str, digest: bool):
    def one(texts: pa.Table, known: pa.Table) -> pa.Table:
        cut_ = cutter(path)
        table = _pieces_as_bytes(path) if digest else None
        index: dict[str, int] = {}  # of words beyond the dictionary
        names, starts, sizes, values, at = [], [], [], [], 0
        for t in _unpack(known.column("blob")):
            ids = t.column("ids").combine_chunks()
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int32)
            names.append(t.column("word").combine_chunks())
            starts.append(off[:-1] + at)
            sizes.append(np.diff(off))
            values.append(flat)
            at += len(flat)
        dictionary = Dictionary(names)
        del names
        start = np.concatenate(starts or [np.zeros(0, np.int64)]).astype(np.int64)
        size = np.concatenate(sizes or [np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate(values or [np.zeros(0, np.int32)])
        keys, lists, digests = [], [], []
        for t in _unpack(texts.column("blob")):
            keys.append(t.column(0))
            column = t.column(1).combine_chunks()
            for a, k in slices(column, 128, 1 << 18):
                s, points, borders, counts = cut_.cut(column.slice(a, k).to_pylist())
                which = dictionary.find(points, borders)
                other = np.flatnonzero(which < 0)
                if len(other):
                    split = [s[i:j] for i, j in zip(borders[other].tolist(), borders[other + 1].tolist(), strict=True)]
                    new = [w for w in set(split) if w not in index]
                    if new:
                        more = by_library(new, path)
                        for w in new:
                            index[w] = dictionary.n + len(index)
                        n = np.array([len(m) for m in more], np.int64)
                        start = np.concatenate([start, len(value) + np.cumsum(n) - n])
                        size = np.concatenate([size, n])
                        value = np.concatenate([value, *more])
                    which[other] = np.fromiter(map(index.__getitem__, split), np.int64, len(split))
                n = size[which]
                ends = np.cumsum(n)
                flat = value[np.repeat(start[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
                cuts = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32())))
                if digest:
                    digests += [hashlib.sha256(_joined(table, flat[i:j]).encode()).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        none = pa.array([], pa.list_(pa.int32()))
        out = {key: pa.concat_arrays([c for k in keys for c in k.chunks]) if keys else pa.array([], pa.int64()), "ids": pa.concat_arrays(lists) if lists else none}
        return pa.table(out | ({"decoded_sha256": pa.array(digests, pa.string())} if digest else {}))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        out = one(texts, known)
        give_back()
        return out

    return run


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", fold: str = "merge", digest: bool = False) -> DataFrame:
    """key, ids for every row; ``digest``: also decoded_sha256, of the text that the ids decode to."""
    spark = docs.sparkSession
    src = docs.select(docs[key].cast("long").alias(key), docs[text].alias("text"))
    pieces = piece_table(spark, path)
    m = library(path)
    longest = max(len(m.id_to_piece(i)) for i in range(m.get_piece_size()) if not m.is_byte(i))
    # A word is encoded once for every 4,096 scan tasks, so that the list of chunks of a common word is bounded.
    part = F.shiftright("chunk", 24 + 12).alias("part")
    words = src.mapInArrow(_chunk_words(path), "word string, chunk long").groupBy("word", part).agg(F.collect_list("chunk").alias("chunks"))
    known = encode_words(words, pieces, longest, "chunks", fold, ("word", "part")).mapInArrow(_chunk_dictionaries(path), "chunk long, blob binary")
    texts = src.mapInArrow(_chunk_texts, "chunk long, blob binary")
    schema = f"{key} long, ids array<int>" + ", decoded_sha256 string" * digest
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_apply(path, key, digest), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, ids, text for every row: pieces end to end, byte pieces as UTF-8, "▁" as blanks, without the first.
    One narrow pass with the piece table in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces_as_bytes(path)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                out = [_joined(table, x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=[key, ids, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} long, {ids} array<int>, text string")
