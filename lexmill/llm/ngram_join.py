"""N-gram Jaccard join of documents, exact at any threshold.

1. Each document becomes the set of its distinct word n-grams (64-bit hashes); equal sets form a
   class with one representative.
2. A fixed-size sketch counts the n-grams of all documents. It orders every set rarest first
   (ties by hash); any common order keeps prefix filtering exact.
3. Representatives are joined on the n-grams of their prefixes, n - ceil(t n) + 1 long on the larger
   side and n - ceil(2 t n / (1 + t)) + 1 on the smaller. Length, positional and suffix filters drop
   pairs that cannot reach the overlap.
4. What remains is verified once a pair, on the whole sets.

A group of near copies is never expanded into all its pairs: first every bucket (the documents that
share a prefix n-gram) is compared with one leader, then only pairs across the components found so
far are left, and in each bucket these need the documents outside the bucket's most common
component. No link between different components is lost, so components are exact.

Semantics: A-Z are lower-cased, words are runs without ASCII white space; a text of fewer words than n is
one n-gram, one without words or null has an empty set and links with nothing; long texts are taken
whole; rows that repeat an id count as one document in links, each with its own set size; rows without
an id take the group of their text, if it has one; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, map_batches, mix, slices, text_bytes, word_hashes
from .components import components

#: Counters of the frequency sketch, in blocks: a constant 16 MB, whatever the corpus.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Bits of the filter of ids to verify: a constant 8 MB; beyond its capacity it only lets more through.
ID_BITS = 26
#: Orders that leaders are chosen by, a power of two.
LEADERS = 4
#: So many earlier n-grams of a document tell whether a pair has met before; more only save repeated looks.
LOOK_BACK = 5
#: Bits of the parity bitmap of the suffix filter.
PARITY = 1024
SALTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    w, doc = word_hashes(raw, off, lower=True)
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    grams = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for j in range(n):
        grams += w[j : j + len(grams)] * SALTS[j]
    grams = mix(grams)
    out = []
    for a, m in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(grams[a : a + m - n + 1]))
        elif m:
            out.append(mix((w[a : a + m] * SALTS[:m]).sum(keepdims=True, dtype=np.uint64) + SALTS[32 + m]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _batches(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, k in slices(batch.column(1)):
        yield a, shingle_sets(*text_bytes(batch.column(1).slice(a, k)), n)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, sig, mark) a document, and at each task's end its part of the sketch as (block, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["id", "n", "sig", "mark", "block", "part", "counts"]
        for batch in batches:
            size, sig = [], []
            for _, sets in _batches(batch, n):
                for s in sets:
                    size.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                at, times = np.unique(_slot(np.concatenate(sets)), return_counts=True)
                sketch[at] += times.astype(np.uint32)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), batch.column(2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = [(b, sketch[b << BLOCK_BITS : (b + 1) << BLOCK_BITS]) for b in range(1 << (SKETCH_BITS - BLOCK_BITS))]
        blocks = [(b, zlib.compress(c.tobytes(), 1)) for b, c in blocks if c.any()]
        k, part = len(blocks), TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([part] * k, pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, n long, sig binary, mark long, block int, part int, counts binary")


def _add_up(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.uint64)
    for c in group.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pa.table({"block": group.column("block")[:1], "part": group.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    schema = "block int, part int, counts binary"
    two = parts.select("block", "part", "counts").groupBy("block", "part").applyInArrow(_add_up, schema).groupBy("block").applyInArrow(_add_up, schema)
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for x in two.collect():  # the sketch itself, of constant size
        sketch[x["block"] << BLOCK_BITS : (x["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(x["counts"]), np.uint32)
    return sketch


def prefix_length(n, num: int, den: int):
    """Of the larger side: n - ceil(t n) + 1."""
    return n - -(-n * num // den) + 1


def _prefixes(docs: DataFrame, n: int, sketch: np.ndarray, num: int, den: int) -> DataFrame:
    """(id, sig, n, keys, bits): the prefix, rarest first, and for each of PARITY hash ranges one bit that says
    whether it holds an odd number of the set's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # constant size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = shared.value
        row, sig, size, keys, bits = [], [], [], [], []
        for a, sets in _batches(batch, n):
            for i, s in enumerate(sets):
                m = len(s)
                if not m:
                    continue
                order = np.argsort((np.minimum(counts[_slot(s)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")
                row.append(a + i)
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                size.append(m)
                keys.append(s[order[: prefix_length(m, num, den)]].view(np.int64))
                odd = np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.int64))
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(sig, pa.binary()), pa.array(size, pa.int64()), flat(keys), flat(bits)], names=["id", "sig", "n", "keys", "bits"])

    return map_batches(docs, run, "id long, sig binary, n long, keys array<long>, bits array<long>")


def _possible(a: str, b: str, num: int, den: int) -> Column:
    """Length and positional filters of a pair at a shared prefix n-gram; columns {n, pos}."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    after = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))  # this n-gram and those after it
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (after * (num + den) >= (na + nb) * num)


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Suffix filter, by Hamming distance: every hash range whose parities differ holds an n-gram that the
    other set lacks, and of those a pair that links has (|a| + |b|) (1 - t) / (1 + t) at most."""
    x, y = F.col(f"{a}bits"), F.col(f"{b}bits")
    apart = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY // 64)), F.lit(0))
    return apart * (num + den) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (den - num)


def _verify(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct())

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (ID_BITS - 3), np.uint8)
        for batch in batches:
            slot = _id_slot(batch.column(0).to_numpy())
            np.bitwise_or.at(seen, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        if seen.any():
            packed = seen.reshape(1 << (SKETCH_BITS - BLOCK_BITS), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in packed], pa.binary())], names=["block", "bits"])

    def union(group: pa.Table) -> pa.Table:
        out = 0
        for x in group.column("bits"):
            out = np.frombuffer(zlib.decompress(x.as_py()), np.uint8) | out
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    wanted = np.zeros(1 << (ID_BITS - 3), np.uint8).reshape(1 << (SKETCH_BITS - BLOCK_BITS), -1)
    for x in ids.mapInArrow(bits, "block int, bits binary").groupBy("block").applyInArrow(union, "block int, bits binary").collect():  # constant size
        wanted[x["block"]] = np.frombuffer(zlib.decompress(x["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(wanted.reshape(-1))  # constant size

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(batch.column(0).is_valid())
        slot = _id_slot(batch.column(0).to_numpy())
        batch = batch.take(pa.array(np.flatnonzero(shared.value[slot >> 3] & (128 >> (slot & 7)).astype(np.uint8))))
        out = [s.tobytes() for _, found in _batches(batch, n) for s in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "set"])

    whole = scratch.save(map_batches(docs, sets, "id long, set binary"))
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(whole.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            z = np.concatenate([x, y])
            z.sort()
            overlap = int((z[1:] == z[:-1]).sum())
            if overlap and den * overlap >= num * (len(x) + len(y) - overlap):
                keep.append(i)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    links = scratch.save(map_batches(both.select("a", "b", "sa", "sb"), test, "a long, b long").distinct())
    scratch.drop(whole)
    return links


def _id_slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def ngram_join(documents: DataFrame, n: int = 5, num: int = 3, den: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id for every row; documents link at a Jaccard similarity >= num / den."""
    return _groups(documents, n, num, den, text, key).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(documents: DataFrame, n: int = 5, num: int = 3, den: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of documents, all their columns, of which one stays of each group of near duplicates: that of the least
    id, and of the least text hash among rows of one id. Rows are told by id and text, so a text that has no near
    duplicate stays even if another row of its id goes, and of equal rows one stays. Texts without words all stay, and so do rows
    without an id, which are near duplicates of nothing, not even of each other."""
    groups = Scratch(documents.sparkSession, "groups").save(_groups(documents, n, num, den, text, key).where("n > 0 and component_id is not null"))
    stays = groups.where("id is not null").groupBy("component_id").agg(F.min(F.struct("id", "mark")).alias("s"))
    told = groups.groupBy("component_id", "id", "mark").agg(F.count("*").alias("times")).join(stays, "component_id")
    own = F.coalesce(F.struct("id", "mark") == F.col("s"), F.lit(False))
    told = told.where(~own | (F.col("times") > 1)).select(F.col("id").alias("__lexmill_id"), F.col("mark").alias("__lexmill_mark"), own.alias("__lexmill_own"))
    marked = documents.withColumn("__lexmill_text", F.xxhash64(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("__lexmill_id")) & (F.col("__lexmill_text") == F.col("__lexmill_mark"))
    single = marked.join(told, same, "left_anti")
    several = marked.join(told.where("__lexmill_own"), same, "left_semi").dropDuplicates([key, "__lexmill_text"])
    return single.unionByName(several).drop("__lexmill_text")


def _groups(documents: DataFrame, n: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """id, mark (hash of the text), n, component_id for every row."""
    scratch = Scratch(documents.sparkSession, "ngrams")
    docs = documents.select(documents[key].cast("long").alias("id"), documents[text].alias("text"))
    described = scratch.save(_describe(docs.withColumn("mark", F.xxhash64("text")), n))
    sketch = _sketch(described.where("block is not null"))
    rows = scratch.save(described.where("block is null").select("id", "n", "sig", "mark"))
    scratch.drop(described)  # most of it is the parts of the sketch
    classes = scratch.save(rows.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("rep")))
    prefixes = scratch.save(
        _prefixes(docs, n, sketch, num, den).alias("p").join(classes.alias("c"), (F.col("p.id") == F.col("c.rep")) & (F.col("p.sig") == F.col("c.sig")))
        .select("id", "n", "keys", "bits")
    )
    # Buckets share a few leaders, each the least document in one of LEADERS orders: documents of one group that do not
    # reach one leader mostly reach another, and a document is compared with a few at most.
    shuffled = F.xxhash64(F.lit(29), F.col("key").bitwiseAND(F.lit(LEADERS - 1)), "id")
    leaders = scratch.save(
        prefixes.select("id", F.explode("keys").alias("key")).select("key", shuffled.alias("h"))
        .groupBy("key").agg(F.min("h").alias("lead"), F.max("h").alias("top"))
        .where("lead <> top").select("key", "lead")
    )
    entries = prefixes.select("id", "n", F.posexplode("keys").alias("pos", "key")).select("key", "id", "n", F.col("pos").cast("long").alias("pos"))
    shared = scratch.save(entries.join(leaders, "key"))
    scratch.drop(leaders)
    lead = scratch.save(shared.where(shuffled == F.col("lead")).select("key", F.col("id").alias("lid"), F.col("n").alias("l_n"), F.col("pos").alias("l_pos")))
    met = shared.where(shuffled != F.col("lead")).join(lead, "key").where(_possible("", "l_", num, den))
    met = scratch.save(met.select(F.least("id", "lid").alias("a"), F.greatest("id", "lid").alias("b")).distinct())
    scratch.drop(lead)
    about = prefixes.select("id", "n", "bits")
    side = lambda p: about.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits"))
    tried = scratch.save(met.join(side("a"), "a").join(side("b"), "b").where(_near("a_", "b_", num, den)).select("a", "b"))
    scratch.drop(met)
    links = _verify(docs, tried, n, num, den, scratch)
    label = scratch.save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))
    # What is left: pairs of one bucket in different components. One of such two is outside the bucket's most common one.
    marked = scratch.save(shared.drop("lead").join(label, "id", "left").select("key", "id", "n", "pos", F.coalesce("component", "id").alias("label")))
    scratch.drop(shared, label)
    counted = scratch.save(marked.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    # A pair is looked at where it first meets: rows know their document's last few such n-grams before this one.
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(-LOOK_BACK, -1)
    mixed = scratch.save(marked.join(counted, "key").join(about.select("id", "bits"), "id").withColumn("before", F.collect_list("key").over(before)))
    scratch.drop(marked, counted, prefixes)
    few = mixed.where("label <> most").select("key", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "pos", "bits", "label", "before")])
    short = lambda p: F.col(f"{p}pos") < F.col(f"{p}n") - F.ceil(F.col(f"{p}n") * (2 * num) / (num + den)) + 1
    smaller_x = F.struct("x_n", "x_id") < F.struct("n", "id")
    second = (
        mixed.join(few, "key")
        .where((F.col("label") != F.col("x_label")) & ((F.col("label") == F.col("most")) | (F.col("x_id") < F.col("id"))))
        .where(F.when(smaller_x, short("x_")).otherwise(short("")))
        .where(_possible("", "x_", num, den) & _near("", "x_", num, den) & ~F.arrays_overlap("before", "x_before"))
        .select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b"))
    )
    apart = scratch.save(second.distinct())
    rest = scratch.save(apart.join(tried, ["a", "b"], "left_anti"))
    scratch.drop(mixed, apart, tried)
    links = links.unionByName(_verify(docs, rest, n, num, den, scratch))
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    known = scratch.save(classes.join(comp, F.col("rep") == F.col("id"), "left").select("sig", F.coalesce("component", "rep").alias("component_id")))
    scratch.drop(rest)
    return rows.join(known, "sig", "left").select("id", "mark", "n", F.coalesce("component_id", "id").alias("component_id"))
