"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of K units is chosen if the least hash of its inner S-mers lies at its first or last place.
That depends on the k-mer alone, so an edit elsewhere never changes which k-mers of a passage are
chosen: they are context-free anchors. Units are words, and the characters of words over LONG characters
(scripts without blanks), whatever the text's length.
The fingerprint, a summary, is the SIZE least hashes of the distinct chosen k-mers (32 bits each, as hex digits),
and the likeness of two fingerprints estimates the Jaccard similarity of the chosen sets. All anchors with their
places are in anchor_table; passages matches two such tables by position: anchors that both texts have at the same distance
from each other are one shared passage, however long the texts are.

Semantics: null text is empty; texts with fewer than K units have their whole unit sequence as the one
k-mer; long texts are read whole; the fingerprint of a text without units is ''; two empty fingerprints
have likeness 1, one gives 0; equal texts have equal fingerprints; rows that repeat an id share a next
document, and where the next id repeats, its least head counts; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

K, S, SIZE, LONG = 4, 2, 64, 24


def _chosen(text: Column, value) -> Column:
    """value(place, 64-bit hash) of every chosen k-mer of a text, in order; places count units."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1), lambda w: w != "")
    letters = lambda w: F.filter(F.split(w, "", -1), lambda c: c != "")
    units = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, letters(w)).otherwise(F.array(w))))
    hashes = F.transform(units, lambda w: F.xxhash64(w))

    def choose(u: Column) -> Column:
        n = F.size(u)
        inner = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(S)]))
        width = K - S  # of the places of inner S-mers, less one

        def mers(s: Column) -> Column:
            def pick(h: Column, i: Column) -> Column:
                last = F.get(s, i + width)
                least = F.array_min(F.slice(s, i + 1, width + 1))
                whole = F.xxhash64(*[F.get(s, i + j) for j in range(0, K, S)])
                return F.when(last.isNotNull() & ((h == least) | (last == least)), value(i, whole))

            return F.filter(F.transform(s, pick), lambda x: x.isNotNull())

        many = F.element_at(F.transform(F.array(inner), mers), 1)
        return F.when(n >= K, many).when(n > 0, F.array(value(F.lit(0), F.xxhash64(u)))).otherwise(F.filter(F.array(value(F.lit(0), F.lit(0).cast("long"))), lambda x: F.lit(False)))

    return F.element_at(F.transform(F.array(hashes), choose), 1)  # computed once, bound by the lambda


def anchors(text: Column) -> Column:
    """The sorted array of the SIZE least distinct closed-syncmer hashes, 32 bits each."""
    return F.slice(F.sort_array(F.array_distinct(_chosen(text, lambda i, h: F.shiftrightunsigned(h, 32)))), 1, SIZE)


def anchor_table(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, place, anchor: every chosen k-mer of every row, 64 bits each, with the number of its first unit. A null text is empty and has none."""
    found = _chosen(F.coalesce(F.col(text), F.lit("")), lambda i, h: F.struct(i.cast("int").alias("place"), h.alias("anchor")))
    return documents.select(F.col(key), F.explode(found).alias("_a")).select(key, "_a.place", "_a.anchor")


def passages(left: DataFrame, right: DataFrame, least: int = 3, key: str = "doc_id") -> DataFrame:
    """left_<key>, right_<key>, distance, matches, first, last: for each pair of rows of two anchor tables and each distance between
    places, how many anchors match there, if at least ``least``, and the places of the first and last in the left row.
    Tables meet by anchor, so this is for a table against a smaller one (a benchmark, a list of passages): a row for each common anchor."""
    both = left.select(F.col(key).alias(f"left_{key}"), F.col("place").alias("_l"), "anchor").join(right.select(F.col(key).alias(f"right_{key}"), F.col("place").alias("_r"), "anchor"), "anchor")
    runs = both.groupBy(f"left_{key}", f"right_{key}", (F.col("_r") - F.col("_l")).alias("distance")).agg(F.count("*").alias("matches"), F.min("_l").alias("first"), F.max("_l").alias("last"))
    return runs.where(F.col("matches") >= least)


def as_text(anchor_array: Column) -> Column:
    return F.array_join(F.transform(anchor_array, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the SIZE least hashes of both that are in both, 0 to 1."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, next, most) for each distinct id: the next greater id, after the last the first, and the longest
    head any of its rows needs. Range partitions are ordered on their own; only their first ids,
    one a partition, reach the driver."""
    ids = docs.where("d is not null").groupBy("d").agg(F.max(F.floor(F.length("t") / 4)).alias("most"))
    ordered = scratch.save(ids.repartitionByRange("d").withColumn("pid", F.spark_partition_id()))
    firsts = sorted((x["f"], x["pid"]) for x in ordered.groupBy("pid").agg(F.min("d").alias("f")).collect())
    border = [(p, firsts[(i + 1) % len(firsts)][0]) for i, (_, p) in enumerate(firsts)]
    after = docs.sparkSession.createDataFrame(border or [(-1, 0)], "pid int, border long")
    lead = F.lead("d").over(Window.partitionBy("pid").orderBy("d"))
    return scratch.save(ordered.withColumn("next", lead).join(F.broadcast(after), "pid").select("d", F.coalesce("next", "border").alias("next"), "most"))


def fingerprints(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    scratch = Scratch(documents.sparkSession, "fingerprints")
    docs = documents.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    nxt = successors(docs, scratch)
    heads = (
        docs.where("d is not null").join(nxt.select(F.col("d").alias("of"), F.col("next").alias("d"), "most"), "d")
        .select(F.col("of").alias("d"), F.substring(F.col("t"), F.lit(1), F.col("most").cast("int")).alias("head"))
        .groupBy("d").agg(F.min("head").alias("head"))
    )
    # Both joins with the texts read the same exchange: rows without an id, which have no next, go beside it.
    both = docs.where("d is not null").join(heads, "d").unionByName(docs.where("d is null").withColumn("head", F.lit(None).cast("string")))
    n = F.length("t")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - part), F.substring(F.coalesce("head", F.lit("")), F.lit(1), part))
    made = scratch.save(
        both.withColumn("edited", edited)
        .select("d", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("t")).alias("a"), anchors(F.col("edited")).alias("e"))
    )
    following = made.select(F.col("d").alias("next"), F.col("a").alias("b")).groupBy("next").agg(F.min("b").alias("b"))
    return (
        made.join(nxt.select("d", "next"), "d", "left").join(following, "next", "left")
        .select(
            F.col("d").alias(key), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
            likeness(F.col("a"), F.col("e")).alias("near_edited"),
            likeness(F.col("a"), F.coalesce("b", F.array().cast("array<bigint>"))).alias("near_next"),
        )
    )
