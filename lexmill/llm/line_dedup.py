"""Line deduplication by window fingerprints of line hashes, in DataFrame functions only.

A text is cut after every newline and every sentence end followed by a blank; the pieces, put together
again, are the text. A line's size is its characters without blanks at its ends, plus one. dedup_lines
deletes every run of lines of a size of at least MIN_CHARS that stands earlier in (doc_id, text hash,
line) order, in any document or in the same one. It is complete: a run is found wherever else its lines
stand, too, and however short or common they are.

Fingerprints are the windows of line hashes that begin, or end, with a line and are the least to reach
MIN_CHARS, hashed as wholes. As in winnowing, every run of that size holds one at least, chosen by its own
lines alone; but no minimum of a few line hashes stands for a window, since it would be shared with other,
shorter runs, whose earliest place hides the others. Both kinds of windows together reach to a run's ends,
which is the extension both ways. So a fingerprint needs its earliest occurrence only: one partial
aggregate finds it, one join of positions the later ones, whose lines go. First occurrences stay, but for repeats that overlap
themselves: of five equal lines of 75 characters in a row, a run of two stands again one line on, so only the first line stays.

Semantics: lines are equal if they agree but for blanks at their ends; blank lines alone are no run;
null text stays null, empty text empty, rows without an id stay as they are; rows that repeat an id with
other texts are documents of their own, in the order of their text hashes; rows that repeat both id and
text are one document and are treated alike; long texts are read whole, at a cost in proportion to
their length; extra columns are kept; an empty table gives an empty result. Lines and windows are told
by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

MIN_CHARS = 150
_MARK = "\x01"
_BLOCK = 32


def lines(text: Column) -> Column:
    """The lines of a text, ends included."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    odd = F.split(text, "(?<=\n)|(?<=[.!?] )", -1)
    return F.when(F.contains(text, F.lit(_MARK)), odd).otherwise(F.split(marked, _MARK, -1))


def _cores(text: Column) -> Column:
    """The lines of a text without the blanks at their ends."""
    marked = F.replace(text, F.lit("\n"), F.lit(_MARK))
    for end in (".", "!", "?"):
        marked = F.replace(marked, F.lit(end + " "), F.lit(end + _MARK))
    odd = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\t"))
    slow = F.transform(lines(text), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.when(odd, slow).otherwise(F.transform(F.split(marked, _MARK, -1), lambda x: F.trim(x)))


def _running(sizes: Column) -> Column:
    """0 and the running sums of sizes, in blocks, so that the cost stays in proportion to their number."""
    last = lambda a: F.element_at(a, -1)
    sums = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.array_append(a, last(a) + x))

    def joined(blocks: Column) -> Column:
        before = sums(F.transform(blocks, last))
        shift = lambda offsets: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 2, _BLOCK), lambda x: x + F.get(offsets, i))))
        return F.concat(F.array(F.lit(0)), F.element_at(F.transform(F.array(before), shift), 1))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda i: sums(F.slice(sizes, i * _BLOCK + 1, _BLOCK)))
    many = F.element_at(F.transform(F.array(blocks), joined), 1)
    return F.when(F.size(sizes) <= _BLOCK, sums(sizes)).otherwise(many)


def _windows(base: DataFrame, least: int) -> DataFrame:
    """d, k, key, pos, n of the fingerprints of each text: the least windows that begin with a line, and those that end
    with one. One row a line in generated code, where the arrays are only looked into."""
    c, i = (lambda at: F.get("c", at)), F.col("i")
    at = base.select("d", "k", "hs", "c", F.explode(F.sequence(F.lit(0), F.size("hs") - 1)).alias("i"))
    at = at.withColumns({"on": F.lit(0), "back": F.lit(0)})
    for b in reversed(range(least.bit_length())):  # lines from here on, and back from here, that stay under least
        on, back = F.col("on") + (1 << b), F.col("back") + (1 << b)
        at = at.withColumns({
            "on": F.when(c(i + on) - c(i) < least, on).otherwise(F.col("on")),
            "back": F.when((back <= i) & (c(i + 1) - c(F.greatest(i + 1 - back, F.lit(0))) < least), back).otherwise(F.col("back")),
        })
    first = i - F.col("back")
    # So many lines would all be blank. A window that begins and ends with its line is told once.
    begins = F.when((F.col("on") + 1 < least) & (i + F.col("on") < F.size("hs")), F.struct(i.alias("pos"), (F.col("on") + 1).alias("n")))
    ends = F.when((F.col("back") + 1 < least) & (c(i + 1) - c(first) >= least) & (c(i) - c(first) >= least), F.struct(first.alias("pos"), (F.col("back") + 1).alias("n")))
    some = at.select("d", "k", "hs", F.inline(F.array(begins, ends))).where("n is not null")
    return some.select("d", "k", F.xxhash64(F.slice("hs", F.col("pos") + 1, F.col("n"))).alias("key"), "pos", "n")


def _merged(ranges: Column) -> Column:
    """Sorted [first, last] ranges, those that overlap or touch as one."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(None).cast("struct<first:int,last:int>").alias("open"), empty.alias("out"))

    def step(s: Column, r: Column) -> Column:
        o = s["open"]
        meets = r["first"] <= o["last"] + 1
        grown = F.struct(o["first"].alias("first"), F.greatest(o["last"], r["last"]).alias("last"))
        return F.struct(F.when(meets, grown).otherwise(r).alias("open"), F.when(meets | o.isNull(), s["out"]).otherwise(F.array_append(s["out"], o)).alias("out"))

    return F.aggregate(ranges, start, step, lambda s: F.array_append(s["out"], s["open"]))


def _kept(all_lines: Column, removed: Column) -> Column:
    """The lines outside sorted, disjoint ranges."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1)["last"] + 1)
    end = lambda i: F.coalesce(F.get(removed, i)["first"], F.size(all_lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.slice(all_lines, start(i) + 1, end(i) - start(i))))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of documents, all their columns, with every run that stands earlier cut out of ``text``; plus (in place
    of an extra column of that name) ``_removed``: the removed line numbers as an array of [first, last], null where nothing went."""
    scratch = Scratch(documents.sparkSession, "lines")
    known = documents.where(F.col(key).isNotNull() & (F.length(text) >= min_chars - 1))
    cores = known.select(F.col(key).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("k"), _cores(F.col(text)).alias("x"))
    measured = cores.select("d", "k", F.transform("x", lambda x: F.xxhash64(x)).alias("hs"), F.transform("x", lambda x: F.length(x) + 1).alias("ln"))
    base = scratch.save(measured.select("d", "k", "hs", _running(F.col("ln")).alias("c")))
    windows = _windows(base, min_chars)
    where = F.struct("d", "k", "pos")
    # Written, so that both sides of the join are plain exchanges, of which skewed partitions can be split.
    first = scratch.save(windows.groupBy("key").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo < hi").select("key", "lo"))
    later = windows.join(first, "key").where(where > F.col("lo"))
    ranges = F.collect_set(F.struct(F.col("pos").alias("first"), (F.col("pos") + F.col("n") - 1).alias("last")))
    gone = scratch.save(later.groupBy("d", "k").agg(ranges.alias("r")).select("d", "k", _merged(F.array_sort("r")).alias("_removed")))
    return _cut(documents, gone, text, key)


def _cut(documents: DataFrame, gone: DataFrame, text: str, key: str) -> DataFrame:
    """documents without the lines that ``gone`` (d, k, _removed) names."""
    gone = gone.select(F.col("d").alias("__lexmill_d"), F.col("k").alias("__lexmill_k"), "_removed")
    same = (documents[key] == gone["__lexmill_d"]) & (F.xxhash64(F.col(text)) == gone["__lexmill_k"])
    # The same plan at every size: texts are shuffled once, whatever the share of documents that change.
    joined = documents.drop("_removed").join(gone.hint("merge"), same, "left")
    left = F.element_at(F.transform(F.array(lines(F.col(text))), lambda all_: _kept(all_, F.col("_removed"))), 1)
    kept = [c for c in documents.columns if c != "_removed"]
    return joined.withColumn(text, F.when(F.col("_removed").isNull(), F.col(text)).otherwise(F.array_join(left, ""))).select(*kept, "_removed")
