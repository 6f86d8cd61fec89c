"""Twenty-three stylometric features as one struct of doubles, worked out on Arrow batches of texts by whole arrays of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

#: What counts as a word.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
#: The function words counted by function_word_ratio.
FUNCTION_WORDS = (
    "a an and are as at be by for from has have he her him his i in is it its me my nor not of on or our "
    "she so that the their them they this to us was we were with you your"
).split()
PER_100 = {"newline_per_100_words": "\n", "semicolon_per_100_words": ";", "colon_per_100_words": ":", "hyphen_per_100_words": "-", "comma_per_100_words": ",", "exclamation_per_100_words": "!", "question_per_100_words": "?"}
#: The features, in order.
NAMES = [
    "word_count", "sentence_count", "sentence_length_mean", "sentence_length_std", "sentence_length_skew", "paragraph_count", "paragraph_length_std", "type_token_ratio",
    "hapax_rate", "word_length_mean", "word_length_std", "repeated_token_rate", "contraction_rate", "function_word_ratio", *PER_100, "character_entropy_mean", "character_entropy_std",
]


#: Characters that are worked on at once, one text at least.
SLICE = 1 << 18
_SPACE = np.array([*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_FUNCTION_WORDS = frozenset(w.encode() for w in FUNCTION_WORDS)


def _spread(total: np.ndarray, row: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and population deviation of the values x of each row, both 0 without values, and the sums of the third powers of deviations."""
    mean = np.bincount(row, x, total) / np.maximum(n, 1)
    off = x - mean[row]
    return mean, np.where(n < 2, 0.0, np.sqrt(np.bincount(row, off * off, total) / np.maximum(n, 1))), np.bincount(row, off**3, total)


def _parts(total: int, row: np.ndarray, cut: np.ndarray, solid: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and words of the parts that cuts (the characters that end a part) leave, of those that hold a solid character."""
    edge = cut.copy()
    edge[1:] |= row[1:] != row[:-1]  # a first character starts a part as one behind a cut does
    part = np.cumsum(edge)
    count = int(part[-1]) + 1 if len(part) else 0
    holds = np.bincount(part[solid & ~cut], minlength=count) > 0
    of = np.zeros(count, np.int64)
    of[part] = row
    return of[holds], np.bincount(part[word], minlength=count)[holds].astype(float)


def _measure(texts: list[str]) -> np.ndarray:
    """One row of NAMES a text."""
    total = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(total), size)
    at = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    inner = np.concatenate([row[1:] == row[:-1], [False]])[: len(c)]  # the next character is of the same text
    letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
    # A word: letters, and an apostrophe with letters once; what follows a second apostrophe is a word of its own.
    before = np.concatenate([[False], letter[:-1] & inner[:-1]])[: len(c)]
    after = np.concatenate([letter[1:], [False]])[: len(c)] & inner
    link = (c == 39) & before & after
    begin = np.flatnonzero(letter & ~before)
    end = np.flatnonzero(letter & ~after) + 1  # of runs of letters
    if len(begin):
        joined = np.concatenate([[False], link[end[:-1]] & (begin[1:] == end[:-1] + 1)])  # to the run before
        first = np.flatnonzero(~joined)
        place = np.arange(len(begin)) - np.repeat(first, np.diff(np.append(first, len(begin))))
        starts = np.flatnonzero(place % 2 == 0)
        last = np.append(starts[1:], len(begin)) - 1
        start, stop, quoted = begin[starts], end[last], last > starts
    else:
        start, stop, quoted = begin, end, np.zeros(0, bool)
    who, long = row[start], (stop - start).astype(float)
    n = np.bincount(who, minlength=total).astype(float)
    d = np.maximum(n, 1.0)
    # Words by their number among the slice's distinct ones.
    low = np.where(letter, c | 32, c).astype(np.uint32)
    raw = np.where(low < 128, low, 0).astype(np.uint8)
    bound = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    chars = raw[np.arange(bound[-1]) + np.repeat(start - bound[:-1], stop - start)]
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bound), pa.py_buffer(np.ascontiguousarray(chars))]).dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    pairs, times = np.unique(who * max(1, len(words)) + code, return_counts=True)
    types, hapax = (np.bincount(x // max(1, len(words)), minlength=total) for x in (pairs, pairs[times == 1]))
    common = np.array([w in _FUNCTION_WORDS for w in words], bool)
    is_start = np.zeros(len(c), bool)
    is_start[start] = True
    solid = ~np.isin(c, _SPACE)

    # A sentence ends at runs of its marks: all of them are cuts, and parts without solid characters go.
    of, length = _parts(total, row, (c == 46) | (c == 33) | (c == 63), solid, is_start)
    sentences = np.bincount(of, minlength=total).astype(float)
    s_mean, s_std, s_third = _spread(total, of, length, sentences)
    # A paragraph ends where the white space between solid characters holds two newlines.
    lines = np.cumsum(c == 10)
    marks = np.flatnonzero(solid)
    gap = np.zeros(len(c), bool)
    if len(marks) > 1:
        gap[marks[1:][lines[marks[1:]] - lines[marks[:-1]] >= 2]] = True
    edge = np.cumsum(gap | np.concatenate([[True], ~inner[:-1]])[: len(c)])
    of_solid, part = row[marks], edge[marks]
    heads = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (of_solid[1:] != of_solid[:-1])]))[: len(marks)]
    p_row = of_solid[heads]
    held = np.bincount(edge[start], minlength=(edge[-1] + 1) if len(edge) else 1)
    p_count = np.bincount(p_row, minlength=total).astype(float)
    _, p_std, _ = _spread(total, p_row, held[part[heads]].astype(float), p_count)
    w_mean, w_std, _ = _spread(total, who, long, n)
    # Entropy of windows of 128 characters.
    windows = np.maximum(1, -(-size // 128))
    window = np.repeat(np.cumsum(windows) - windows, size) + at // 128
    seen = np.sort(window.astype(np.int64) << 21 | c)
    heads = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))[: len(seen)]
    k = np.diff(np.append(heads, len(seen))).astype(float)
    filled = np.bincount(window, minlength=int(windows.sum())).astype(float)
    e = np.where(filled > 0, np.log2(np.maximum(filled, 1)) - np.bincount(seen[heads] >> 21, k * np.log2(k), int(windows.sum())) / np.maximum(filled, 1), 0.0)
    e_mean, e_std, _ = _spread(total, np.repeat(np.arange(total), windows), e, windows.astype(float))
    skew = np.where(s_std == 0, 0.0, s_third / np.where(s_std == 0, 1.0, s_std) ** 3 / np.maximum(sentences, 1))
    marks = [100.0 * np.bincount(row[c == ord(x)], minlength=total) / d for x in PER_100.values()]
    return np.stack([
        n, sentences, s_mean, s_std, skew, p_count, p_std, types / d, hapax / d, w_mean, w_std, 1 - types / d,
        np.bincount(who[quoted], minlength=total) / d, np.bincount(who[common[code]], minlength=total) / d, *marks, e_mean, e_std,
    ], axis=1)


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64))])
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, side="right")) - 1)
        yield _measure([t or "" for t in texts.slice(a, z - a).to_pylist()])
        a = z


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES]))
def _features(texts: pa.Array) -> pa.Array:
    m = np.concatenate([*_rows(texts), np.zeros((0, len(NAMES)))])
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m[:, i])) for i in range(len(NAMES))], NAMES)


def features(text: Column) -> Column:
    """A struct of the features in NAMES, all doubles; null text counts as empty."""
    return _features(text)
