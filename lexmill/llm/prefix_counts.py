"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has a local test: a sequence of tokens is the encoding of its text if and only if
every two neighbours encode their own concatenation. So the encoding of a prefix ends in the one
token t for which (last token of the prefix before t, t) passes that test, and

    count[j] = count[j - len(t)] + 1

gives the count at every prefix in one pass, without re-encoding. The pass runs over many distinct
words at once in numpy; pretokens never share tokens, so a text's count at a prefix is the sum over
its whole pretokens plus the count inside the last, cut one.

prefix_table stores, for each text, the counts at all its prefixes as differences, two bytes a character; count_at and fit_at answer from
that table alone, for any prefix or budget, what token_counts answers for one. Where a prefix splits otherwise than the text (inside a special
string, 're, 've or 'll, or where normalization joins characters) the pretokens of the prefix itself are counted.

Semantics: null text counts as empty (0 tokens); repeated rows each get a row; extra columns are
ignored; special strings inside texts count one token, as the library does by default; long texts are counted
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE, SPACE, map_batches, mix, powers, slices

#: Stands for a special string among pretokens; no pretoken holds a blank.
SPECIAL = " special"
#: Characters for which Python's own classes and lower() agree with the library's; other texts are
#: split by the library's normalizer and pre-tokenizer.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÿ]*")
CHUNK = re.compile(r"[^\x09-\x0d ]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table:
    """uint64 keys to int32 values by open addressing, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.shift, self.mask, self.probes = np.uint64(64 - self.bits), (1 << self.bits) - 1, 1
        for k, v, at in zip(keys.tolist(), values.tolist(), (keys >> self.shift).tolist(), strict=True):
            n = 1
            while self.values[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            self.keys[at], self.values[at] = k, v
            self.probes = max(self.probes, n)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at_t = at[todo] = (at[todo] + 1) & self.mask
            hit = self.keys[at_t] == keys[todo]
            out[todo[hit]] = self.values[at_t[hit]]
            todo = todo[~hit & (self.values[at_t] >= 0)]
        return out


class PrefixCounter:
    """The prefix program of one byte-level BPE vocabulary with word ends (a tokenizers .json file)."""

    def __init__(self, path: str, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        self.suffix = suffix
        n = max(vocab.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        pairs, merged = [], []
        floor = n - len(spec["model"]["merges"])
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            c = vocab[a + b]
            if c != floor + i:
                raise ValueError("merges are expected in the order of their ids")
            self.left[c], self.right[c] = vocab[a], vocab[b]
            pairs.append((vocab[a] << 20) | vocab[b])
            merged.append(c)
        self.pairs = _Table(mix(np.array(pairs, np.uint64)), np.array(merged, np.int64))
        words, ids, ends = [], [], []
        for s, i in vocab.items():
            end = bool(suffix) and s.endswith(suffix) and len(s) > len(suffix)
            words.append(bytes(self.letters[c] for c in (s[: -len(suffix)] if end else s)))
            ids.append(i)
            ends.append(end)
        self.longest = max(map(len, words))
        h = self._hash(words)
        ends_a, ids_a = np.array(ends), np.array(ids)
        self.inner = _Table(h[~ends_a], ids_a[~ends_a])
        self.final = _Table(h[ends_a], ids_a[ends_a]) if suffix else self.inner
        self.cache_size, self.cache = cache, {SPECIAL: 1}
        self.inner_size, self.folded = cache // 2, {}
        self._forget()

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(w) for w in words])
        end = np.cumsum(n)
        p, inv = powers(len(raw) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * p[: len(raw)], dtype=np.uint64)])
        return mix((run[end] - run[end - n]) * inv[end - n] + n.astype(np.uint64))

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its own concatenation: merges are undone from
        the later one on, and none may have crossed the border between a and b."""
        ok = np.ones(len(a), bool)
        todo, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        while len(todo):
            c = self.pairs.get(mix((a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)))
            bad = (c >= 0) & (c < limit)
            ok[todo[bad]] = False
            first = a > b
            ra, lb = self.right[a], self.left[b]
            whole_a, whole_b = ra == a, lb == b
            undo_a = np.where(first, ~whole_a, whole_b & ~whole_a)
            undo_b = np.where(first, whole_a & ~whole_b, ~whole_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, ra, a), np.where(undo_b, lb, b)
            keep = ~bad & (undo_a | undo_b)
            todo, a, b, limit = todo[keep], a[keep], b[keep], limit[keep]
        return ok

    def prefixes(self, words: list[bytes], every: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Counts of whole words at each prefix length, in one flat array, and the words' offsets in it:
        entry off[i] + j - 1 is the count of the first j bytes of word i, taken as a word of its own.
        every=False fills the last entry of each word only."""
        n = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-n, kind="stable")
        raw = np.frombuffer(b"".join(words), np.uint8)
        off = np.concatenate([[0], np.cumsum(n)])
        p, inv = powers(len(raw) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * p[: len(raw)], dtype=np.uint64)])
        start, length = off[:-1][order], n[order]
        last = np.full(len(raw), -1, np.int32)  # token that ends the encoding of each inner prefix
        count = np.zeros(len(raw), np.int32)
        out = np.zeros(len(raw), np.int32)
        active = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(n) else 0) + 1), side="right")
        for j, k in enumerate(active.tolist(), 1):
            for final in (False, True):
                who = np.arange(k)
                if final and not every:
                    who = who[length[:k] == j]
                if not final and self.suffix and not every:
                    who = who[length[:k] > j]
                for size in range(min(j, self.longest), 0, -1):
                    if not len(who):
                        break
                    s = start[who]
                    at = s + (j - size)
                    key = mix((run[s + j] - run[at]) * inv[at] + np.uint64(size))
                    token = (self.final if final else self.inner).get(key)
                    hit = token >= 0
                    if size < j:
                        where = np.flatnonzero(hit)
                        hit[where] = self.valid(last[at[where] - 1], token[where])
                        before = count[at - 1]
                    else:
                        before = np.zeros(len(who), np.int32)
                    done = s[hit] + j - 1
                    if final:
                        out[done] = before[hit] + 1
                    else:
                        last[done], count[done] = token[hit], before[hit] + 1
                    who = who[~hit]
        return out, off

    def pretokens(self, text: str) -> list[str]:
        """The pretokens of a text without special strings, in order."""
        if PLAIN.fullmatch(text):
            return SPLIT.findall(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in s).decode("utf-8", "surrogateescape") for s, _ in found]

    def pieces(self, text: str) -> list[str]:
        """Pretokens of a whole text, in order; a special string is one, marked."""
        if not any(s in text for s in self.special):
            return self.pretokens(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self.pretokens(text[at : m.start()])
            out.append(SPECIAL)
            at = m.end()
        return out + self.pretokens(text[at:])

    def learn(self, words: set[str]) -> None:
        """Puts the counts of words not yet known into the bounded cache."""
        new = words - self.cache.keys()
        if len(self.cache) + len(new) > self.cache_size:
            self.cache = {SPECIAL: 1}
            new = words - {SPECIAL}
        if new:
            new = list(new)
            out, off = self.prefixes([w.encode("utf-8", "surrogateescape") for w in new], every=False)
            self.cache.update(zip(new, out[off[1:] - 1].tolist(), strict=True))

    def count(self, text: str) -> int:
        """The count of one short text."""
        words = self.pieces(text)
        self.learn(set(words))
        return sum(map(self.cache.__getitem__, words))

    def _forget(self) -> None:
        """Inner counts: a word's number, and by number where its counts begin in the pool and how many they are."""
        self.number, self.pool, self.first, self.size = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn_inner(self, words: set[str]) -> None:
        """Puts the counts at each character of words not yet known into the bounded pool."""
        new = words - self.number.keys()
        if len(self.number) + len(new) > self.inner_size:
            self._forget()
            new = words
        if not new:
            return
        new = list(new)
        blobs = [w.encode() for w in new]
        out, off = self.prefixes(blobs)
        raw = np.frombuffer(b"".join(blobs), np.uint8)
        ends = np.append((raw[1:] & 0xC0) != 0x80, True)  # the last byte of each character
        size = np.fromiter(map(len, new), np.int64, len(new))
        first = len(self.pool) + np.cumsum(size) - size
        self.pool, self.first, self.size = np.concatenate([self.pool, out[ends]]), np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
        for w in {"'re", "'ve", "'ll"}.intersection(new):  # cut after the second character they are two pretokens
            at = self.first[self.number[w]]
            self.pool[at + 1] = self.pool[at] + self.count(w[1])

    def inner_counts(self, word: str) -> np.ndarray:
        i = self.number[word]
        return self.pool[self.first[i] : self.first[i] + self.size[i]]

    def _fold(self, text: str) -> str | None:
        """The normalized text, if normalization takes it character by character to as many; else None."""
        for ch in set(text) - self.folded.keys():
            self.folded[ch] = self.library.normalizer.normalize_str(ch) if not ch.isspace() else ""
        out = [self.folded[ch] for ch in text]
        whole = "".join(out)
        return whole if all(len(x) == 1 for x in out) and self.library.normalizer.normalize_str(text) == whole else None

    def spans(self, text: str) -> list[tuple[int, str | np.ndarray]]:
        """(first character, word) of the pretokens of a text in order, or (first character, counts at each of its characters)
        where prefixes split otherwise."""
        out: list[tuple[int, str | np.ndarray]] = []
        for m in CHUNK.finditer(text):
            chunk, at = m[0], m.start()
            if any(x in chunk for x in self.special) or not PLAIN.fullmatch(chunk) and self._fold(chunk) is None:
                out.append((at, np.array([self.count(chunk[:j]) for j in range(1, len(chunk) + 1)], np.int32)))
            elif PLAIN.fullmatch(chunk):
                out += [(at + w.start(), w[0]) for w in SPLIT.finditer(chunk.lower())]
            else:
                for s, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(self._fold(chunk)):
                    out.append((at + a, bytes(self.letters[c] for c in s).decode()))
        return out

    def _table(self, text: str) -> np.ndarray:
        spans = self.spans(text)
        self.learn_inner({w for _, w in spans if isinstance(w, str)})
        table, before = np.zeros(len(text), np.int32), 0
        for i, (a, w) in enumerate(spans):
            inner = self.inner_counts(w) if isinstance(w, str) else w
            end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
            table[a : a + len(inner)] = before + inner
            before += int(inner[-1])
            table[a + len(inner) : end] = before  # between words the count stays
        return table

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts at all its prefixes: entry j - 1 is that of the first j characters. Plain texts go
        through numpy together: all characters but blanks belong to their words, in order."""
        plain = [bool(PLAIN.fullmatch(t)) and not any(x in t for x in self.special) for t in texts]
        own = [t for t, p in zip(texts, plain, strict=True) if p]
        split = [SPLIT.findall(t.lower()) for t in own]
        self.learn_inner(set().union(*split))
        words = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((i for s in split for i in map(self.number.__getitem__, s)), np.int64, int(words.sum()))
        size, first = self.size[ids], self.first[ids]
        flat = self.pool[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        whole = self.pool[first + size - 1].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(whole)])
        began = np.concatenate([[0], np.cumsum(words)])
        flat = flat + np.repeat(before[:-1] - np.repeat(before[began[:-1]], words), size)
        raw = np.frombuffer("".join(own).encode("latin-1"), np.uint8)
        chars = np.fromiter(map(len, own), np.int64, len(own))
        where = np.zeros(len(raw), np.int64)
        where[np.flatnonzero(~SPACE[raw])] = np.arange(1, len(flat) + 1)
        where = np.maximum.accumulate(where)  # between words the count stays
        lead = np.concatenate([[0], np.cumsum(size)])[began[:-1]]
        table = np.where(where > np.repeat(lead, chars), np.concatenate([[0], flat])[where], 0).astype(np.int32)
        parts = iter(np.split(table, np.cumsum(chars)[:-1])) if own else iter(())
        return [next(parts) if p else self._table(t) for t, p in zip(texts, plain, strict=True)]

    def count_prefix(self, text: str, chars: int) -> int:
        """The exact count of text[:chars], from the prefix table of its cut pretoken."""
        words = self.pieces(text[:chars])
        plain = [w.encode("utf-8", "surrogateescape") for w in words if w is not SPECIAL]
        if not plain:
            return len(words)
        table, off = self.prefixes(plain)
        return int(table[off[1:] - 1].sum()) + len(words) - len(plain)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_at(table: np.ndarray, chars: int) -> int:
    """The count of the first ``chars`` characters."""
    return int(table[min(chars, len(table)) - 1]) if chars > 0 and len(table) else 0


def fit_at(table: np.ndarray, limit: int) -> tuple[int, int]:
    """The longest prefix of at most ``limit`` tokens, in characters, and its count."""
    fits = np.flatnonzero(table <= limit)
    return (int(fits[-1]) + 1, int(table[fits[-1]])) if len(fits) else (0, 0)


def unpack(deltas: bytes) -> np.ndarray:
    """The counts that prefix_table stored."""
    return np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)


def prefix_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, deltas: the stored table of every row of docs, for unpack(). One narrow pass."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for at, k in slices(batch.column(1), 1024, 1 << 21):
            found = c.tables([t or "" for t in batch.column(1).slice(at, k).to_pylist()])
            blobs = [np.diff(t, prepend=0).astype("<i2").tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k), pa.array([len(t) for t in found], pa.int64()), pa.array(blobs, pa.binary())], names=[key, "n_chars", "deltas"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    return docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")).mapInArrow(each, f"{key} long, n_chars long, deltas binary")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens for every row of docs.

    n_tokens is the library's count of the whole text, the last entry of its prefix table; fit_chars and fit_tokens answer the budget
    question from the same table: the longest prefix that fits in ``limit`` tokens, to the character. One narrow pass, no
    shuffle; memory is a slice of rows with their tables and the bounded caches of words.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        out, size = [], []
        for at, k in slices(batch.column(1), 1024, 1 << 21):
            texts = [t or "" for t in batch.column(1).slice(at, k).to_pylist()]
            size += [len(t.encode()) for t in texts]
            for t in c.tables(texts):
                n = count_at(t, len(t))
                out.append((n, *((len(t), n) if n <= limit else fit_at(t, limit))))
        n = np.array([x[0] for x in out], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            names=[key, "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens"],
        )

    src = docs.select(docs[key].cast("long").alias(key), docs[text].alias("text"))
    return map_batches(src, run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, fit_tokens long")
