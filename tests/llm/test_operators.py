"""Each operator against brute force or the library it stands for, on small and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lexmill.llm import chat_format, components, embedding_join, fingerprints, language_id, line_dedup, ngram_join, packing, prefix_counts, quality, sentencepiece_lattice
from lexmill.llm.common import Scratch, global_order

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "A long sentence about nothing that goes on. " * 3000
ODD = [
    (None, "a row without an id, but with words enough to count"), (1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, LONG), (6, LONG), (6, LONG), (7, "x" * 5000), (8, "日本語 ünï 👍🏽 <|endoftext|> </s>"),
    (9, "One."), (10, "the same words here as there and there"), (11, "The SAME words here as there and there"), (12, "a\x01b. c d! e\x00"), (13, "1 2 3 *** $$$"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns under names that operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ["d", "k", "h", "t", "u", "v", "n", "id", "rank", "label", "score", "_removed", "_pid", "rep", "sig", "word", "chunk", "lang_pred"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- shared plumbing ---------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (7, 7), (1, 2), (1, 2)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(both(components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")), "id", "component"))
    assert got == {x: find(x) for x in parent if sum(find(y) == find(x) for y in parent) > 1}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_global_order(spark):
    rows = [(i % 5, i, i % 7) for i in range(300)]
    got = both(global_order(spark.createDataFrame(rows, "a int, b int, w int"), ["a", "b"], Scratch(spark, "t"), weight="w"), "rank", "a", "b", "before")
    run, want = 0, []
    for i, (a, b, w) in enumerate(sorted(rows)):
        want.append((i, a, b, run))
        run += w
    assert got == want


# --- 1 and 8: tokens ------------------------------------------------------------------------------------------


def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("collide", [False, True])
def test_sentencepiece_words_by_hash(monkeypatch, collide):
    """Words of many texts are cut and looked up at once, and equal hashes of different words change nothing."""
    m = sentencepiece_lattice
    rng = random.Random(1)
    texts = ["", None, " ", "▁x▁", "\U0001f600 hi", "x" * 300] + ["".join(rng.choice("ab ▁éпривет日本\U0001f600\n.") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    c = m.cutter(PIECES)
    if collide:
        monkeypatch.setattr(m, "span_hashes", lambda points, borders: np.diff(borders).astype(np.uint64) % np.uint64(3))
    s, points, borders, counts = c.cut(texts)
    words = [s[i:k] for i, k in zip(borders, borders[1:], strict=False)]
    assert words == [w for t in texts if t for w in c.words(t)] and counts.tolist() == [len(c.words(t)) if t else 0 for t in texts]
    known = sorted(set(words))[::2]
    found = m.Dictionary([pa.array(known[:20]), pa.array(known[20:])]).find(points, borders).tolist()
    assert all(known[k] == w for w, k in zip(words, found, strict=True) if k >= 0)
    assert any(k >= 0 for k in found) and (collide or all((k >= 0) == (w in known) for w, k in zip(words, found, strict=True)))


def test_sentencepiece_memory_of_workers(monkeypatch):
    """Hashing many words holds little beside them, wherever blocks end; encodings leave chunk by chunk; what is freed goes back."""
    m = sentencepiece_lattice
    rng = np.random.default_rng(4)
    points = rng.integers(97, 123, 2_000_000).astype(np.uint32)
    borders = np.concatenate([[0], np.unique(rng.integers(1, len(points), 250_000)), [len(points)]])
    tracemalloc.start()
    h = m.span_hashes(points, borders)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    alone = [m.span_hashes(points[i:k], np.array([0, k - i]))[0] for i, k in zip(borders[:300], borders[1:301], strict=True)]
    assert h[:300].tolist() == alone
    monkeypatch.setattr(m, "BLOCK", 3, raising=False)
    assert m.span_hashes(points[: borders[300]], borders[:301]).tolist() == alone
    back = []
    monkeypatch.setattr(m, "give_back", lambda: back.append(1), raising=False)
    words = pa.RecordBatch.from_arrays([pa.array(["▁a", "▁the"]), pa.array([[1, 2, 3], [2]]), pa.array([0b111, 0b10001])], names=["word", "chunks", "borders"])
    assert [(b.num_rows, b.column(0).to_pylist()) for b in m._dictionaries(PIECES, iter([words]))] == [(1, [1]), (1, [2]), (1, [3])] and back == [1]


def test_sentencepiece(spark, odd, none, docs):
    sp = pieces()
    spaced = spark.createDataFrame([(1, " a"), (2, "a  b"), (3, " " * 40), (4, "▁▁a▁ b"), (5, "trail "), (6, "\t\n x")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text"), spaced):
        made = sentencepiece_lattice.encode(df, PIECES)
        want = sorted((r[0] is not None, r[0] or 0, sp.encode(r[1] or "")) for r in df.collect())
        assert sorted((r[0] is not None, r[0] or 0, r[1]) for r in made.collect()) == want
        back = sorted(r["text"] for r in sentencepiece_lattice.decode(made, PIECES).collect())
        assert back == sorted((r[1] or "").replace("▁", " ") for r in df.collect())
    assert sentencepiece_lattice.encode(odd, PIECES).columns == ["doc_id", "ids"]
    told = sentencepiece_lattice.encode(odd, PIECES, digest=True)
    assert sorted(r[2] for r in told.collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert sentencepiece_lattice.encode(none, PIECES).count() == 0


def test_viterbi_fold(spark):
    rng = random.Random(9)
    vocab = {c: -3.0 - i / 10 for i, c in enumerate("abc")} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): -rng.random() * 8 for _ in range(20)}
    table = spark.createDataFrame([(p, i, s, 0) for i, (p, s) in enumerate(vocab.items())], "piece string, id int, score double, rank int")
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)} | {"axb"})
    got = {r["word"]: sentencepiece_lattice.cut(r["word"], r["borders"]) for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w, 0) for w in words], "word string, c int"), table, 4, "c", "viterbi").collect()}

    def best(w):
        if not w:
            return 0.0
        return max((vocab[w[-k:]] + best(w[:-k]) for k in range(1, min(4, len(w)) + 1) if w[-k:] in vocab), default=float("-inf"))

    for w in words:
        if w == "axb":
            assert got[w] is None
        else:
            assert "".join(got[w]) == w and sum(vocab[p] for p in got[w]) == pytest.approx(best(w))


def test_token_counts(spark, odd, none, docs):
    c = prefix_counts.counter(WORD_BPE)
    for df in (odd, docs):
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in prefix_counts.token_counts(df, WORD_BPE).collect())
        want = []
        for r in df.collect():
            t = r["text"] or ""
            n = len(c.library.encode(t, add_special_tokens=False).ids)
            want.append((r["doc_id"] or -1, len(t.encode()), n, n > 2048))
        assert got == sorted(want)
    assert prefix_counts.token_counts(none, WORD_BPE).count() == 0


def test_stored_tables_answer_any_prefix(spark, odd, none, docs):
    """Each stored count is the library's of that prefix; budgets are met to the character."""
    c = prefix_counts.counter(WORD_BPE)
    rng = random.Random(3)
    texts = ["", " ", "don't STOP!! we'll they've you're x'll'd 'rex", "日本語の文章 Ünï <|endoftext|> a<|endoftext|>b!!<|startoftext|>x", "как İstanbul ΑΣ e\u0301 a\u0327x", "hello <|endoftext|> end", "a\x1cb\u2028c\u00a0d e \x00f", "_under_score 12345 ٣٤ ² ﬁ ẞ"]
    texts += ["".join(rng.choice("aAbé'!- \n_1ß日Ωe\u0301İ<|>s't") for _ in range(40)) for _ in range(60)] + [r["text"][:120] for r in docs.limit(10).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: prefix_counts.unpack(r["deltas"]) for r in prefix_counts.prefix_table(df, WORD_BPE).collect()}
    for i, t in enumerate(texts):
        want = [len(c.library.encode(t[: j + 1], add_special_tokens=False).ids) for j in range(len(t))]
        assert got[i].tolist() == want
        assert prefix_counts.count_at(got[i], 7) == (want[min(7, len(t)) - 1] if t else 0) and prefix_counts.count_at(got[i], 0) == 0
        fits = [j + 1 for j, n in enumerate(want) if n <= 5]
        assert prefix_counts.fit_at(got[i], 5) == ((fits[-1], want[fits[-1] - 1]) if fits else (0, 0))
    assert prefix_counts.prefix_table(odd, WORD_BPE).count() == len(ODD) and prefix_counts.prefix_table(none, WORD_BPE).count() == 0
    small = prefix_counts.PrefixCounter(WORD_BPE, cache=20)  # the pool of words is emptied again and again
    assert [t[-1] for t in small.tables(texts) if len(t)] == [got[i][-1] for i, t in enumerate(texts) if t]


def test_budgets(spark):
    texts = ["hello world " * 3000 + "<|endoftext|> end", "<|endoftext|> " * 5 + "end", "a <|endoftext|> b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["fit_chars"], r["fit_tokens"]) for r in prefix_counts.token_counts(df, WORD_BPE, 4).collect()}
    assert got == {0: (6002, 24, 4), 1: (6, 56, 4), 2: (3, 17, 3), 3: (0, 0, 0)}


def test_words_of_all_scripts_are_short(docs):
    """Texts of scripts without blanks are cut, too, so that their words pass the lattice, and no cut changes the ids."""
    sp, c = pieces(), sentencepiece_lattice.cutter(PIECES)
    rng = random.Random(1)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x600), (0x4E00, 0x9FFF), (32, 33)]
    texts = ["日本語の文章はとても長いですが、単語は短い。" * 5, "Привет мир, как дела?", "مرحبا بالعالم كيف"] + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(80)) for _ in range(100)]
    for t in texts:
        words = c.words(t)
        assert [int(i) for x in sentencepiece_lattice.by_library(words, PIECES) for i in x] == sp.encode(t) and max(map(len, words)) <= sentencepiece_lattice.LONG
    held = [w for r in docs.collect() for w in c.words(r["text"])]
    assert sum(len(w) > sentencepiece_lattice.LONG for w in held) == 0


def test_every_prefix(docs):
    c = prefix_counts.counter(WORD_BPE)
    text = docs.first()["text"][:160] + " don't STOP!! 日本 <|endoftext|> Ünï"
    for i in range(len(text) + 1):
        assert c.count_prefix(text, i) == len(c.library.encode(text[:i], add_special_tokens=False).ids)
    words = [w.encode() for w in ("thereof", "aaaaaaaaaa", "zzqx", "t")]
    table, off = c.prefixes(words)
    for i, w in enumerate(words):
        assert [int(x) for x in table[off[i] : off[i + 1]]] == [len(c.library.encode(w[: j + 1].decode(), add_special_tokens=False).ids) for j in range(len(w))]


# --- 2 and 3: classifiers ---------------------------------------------------------------------------------------


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where(~quality.held_out()), labels.where(~quality.held_out()))
    told = quality.score(docs.where(quality.held_out()), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in told]) > 0.95
    got = {r["doc_id"]: r["score"] for r in quality.score(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[4] == 0 and all(0 <= s <= 1 for s in got.values())
    assert quality.score(none, model).count() == 0
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    blank = quality.fit(none, labels)
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.0, 0.5}
    messy = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (0, 0), (0, 1)], "doc_id long, quality int"))
    assert quality.fit(docs, messy, per_class=20).vectors.shape[0] <= 40


def test_votes_against_plain_formula(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit(docs, labels)
    rows = docs.limit(20).collect()
    import pyarrow as pa

    from lexmill.llm.common import text_bytes

    got = m.score(pa.array([r["text"] for r in rows]), block=7)
    for g, r in zip(got, rows, strict=True):
        counts, _ = quality.terms(*text_bytes(pa.array([r["text"]])))
        sim = (m.latent(counts) @ m.vectors.T)[0].astype(float)
        near = np.argsort(-sim)[: quality.NEIGHBOURS]
        w = np.exp(12 * (sim[near] - 1))
        assert g == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-3)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    told = language_id.identify(docs.where(language_id.held_out()), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in told]) > 0.97
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4, 13)) and got[5][0] in model.languages
    assert language_id.identify(none, model).count() == 0 and language_id.keep_known(odd, model).columns == odd.columns
    empty = language_id.fit(none.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_language_sample_of_equal_ids(spark):
    """However the ids repeat, the sample is neither empty nor unbounded."""
    for key in (None, 1, 2, 3):
        df = spark.createDataFrame([(key, f"The same words in row {i % 1000}", "en") for i in range(3000)], "doc_id long, text string, lang string")
        model = language_id.fit(df, per_language=20)
        assert model.languages == ["en"] and {r["lang_pred"] for r in language_id.identify(df, model).collect()} == {"en"}
    same = spark.createDataFrame([(1, "One text", "en")] * 3000 + [(2, "Un texte", "fr")], "doc_id long, text string, lang string")
    assert language_id.fit(same, per_language=20).languages == ["en", "fr"]


def test_pooling_over_segments():
    """A document's distribution is the mean over its positions, segment by segment, both directions from zero states."""
    rng = np.random.default_rng(2)
    net = language_id.ByteGRU(3, hidden=4)
    sizes = [0, 1, 127, 128, 129, 400]
    raw = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(x, k):
        h, out = np.zeros(4), []
        for b in x:
            a, u = net.p["X"][k][b], h @ net.p["U"][k]
            z, r = sigmoid(a[:4] + u[:4]), sigmoid(a[4:8] + u[4:8])
            h = h + z * (np.tanh(a[8:] + r * u[8:]) - h)
            out.append(h)
        return np.array(out)

    got = net.pooled(raw, off)
    for i, n in enumerate(sizes):
        total = np.zeros(3)
        for a in range(off[i], off[i] + n, language_id.SEGMENT):
            x = raw[a : min(a + language_id.SEGMENT, off[i] + n)]
            logits = run(x, 0) @ net.p["O"][0] + run(x[::-1], 1)[::-1] @ net.p["O"][1] + net.p["b"]
            total += (np.exp(logits) / np.exp(logits).sum(1, keepdims=True)).sum(0)
        assert got[i] == pytest.approx(total / max(n, 1), abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteGRU(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.arange(5)[:, None] < np.array([5, 3, 5, 1])
    _, g = net.gradients(x, mask, y)
    for k, at in (("U", (0, 1, 2)), ("U", (1, 2, 7)), ("O", (1, 0, 2)), ("b", (1,)), ("X", (0, int(x[1, 0]), 4)), ("X", (1, int(x[2, 2]), 7))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-2
        up = net.gradients(x, mask, y)[0]
        net.p[k][at] = keep - 1e-2
        down = net.gradients(x, mask, y)[0]
        net.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


# --- 4, 5, 7: near duplicates -------------------------------------------------------------------------------------


def brute_groups(rows, n=5, num=3, den=4):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def test_ngram_join(spark, docs, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert both(ngram_join.ngram_join(docs), "doc_id", "n_shingles", "component_id") == brute_groups(rows)
    got = collections.Counter((r[0], r[2]) for r in ngram_join.ngram_join(odd).collect())
    assert got[(None, None)] == 1 and got[(5, 5)] == 1 and got[(6, 5)] == 2 and got[(11, 10)] == 1 and got[(4, 4)] == 1
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_of_edited_copies(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(120):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(w[: rng.randint(50, 60)])))
    rows += [(200, "a b"), (201, "A  b"), (202, "a b c d e"), (203, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert both(ngram_join.ngram_join(df), "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def brute_runs(rows, min_chars):
    """Every run of min_chars that stands earlier, by comparing with all earlier places of each of its lines."""
    cut = lambda t: re.split(r"(?<=\n)|(?<=[.!?] )", t)
    core = {i: [x.strip(" \t\r\n") for x in cut(t)] for i, t in rows}
    places, out = collections.defaultdict(list), {}
    for i in sorted(core):
        for p, c in enumerate(core[i]):
            places[c].append((i, p))
    for i, t in rows:
        own, gone = cut(t), set()
        shifts = {(j, p - q) for p, c in enumerate(core[i]) if c for j, q in places[c] if (j, q) < (i, p)}
        for j, s in shifts:
            run = []
            for p in range(len(own) + 1):
                if p < len(own) and 0 <= p - s < len(core[j]) and core[i][p] == core[j][p - s]:
                    run.append(p)
                else:
                    if sum(len(core[i][q]) + 1 for q in run) >= min_chars:
                        gone |= set(run)
                    run = []
        out[i] = "".join(x for p, x in enumerate(own) if p not in gone)
    return out


def test_repeated_passage_is_caught(spark):
    passage = " ".join(f"shared{i}" for i in range(25)) + ". " + " ".join(f"more{i}" for i in range(30)) + ". "
    rows = [(i, f"Own words of document {i} at the start. {passage}And own words {i * 7} at its end.") for i in range(30)]
    got = removed_runs(spark, rows)
    assert passage in got[0] and all(got[i] == dict(rows)[i].replace(passage, "") for i in range(1, 30))


def test_runs_found_nowhere_else_whole(spark):
    """Each line of a run stands alone in an earlier document; the run itself in one other only. Rows of one id with
    other texts are documents of their own."""
    s = [f"Sentence {i} is of some seventy-five characters, neither fewer nor more {i}. " for i in range(4)]
    rows = [(i, x) for i, x in enumerate(s)] + [(10, "".join(s)), (11, "".join(s) + "End.")]
    assert removed_runs(spark, rows) == dict(rows) | {11: "End."}
    df = spark.createDataFrame([(7, "A. " + "".join(s)), (7, "B. " + "".join(s)), (7, "B. " + "".join(s))], "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.dedup_lines(df).collect())
    cut = [x for x in ("A. ", "B. ") if x in got]
    assert len(cut) == 1 and len(got) == 3 and got.count(cut[0]) == (1 if cut == ["A. "] else 2)


def removed_runs(spark, rows):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_runs_whose_lines_stand_alone_earlier(spark, docs):
    """Any line of a passage may stand alone in an earlier document."""
    parts = [f"Line {i} of the passage, of some seventy characters, neither less nor {i}.\n" for i in range(4)]
    rows = [(i, f"Alone in document {i}.\n{x}And more of {i}.\n") for i, x in enumerate(parts)] + [(i, f"Begin {i}.\n{''.join(parts)}End {i}.\n") for i in (10, 11)]
    assert removed_runs(spark, rows) == dict(rows) | {11: "Begin 11.\nEnd 11.\n"}


def test_runs_against_all_earlier_places(spark, docs, odd, none):
    rng = random.Random(4)
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 30)) for _ in range(k))
    pool = [words(rng.randint(1, 12)) + rng.choice([".", "!", "", "?"]) for _ in range(40)] + ["", "x" * 147, "y" * 148, "z" * 149]
    ends = ["\n", "\n", "\n", "\n", "\r\n", "   \n", "\n    "]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(150):
        start, plain = rng.randrange(36), rng.random() < 0.6
        lines = pool[start : start + rng.randint(2, 9)] + [f"own {i} line"] + [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        text = "".join(x + ("\n" if plain else rng.choice(ends)) for x in lines)
        rows.append((1000 + i, text.rstrip() if rng.random() < 0.5 else text))
    tiny = [f"w{i % 7}. " for i in range(60)]
    rows += [(2000 + i, "".join(tiny[i : i + 40]) + f"end {i}. " + "".join(tiny[3:30])) for i in range(5)]
    rows += [(3000, "".join(f"L{i}.\n" for i in range(1500))), (3001, "x. " + "".join(f"L{i}.\n" for i in range(300, 1300)) + "y."), (3002, "\tA tab before" + "z" * 140 + "\n"), (3003, "A tab before" + "z" * 140)]
    assert removed_runs(spark, rows) == brute_runs(rows, line_dedup.MIN_CHARS)
    out = line_dedup.dedup_lines(odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    texts = collections.defaultdict(list)
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[1] == [None] and texts[2] == [""] and texts[6] == ["", ""] and texts[12] == [ODD[13][1]]


@pytest.mark.parametrize("lone", range(3))
def test_runs_whose_lines_repeat_in_a_document(spark, lone):
    """Any line of a passage may stand alone too, in the copy, in the source, or between two copies of one document."""
    parts = [f"Short line {i} of a passage, of fifty or more characters.\n" for i in range(3)]
    run, x = "".join(parts), parts[lone]
    rows = [(1, f"First.\n{run}Last.\n"), (2, f"{x}Own words.\n{run}The end.\n"), (3, f"{x}Three.\n{run.upper()}{x.upper()}Between.\n{run.upper()}End three.\n")]
    assert removed_runs(spark, rows) == dict(rows) | {2: f"{x}Own words.\nThe end.\n", 3: f"{x}Three.\n{run.upper()}{x.upper()}Between.\nEnd three.\n"}
    rows = [(1, f"{x}First.\n{run}Last.\n"), (2, f"Own words.\n{run}The end.\n")]
    assert removed_runs(spark, rows) == dict(rows) | {2: "Own words.\nThe end.\n"}


def test_fingerprints(spark, docs, odd, none):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    for at, (i, t) in enumerate(rows):
        k = len(t) // 4
        edited = t[: len(t) - k] + rows[(at + 1) % len(rows)][1][:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    long = [got[i] for i, t in rows if len(t) > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.99 * len(long)
    assert fingerprints.fingerprints(none).count() == 0
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 2} == {""} and len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1


def test_fingerprints_by_definition(spark, docs):
    """Anchors and likeness by plain loops over the same hashes."""
    import struct

    import xxhash

    def whole(xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        return h

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def anchors(text):
        words = [w for w in re.split("[ \t\n\x0b\f\r]", text) if w]
        units = [xxhash.xxh64_intdigest(u.encode(), 42) for w in words for u in (w if len(w) > fingerprints.LONG else [w])]
        k, s = fingerprints.K, fingerprints.S
        if len(units) < k:
            return [whole(units) >> 32] if units else []
        inner = [whole(units[i : i + s]) for i in range(len(units) - s + 1)]
        out = set()
        for i in range(len(units) - k + 1):
            part = [signed(x) for x in inner[i : i + k - s + 1]]
            if min(part) in (part[0], part[-1]):
                out.add(whole(inner[i : i + k : s]) >> 32)
        return sorted(out)[: fingerprints.SIZE]

    def likeness(a, b):
        least = sorted(set(a) | set(b))[: fingerprints.SIZE]
        return sum(x in a and x in b for x in least) / len(least) if least else 1.0

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6, "x" * 400), (10**6 + 1, "日本語" * 40), (10**6 + 2, "a b c"), (10**6 + 3, ""), (10**6 + 4, "Short text of 178 characters " * 6), (10**6 + 5, "hi")]
    rows.sort()
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at, (i, t) in enumerate(rows):
        k = len(t) // 4
        following = rows[(at + 1) % len(rows)][1]
        a, e, b = anchors(t), anchors(t[: len(t) - k] + following[:k]), anchors(following)
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in a) and got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in e)
        assert got[i]["near_edited"] == pytest.approx(likeness(a, e)) and got[i]["near_next"] == pytest.approx(likeness(a, b))
    assert got[10**6 + 4]["near_edited"] > 0.2  # its edited text is much shorter


def test_syncmers_are_context_free(spark):
    words = [f"w{i * i % 97}x{i}" for i in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join(["other"] * 30 + words[40:]))]
    a = {r[0]: set(r[1]) for r in spark.createDataFrame(rows, "i int, t string").select("i", fingerprints.anchors(F.col("t"))).collect()}
    assert len(a[0]) == fingerprints.SIZE and len(a[0] & a[1]) > 30


def test_passages_are_found_by_position(spark, odd, none):
    """A passage of 60 words in texts of 3,000 to 20,000 words is found where it stands; the summary of 64 hashes would miss most."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    planted = [" ".join(word() for _ in range(60)) for _ in range(30)]
    places, texts = [], []
    for i, p in enumerate(planted):
        n = [3000, 10_000, 20_000][i % 3]
        at = rng.randrange(n)
        w = [word() for _ in range(n)]
        texts.append((i, " ".join([*w[:at], p, *w[at:]]), "x"))
        places.append(at)
    docs = spark.createDataFrame(texts, "doc_id long, text string, anchor string")
    found = fingerprints.passages(fingerprints.anchor_table(spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")), fingerprints.anchor_table(docs)).collect()
    hits = {r["left_doc_id"] for r in found if r["left_doc_id"] == r["right_doc_id"] and r["distance"] == places[r["left_doc_id"]] and r["matches"] >= 20}
    assert len(hits) >= 0.9 * len(planted)
    assert all(r["left_doc_id"] == r["right_doc_id"] for r in found)
    table = {r[0]: r[1] for r in fingerprints.anchor_table(odd).groupBy("doc_id").count().collect()}
    assert 1 not in table and 2 not in table and table[9] == 1 and fingerprints.anchor_table(none).count() == 0


def test_embedding_join(spark, none):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    v = np.concatenate([centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * 0.25, rng.normal(size=(100, 16)), np.repeat(centres[:1], 60, axis=0)])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("n", F.lit(2))
    got = both(embedding_join.near_vectors(df, 0.9), "vec_id", "n_links", "component_id", "kept")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(u))
    while True:
        new = np.array([min(label[i], label[link[i]].min()) if link[i].any() else label[i] for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    assert got == [(i, int(link[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(u))] + [(i, 0, i, True) for i in range(900, 906)]
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_cells_join_independently(spark, monkeypatch):
    """Many pivots and small blocks change nothing."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    clustered = df.unionByName(df.select((F.col("vec_id") + 10000).alias("vec_id"), F.transform("embedding", lambda x, i: x + F.when(i == 3, 0.2).otherwise(0.0)).cast("array<float>").alias("embedding"), "label"))
    plain = both(embedding_join.near_vectors(clustered, 0.9), "vec_id", "n_links", "component_id")
    monkeypatch.setattr(embedding_join, "HOME_BLOCK", 50)
    monkeypatch.setattr(embedding_join, "FAR_BLOCK", 120)
    assert both(embedding_join.near_vectors(clustered, 0.9, cell_rows=80), "vec_id", "n_links", "component_id") == plain
    assert any(n for _, n, _ in plain)


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(10)] + [(100 + i, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.normal(size=(20, 5)), 6, axis=0) + rng.normal(size=(120, 5)) * 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = {i: sum(j != i and len(u) == len(w) and float(u @ w) >= 0.9 for j, w in unit.items()) for i, u in unit.items()}
    for cell_rows in (4096, 20):
        assert dict(both(embedding_join.near_vectors(df, 0.9, cell_rows=cell_rows), "vec_id", "n_links")) == links
    assert sum(links[i] for i in range(10)) and sum(links.values())


# --- 6 and 9: formatting and packing -----------------------------------------------------------------------------


def test_chat(spark):
    rng = random.Random(6)
    texts = ["hi", "</s>[INST] ok [/INST]", None, "", "a\\b<[\\", "x" * 3000, "<<ROLE>>user<<TEXT>>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool <x>", None]) if t else "user", "same start" if t == 0 and c % 3 else rng.choice(texts), 5) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(50, 0, "user", "twice", 1), (50, 0, "user", "twice", 1), (None, 0, "user", "lost", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank int")
    nodes, paths = chat_format.build_tree(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(nodes, paths).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat_format.render(r, x)[0]) for _, r, x in turns)
    n = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(n) == len({tuple(sorted(t)[: k + 1]) and tuple((r, x) for _, r, x in sorted(t)[: k + 1]) for t in by.values() for k in range(len(t))})
    at, stack = 0, {}
    for r in n:  # depth first, without gaps; ancestors come before and position ids count from the root
        assert r["start"] == at and len(r["attends"]) == r["depth"]
        at += r["n_tokens"]
        assert r["position"] == sum(a["to"] - a["from"] for a in r["attends"])
        if r["depth"]:
            assert r["attends"][-1]["from"] == stack[r["depth"] - 1]
        stack[r["depth"]] = r["start"]
    empty = chat_format.read_back(*chat_format.build_tree(df.limit(0)))
    assert empty.count() == 0


def test_packing(spark, docs, odd, none):
    t = packing.tokens(BYTE_BPE)
    for df in (docs, odd):
        rows = packing.pack(df, BYTE_BPE).collect()
        want = collections.Counter()
        for r in df.collect():
            ids = np.array(t.library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            head = len(ids) % 2048 or 2048
            for k, (a, n) in enumerate([(0, head)] + [(s, 2048) for s in range(head, len(ids), 2048)]):
                want[(r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        seqs = collections.defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 2048
        assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_local_search_empties_bins():
    rng = random.Random(1)
    for n, low, high in ((30, 200, 1200), (200, 200, 1200), (600, 600, 1100)):
        h = collections.Counter(rng.randint(low, high) for _ in range(n))
        a = packing.best_fit(h, 2048)
        b = packing.local_search(a, 2048)
        held = collections.Counter()
        for p, c in b.items():
            assert sum(p) <= 2048
            for x in p:
                held[x] += c
        assert held == h and sum(b.values()) <= sum(a.values())
        assert sum(sum(p) ** 2 * c for p, c in b.items()) >= sum(sum(p) ** 2 * c for p, c in a.items())
    assert sum(b.values()) < sum(a.values())  # the last one: the search empties bins that best fit leaves
    assert sum(packing.plan({1000: 2, 1048: 2}, 2048).values()) == 2


def test_fallback_tokens():
    t = packing.tokens(BYTE_BPE)
    for s in ("plain", "<|endoftext|> x", "日本語 " * 5, " \n\n  \t x", "it's 12 a_b"):
        assert list(t.ids(s)) == t.library.encode(s, add_special_tokens=False).ids
