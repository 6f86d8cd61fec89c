"""Text functions, records, audits, sampling and sources, with negative cases."""

import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import stylometry, text as tx
from lexmill.operators import audit, features, records, sampling
from lexmill.plans import workflows
from lexmill.sources import adapters, files

ODD = ["Straße  CAFÉ", "café x\u0085y", "a b\u001cc", "A\r\nB\rC\x00D", "", " \t ", "ΑΣ ſt µ", "日本 語"]


def one(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_text(spark):
    assert one(spark, ODD, tx.canonical) == [" ".join(unicodedata.normalize("NFC", t).casefold().split()) for t in ODD]
    assert one(spark, ODD, tx.strip) == [t.strip() for t in ODD]
    assert one(spark, ODD, tx.normalize) == [unicodedata.normalize("NFC", t).replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n") for t in ODD]
    assert [len(x) for x in one(spark, ["a b c d e f", "a b", "", "a a a a a a a"], tx.shingles)] == [2, 1, 0, 1]


#: Values worked out by hand.
STYLE = {
    # 12 words in sentences of 2, 6 and 4 and paragraphs of 8 and 4; lengths 5 8 4 3 6 1 1 1 3 9 5 2; "the", "a" and "it" are function words.
    "Short sentence! It's the second; a - b: c?\n\nNew paragraph, isn't it?\n": dict(
        word_count=12, sentence_count=3, sentence_length_mean=4, sentence_length_std=math.sqrt(8 / 3), sentence_length_skew=0, paragraph_count=2, paragraph_length_std=2, type_token_ratio=1, hapax_rate=1,
        word_length_mean=4, word_length_std=math.sqrt(80 / 12), repeated_token_rate=0, contraction_rate=2 / 12, function_word_ratio=3 / 12, newline_per_100_words=25, semicolon_per_100_words=100 / 12,
        colon_per_100_words=100 / 12, hyphen_per_100_words=100 / 12, comma_per_100_words=100 / 12, exclamation_per_100_words=100 / 12, question_per_100_words=200 / 12, character_entropy_std=0,
    ),
    "": dict.fromkeys(stylometry.NAMES, 0) | {"repeated_token_rate": 1},
    "...": dict(word_count=0, sentence_count=0, paragraph_count=1, character_entropy_mean=0),
    "One. Two. Three four five six.": dict(sentence_count=3, sentence_length_mean=2, sentence_length_std=math.sqrt(2), sentence_length_skew=math.sqrt(0.5)),
    "The cat the": dict(word_count=3, type_token_ratio=2 / 3, hapax_rate=1 / 3, repeated_token_rate=1 / 3, function_word_ratio=2 / 3, word_length_mean=3, word_length_std=0),
    "a" * 128 + "ab": dict(word_count=1, word_length_mean=130, character_entropy_mean=0.5, character_entropy_std=0.5),  # windows of 0 and 1 bit
    "abcd" * 32: dict(character_entropy_mean=2, character_entropy_std=0),
    "One x.\n \nTwo": dict(paragraph_count=2, paragraph_length_std=0.5),
}


def test_stylometry(spark):
    texts = list(STYLE)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in features.stylometric_features(df).collect():
        want = STYLE[texts[r["id"]]]
        assert {k: r[k] for k in want} == pytest.approx({k: float(v) for k, v in want.items()}, abs=1e-9)
    stats = {r["feature"]: r for r in features.fit_normalizer(spark.createDataFrame([(0.0, 2.0), (2.0, 2.0)], "a double, b double"), ["a", "b"]).collect()}
    assert (stats["a"]["mean"], stats["a"]["scale"], stats["b"]["scale"]) == (1.0, 1.0, 1.0)


BASE = dict(lineage_id="l", label=0, source="s", domain="d", provenance="human", generator_family="human", editor_family="none", transformation_family="none", split="train", sealed=False, train_eligible=True, parent_id=None, source_fields={})
LONG = " ".join(f"w{i}" for i in range(100))


def rec(spark, *rows):
    made = [BASE | {"id": f"r{i}", "text": f"text number {i} of its own kind here", "ord": i} | r for i, r in enumerate(rows)]
    schema = "id string, lineage_id string, text string, label int, " + ", ".join(f"{c} string" for c in records.FIELDS) + ", sealed boolean, train_eligible boolean, parent_id string, source_fields map<string,string>, ord long"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], schema)


def test_records(spark):
    df = records.to_records(rec(spark, {"text": "A human\r\npassage."}))
    r = df.first()
    assert r["text"] == "A human\npassage." and r["text_sha256"] == __import__("hashlib").sha256(b"A human\npassage.").hexdigest()
    with pytest.raises(Exception, match="label must be"):
        records.to_records(rec(spark, {"label": 2})).collect()
    with pytest.raises(Exception, match="must not hold text"):
        records.to_records(rec(spark, {"source_fields": {"Prompt": "x"}})).collect()
    with pytest.raises(ValueError, match="missing"):
        records.to_records(rec(spark, {}).drop("label"))
    assert records.digest({"a": 1, "b": 2}) == records.digest({"b": 2, "a": 1})


@pytest.mark.parametrize(
    ("rule", "rows"),
    [
        ("duplicate_id", [{"id": "x"}, {"id": "x"}]),
        ("unknown_split", [{"split": "elsewhere"}]),
        ("sealed_test_flags", [{"split": "sealed_test", "sealed": True}]),
        ("sealed_elsewhere", [{"sealed": True}]),
        ("lineage_crosses_splits", [{}, {"split": "development"}]),
        ("blank_text", [{"text": "  \n"}]),
        ("exact_duplicate", [{"text": "Same  Text"}, {"text": "same text", "split": "development", "lineage_id": "m"}]),
        ("near_duplicate", [{"text": LONG}, {"text": LONG[:-3] + "zz", "split": "development", "lineage_id": "m"}]),
        ("missing_parent", [{"parent_id": "nobody"}]),
        ("parent_crosses_splits", [{}, {"split": "calibration", "lineage_id": "m", "parent_id": "r0"}]),
    ],
)
def test_audit_rules(spark, rule, rows):
    with pytest.raises(audit.AuditError, match=rule):
        audit.audit(rec(spark, *rows))


def test_audit_passes(spark):
    assert audit.audit(rec(spark, {"text": LONG}, {"text": LONG[:-3] + "zz"})) == {"train": 2}
    assert audit.audit(rec(spark).limit(0)) == {}
    with pytest.raises(ValueError, match="threshold"):
        audit.near_pairs(rec(spark, {}), 0)


def test_stylometry_of_many_texts_at_once(spark):
    """Whatever stands before and after it in a batch, a text has the values it has alone; no element-wise lambdas in the plan."""
    rng = random.Random(11)
    parts = ["a", "It's", "o'n'e", "'", "''", " ", "\n", "\n \n", "\u2028", ".", "?!", "...", "the", "É", "\U0001f600", "-", "word " * 40, "\x1c", "\n\n\n"]
    texts = [None, "", " ", "\n\n", "."] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(120)]
    alone = [stylometry._measure([t or ""])[0] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = features.stylometric_features(df)
    assert "lambda" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert [r[n] for n in stylometry.NAMES] == pytest.approx(alone[r["id"]].tolist(), abs=1e-9)
        t = texts[r["id"]] or ""
        words = [w.lower() for w in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", t)]
        assert r["word_count"] == len(words) and r["hapax_rate"] == pytest.approx(sum(words.count(w) == 1 for w in words) / max(1, len(words)))
        assert r["sentence_count"] == sum(bool(s.strip()) for s in re.split(r"[.!?]+", t)) and r["paragraph_count"] == sum(bool(s.strip()) for s in re.split(r"\n\s*\n", t))


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    docs = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        docs.append((f"d{i:02}", " ".join(w), rng.choice(["train", "development"])))
    df = spark.createDataFrame(docs, "id string, text string, split string")
    sets = {i: ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} if len(t.split()) >= 5 else {tuple(t.split())}, s) for i, t, s in docs}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0]) >= 0.6}
    assert {(r["a"], r["b"]) for r in audit.near_pairs(df, 0.6).collect()} == want and want


def test_sampling(spark):
    df = spark.range(100).selectExpr("concat('i', id) id", "cast(id % 2 as int) label", "id % 7 g", "id")
    pick = lambda d: sorted(r["id"] for r in sampling.balanced_sample(d.selectExpr("id", "label"), 5, 3).collect())
    base = spark.range(100).selectExpr("concat('i', id) id", "cast(id % 2 as int) label", "concat('g', id % 7) g")
    assert pick(base) == pick(base.orderBy(F.desc("id")).repartition(5)) and len(pick(base)) == 10
    with pytest.raises(ValueError, match="fewer"):
        sampling.balanced_sample(base, 51, 3)
    split = sampling.group_split(base, 3, "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r[0] for r in split.select("split").distinct().collect()} == {"test", "development", "train"}
    counts = {(r[0], r[1]): r[2] for r in sampling.stratified_split(base, 3).groupBy("label", "split").count().collect()}
    assert counts == {(y, s): n for y in (0, 1) for s, n in (("test", 8), ("validation", 8), ("train", 34))}
    del df


def test_weights(spark):
    rows = [("a", 0, "x", "l1"), ("a", 0, "x", "l1"), ("a", 1, "y", "l2"), ("b", 1, "z", "l3")]
    df = spark.createDataFrame(rows, "source string, label int, provenance string, lineage_id string")
    w = sampling.hierarchical_weights(df, {"x": 0.5, "y": 0.25, "z": 0.25}, F.col("provenance"))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1) and {r["weight"] for r in w.collect()} == {0.25}
    with pytest.raises(ValueError, match="without rows"):
        sampling.hierarchical_weights(df, {"x": 0.5, "y": 0.2, "z": 0.2, "q": 0.1}, F.col("provenance"))
    with pytest.raises(ValueError, match="unsupported"):
        sampling.hierarchical_weights(df, {"x": 1.0}, F.col("provenance"))
    d = spark.createDataFrame([("p", 0.75), ("q", 0.25), ("r", 0.0)], "id string, weight double")
    n = {r[0]: r[1] for r in sampling.weighted_draw(d, 4000, 1).groupBy("id").count().collect()}
    assert sum(n.values()) == 4000 and n["p"] == pytest.approx(3000, abs=150) and "r" not in n
    with pytest.raises(ValueError):
        sampling.curriculum_mix(0, [{}])


def test_adapters(spark):
    pad = spark.createDataFrame([(1, "Hello  World", 0, 0), (2, "hello world", 1, 1), (3, " ", 1, 2), (4, "Other", 1, 3)], "idx int, sentence string, label int, ord int")
    got = {r["id"]: r for r in adapters.sentence_pairs(pad, "ord").collect()}
    assert set(got) == {"padben:1", "padben:4"} and got["padben:4"]["provenance"] == "ai_humanized"
    with pytest.raises(ValueError, match="missing"):
        adapters.sentence_pairs(pad.drop("sentence"), "ord")
    beemo = spark.createDataFrame(
        [("p", " human ", "edited", "raw", "[{'P1': 'one'}, {'P2': None, 'P3': ' '}]", "not a literal"), ("q", "h", None, None, "5", "[{'P2': 'x', 'P1': 'y'}]")],
        "prompt_id string, human_output string, human_edits string, model_output string, `llama-3.1-70b_edits` string, `gpt-4o_edits` string",
    )
    v = adapters.edit_variants(beemo)
    rows = [(r["group_id"], r["ordinal"], r["variant"], r["text"]) for r in v.orderBy("group_id", "ordinal").collect()]
    assert rows == [("p", 0, "human", "human"), ("p", 1, "raw_ai", "raw"), ("p", 2, "expert_edit", "edited"), ("p", 3, "llama-3.1-70b_P1", "one"), ("q", 0, "human", "h"), ("q", 1, "gpt-4o_P1", "y"), ("q", 2, "gpt-4o_P2", "x")]
    r = {x["id"]: x["parent_id"] for x in adapters.edit_records(v, F.lit("train")).collect()}
    assert r["beemo:p:expert_edit:2"] == "beemo:p:raw_ai:1" and r["beemo:q:gpt-4o_P1:1"] is None
    ext = spark.createDataFrame([("t", 1, "C", "s", "f", ""), ("u", 0, "C", "s", "f", "m"), ("v", 0, "A", "s", "f", "m")], "text string, binary_label int, test_split string, scenario string, scenario_family string, generator_model string")
    assert sorted((x["label"], x["generator_model"]) for x in adapters.external_rows(ext, "text").collect()) == [(0, "human"), (1, "m")]


def raid(spark, n=4):
    rows = []
    for i in range(n):
        rows += [(f"h{i}b", f"f{i}", "", "human", "none", "news", f"human text {i} b"), (f"h{i}a", f"f{i}", "", "human", "none", "news", f"human text number {i}"),
                 (f"m{i}", f"f{i}", "", "mistral", "paraphrase", "news", f"m {i}"), (f"g{i}", f"f{i}", "", "gpt-4", "paraphrase", "news", f"machine words in family {i}"),
                 (f"x{i}", f"f{i}", "", "gpt-4", "upper", "news", "X")]
    rows.append(("lone", "f99", "", "human", "none", "news", "alone"))
    return spark.createDataFrame(rows, "id string, source_id string, adv_source_id string, model string, attack string, domain string, generation string")


META = {"source_locator": "u", "revision": "r", "row_selection_rule": "x", "selection_seed": 1, "sealed_at": "2026-01-01T00:00:00Z"}


def test_seal(spark, tmp_path):
    base = str(tmp_path / "sealed")
    m = workflows.seal_cohort(raid(spark), base, 3, 7, META)
    assert m["records"] == 6 and re.fullmatch("[0-9a-f]{64}", m["metadata"]["source_snapshot_sha256"])
    assert "human text" not in (tmp_path / "sealed" / "manifest.json").read_text()
    rows = spark.read.json(base + "/sealed_test.jsonl").collect()
    assert {r["id"][5] for r in rows} == {"h", "g"} and all(r["id"].endswith("a") for r in rows if r["label"] == 0)
    with pytest.raises(FileExistsError):
        workflows.seal_cohort(raid(spark), base, 3, 7, META)
    with pytest.raises(ValueError, match="only 4"):
        workflows.seal_cohort(raid(spark), base + "2", 5, 7, META)
    with pytest.raises(ValueError, match="metadata"):
        workflows.check_sealed_metadata({})


def test_partitions(spark, tmp_path):
    for role, body in (("train", '{"id": "a b", "label": 1}\n\n{"id": "c", "label": 0}\n'), ("sealed_test", "not json")):
        (tmp_path / f"{role}.jsonl").write_text(body, encoding="utf-8")
    assert sorted(r["id"] for r in files.read_partition(spark, str(tmp_path), "train").collect()) == ["a b", "c"]
    with pytest.raises(ValueError, match="may not be read"):
        files.read_partition(spark, str(tmp_path), "sealed_test")
    files.write_json({"b": 1, "a": "é"}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == json.dumps({"a": "é", "b": 1}, indent=2, ensure_ascii=False) + "\n"
    got = {r["path"]: r["bytes"] for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert got["sealed_test.jsonl"] == 8 and "train.jsonl" in got


def test_preflight(spark):
    rows = [{"label": 0}, {"label": 1, "provenance": "raw_ai"}, {"label": 0, "split": "development", "lineage_id": "m"}, {"label": 1, "split": "development", "lineage_id": "m", "provenance": "raw_ai"}]
    assert audit.preflight(rec(spark, *rows), ["raw_ai"]) == {"train": 2, "development": 2}
    with pytest.raises(audit.AuditError, match="crosses"):
        audit.preflight(rec(spark, *rows, {"split": "development"}), ["raw_ai"])
    with pytest.raises(audit.AuditError, match="lacks"):
        audit.preflight(rec(spark, *rows), ["llm_edit"])


def test_baseline_and_calibration(spark, tmp_path):
    rng = __import__("random").Random(1)
    rows = []
    for i in range(120):
        y = i % 2
        words = " ".join(rng.choice(["human", "voice", "walk", "rain"] if y == 0 and rng.random() < 0.8 else ["model", "delve", "tapestry", "rain"]) for _ in range(12))
        rows.append({"id": f"b{i}", "lineage_id": f"g{i // 2}", "text": words + f" number{i}", "label": y, "source": f"s{i % 3}", "split": ["train", "development", "calibration"][i // 40]})
    df = rec(spark, *rows)
    report = workflows.baseline_run(df, str(tmp_path))
    assert report["development"]["roc_auc"] > 0.7
    stored = files.read_predictions(spark, str(tmp_path / "calibration_predictions.jsonl"))
    assert stored.columns == ["id", "label", "probability"] and stored.count() == 40
    out = workflows.calibration_report(stored, df.where("split = 'calibration'"), str(tmp_path), folds=4)
    assert [p["max_fpr"] for p in out["operating_points"]] == [0.01, 0.02, 0.05] and set(out["operating_points"][0]["source_human_fpr"]) == {"s0", "s1", "s2"}
    scored = stored.withColumn("p", F.col("probability"))
    gap = workflows.fit_diagnostics(scored, scored, 50, 3)
    assert gap["auc_gap"] == 0 and gap["bootstrap"]["low"] <= gap["bootstrap"]["median"] <= gap["bootstrap"]["high"]
    with pytest.raises(ValueError, match="sealed"):
        workflows.baseline_run(rec(spark, {"split": "sealed_test", "sealed": True}), str(tmp_path))


def test_null_splits_and_flags_are_violations(spark):
    """What is null keeps no rule."""
    rows = [("a", None, False, True), ("b", "train", None, True), ("c", "sealed_test", None, False), ("d", "sealed_test", True, None), ("e", "sealed_test", True, False), ("f", "train", False, None), ("g", None, True, False)]
    df = spark.createDataFrame([(i, r[0], f"l{i}", f"text {i} of its own", r[1], r[2], r[3], None) for i, r in enumerate(rows)], "ord long, id string, lineage_id string, text string, split string, sealed boolean, train_eligible boolean, parent_id string")
    got = {(r["rule"], r["id"]) for r in audit.violations(df, near=False).collect()}
    assert got == {("unknown_split", "a"), ("unknown_split", "g"), ("sealed_elsewhere", "g"), ("sealed_elsewhere", "b"), ("sealed_test_flags", "c"), ("sealed_test_flags", "d")}


def test_large_files_are_streamed(spark, tmp_path):
    """Files over the limit are hashed in pieces by tasks, to the same result; 3 GB take no more memory than a piece."""
    import hashlib
    import tracemalloc

    (tmp_path / "deep er").mkdir()
    for i, n in enumerate([0, 5, 3000, 700_000]):
        (tmp_path / "deep er" / f"f {i}").write_bytes(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
    small = {tuple(r) for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert small == {tuple(r) for r in files.file_manifest(spark, str(tmp_path), large=1000).collect()} and len(small) == 4
    assert ("deep er/f 2", hashlib.sha256((tmp_path / "deep er" / "f 2").read_bytes()).hexdigest(), 3000) in small
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(3 << 30)
    tracemalloc.start()
    digest = files._streamed_sha256(f"file:{tmp_path}/sparse")
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    zeros, want = bytes(1 << 20), hashlib.sha256()
    for _ in range(3 << 10):
        want.update(zeros)
    assert digest == want.hexdigest()
    assert ("sparse", digest, 3 << 30) in {tuple(r) for r in files.file_manifest(spark, str(tmp_path)).collect()}


def test_near_pairs_in_slices(spark, monkeypatch):
    """However few shingles are worked on at once, pairs are the same; no array of a whole batch is made."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "train" if i % 2 else "development", " ".join(words[: 20 + i % 5] + [f"x{i // 4}"] * 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, split string, text string").coalesce(1)
    plain = sorted(map(tuple, audit.near_pairs(df, 0.6).collect()))
    monkeypatch.setattr(audit, "SHINGLES", 50)
    assert sorted(map(tuple, audit.near_pairs(df, 0.6).collect())) == plain and plain


def test_near_pairs_of_many_edits(spark):
    """Sets just over and under the threshold, equal texts, one word texts and blanks, against all pairs."""
    rng = __import__("random").Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"e{rng.randrange(30)}"
        rows.append((f"d{i:03}", " ".join(w), "train" if i % 2 else "test"))
    rows += [("x1", "one", "train"), ("x2", "ONE ", "test"), ("x3", " ", "train"), ("x4", None, "test"), ("x5", "two words", None)]
    df = spark.createDataFrame(rows, "id string, text string, split string")
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for t in (0.85, 0.6, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, _, sa in rows for b, _, sb in rows if a < b and sa != sb and sa and sb and sets[a] & sets[b]}
        got = {(r["a"], r["b"]): r["jaccard"] for r in audit.near_pairs(df, t).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= t}) and got


def test_contamination_by_either_join(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i} a b c d e") for i in range(20)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x A b  C d e"), (2, "nothing shared with any of these"), (3, None)], "item_id long, text string")
    got = [sorted(tuple(r) for r in audit.contamination(docs, items, "doc_id", "item_id", most=m).collect()) for m in (1 << 20, 0)]
    assert got[0] == got[1] == [(i, 1, 1) for i in range(20)]
