"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc32_mod, read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_lattice import encode

    made = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.transform(F.coalesce("_removed", F.array().cast("array<struct<first:int,last:int>>")), lambda r: F.struct(r["first"].cast("long").alias("first"), r["last"].cast("long").alias("last")))
    return done.select("doc_id", F.col("_removed").isNotNull().alias("changed"), cut.alias("removed_lines"), F.length("text").cast("long").alias("n_chars_left"), F.col("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import build_tree, read_back

    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(*build_tree(convs.unionByName(extra)))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), 0.9)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, verify

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    proofs = manifest(read(spark, sf_dir, "documents"), F.coalesce(crc32_mod("doc_id", 3) == 0, F.lit(False)), lower)
    return verify(proofs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), 8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w
), s AS (SELECT doc_id, unnest(gs) AS x FROM g), n AS (SELECT doc_id, len(gs) AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(a, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.c), n.doc_id) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


#: CRC-32 bit by bit, since the other engine has no such function. A step of the fold over the levels of the tree takes
#: every run of 8 nodes to its hash; proofs are the nodes of a leaf's runs without those on its own path.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"


def _merkle_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


def _merkle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_merkle_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _merkle_levels(name: str, base: str) -> str:
    """All levels of the trees over ``base`` (k, pos, d): k, lvl, pos, d, n (nodes of the level)."""
    return f"""{name}(k, lvl, pos, d, n) AS (
  SELECT k, 0, pos, d, count(*) OVER (PARTITION BY k) FROM {base}
  UNION ALL SELECT k, lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, lvl, n, pos // 8)"""


def _merkle_steps(name: str, levels: str) -> str:
    """l and r, the siblings at both sides, of each node of the levels that are reduced."""
    w = "PARTITION BY k, lvl, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (SELECT k, lvl, pos, coalesce(string_agg(d, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {levels} WHERE n > 1)"""


OP11_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('+' || lang, '') AS k, {_merkle_leaf("text")} AS d, {_merkle_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, {_CRC.format("doc_id::VARCHAR")} AS c FROM documents),
leaves AS (SELECT *, CASE WHEN c % 3 = 0 THEN low ELSE d END AS own, row_number() OVER (PARTITION BY k ORDER BY doc_id, d) - 1 AS pos FROM base),
{_merkle_levels("t", "leaves")},
subroots AS (SELECT k AS lang, d, 0 AS k, row_number() OVER (ORDER BY k) - 1 AS pos FROM t WHERE n = 1),
{_merkle_levels("u", "subroots")},
{_merkle_steps("ts", "t")}, {_merkle_steps("us", "u")},
steps AS (
  SELECT a.k, a.pos AS leaf, s.lvl AS lv, s.l, s.r FROM leaves a JOIN ts s ON s.k = a.k AND s.pos = a.pos // (8 ** s.lvl)::BIGINT
  UNION ALL SELECT a.k, a.pos, 100 + s.lvl, s.l, s.r FROM leaves a JOIN subroots b ON b.lang = a.k JOIN us s ON s.pos = b.pos // (8 ** s.lvl)::BIGINT),
ordered AS (SELECT k, leaf, l, r, row_number() OVER (PARTITION BY k, leaf ORDER BY lv) AS i FROM steps),
proofs AS (SELECT k, leaf, sha256(string_agg(l || r, '' ORDER BY i)) AS proof_sha256, max(i) AS many FROM ordered GROUP BY k, leaf),
f(k, leaf, i, d) AS (SELECT k, pos, 0, own FROM leaves UNION ALL SELECT f.k, f.leaf, f.i + 1, sha256(o.l || f.d || o.r) FROM f JOIN ordered o ON o.k = f.k AND o.leaf = f.leaf AND o.i = f.i + 1),
whole AS (SELECT d AS root FROM u WHERE n = 1)
SELECT a.doc_id, a.d AS leaf, b.d AS subroot, root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM leaves a JOIN subroots b ON b.lang = a.k CROSS JOIN whole LEFT JOIN proofs p ON p.k = a.k AND p.leaf = a.pos JOIN f ON f.k = a.k AND f.leaf = a.pos AND f.i = coalesce(p.many, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op10_embedding_join": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
