"""Every query opN_ as it is registered: columns and rows of its contract, and the SQL where there is some."""

import hashlib

import pytest
from conftest import SF, as_rows

from lexmill.llm import registry

#: query, table, columns that must be there, rows for each row of the table.
CONTRACT = {
    "op1_sentencepiece": ("documents", ["doc_id"], 1),
    "op2_quality": ("documents", ["doc_id", "held_out", "score", "predicted"], 1),
    "op3_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"], 1),
    "op4_ngram_join": ("documents", ["doc_id", "n_shingles", "component_id"], 1),
    "op5_line_dedup": ("documents", ["doc_id"], 1),
    "op6_chat_format": (None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], 1),
    "op7_fingerprints": ("documents", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], 1),
    "op8_token_counts": ("documents", ["doc_id", "n_bytes", "n_tokens", "over_limit"], 1),
    "op9_packing": (None, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], 1),
    "op10_embedding_join": ("embeddings", ["vec_id", "n_links", "component_id", "kept"], 1),
    "op11_merkle_manifest": ("documents", ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], 1),
    "op12_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"], 1),
    "op13_whitening": ("embeddings", ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"], 8),
}


@pytest.fixture(scope="module")
def results(spark):
    """Each query's rows once."""
    made = {}

    def rows(name):
        if name not in made:
            df = registry.queries()[name](spark, SF)
            made[name] = (df.columns, df.collect())
        return made[name]

    return rows


def test_all_are_here():
    assert set(registry.queries()) == set(CONTRACT)
    assert set(registry.oracle_sql()) <= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(results, oracle, name):
    table, columns, times = CONTRACT[name]
    got, rows = results(name)
    assert set(columns) <= set(got)
    if table:
        assert len(rows) == times * oracle(f"select count(*) from {table}")[1][0][0]
    if name in registry.oracle_sql():
        names, want = oracle(registry.oracle_sql()[name])
        assert as_rows(got, rows) == as_rows(names, want)


def test_planted_conversation(results, oracle):
    columns, rows = results("op6_chat_format")
    got = {r["conv_id"]: r for r in rows}
    assert len(got) == len(rows) == 1 + oracle("select count(distinct conv_id) from conversations")[1][0][0]
    odd = "</s>[INST] ok [/INST]"
    assert (got[-7]["n_turns"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (2, len(odd), hashlib.sha256(odd.encode()).hexdigest())
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def test_sequences_are_full_and_gapless(results):
    _, rows = results("op9_packing")
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_mix_keeps_to_targets(results):
    _, rows = results("op12_mixing")
    taken, want = {}, {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
        want[key] = r["target"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[k] - want[k]) <= longest / 2 for k in taken)


def test_whitened_covariance_is_the_identity(results):
    import numpy as np

    _, rows = results("op13_whitening")
    w = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 8)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9 and max(r["identity_error"] for r in rows) < 1e-9
