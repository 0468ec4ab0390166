"""The queries over small tables: names, formats and folds of what they return."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from inkgraph.llm import queries
from tests.llm.test_operators import LARGE, TONGUES, brute_fingerprint, brute_lines, brute_minhash, sentence, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(150):
        tongue = rng.choice(list(TONGUES))
        own = sentence(rng, tongue, 60).split()
        if i % 4 == 0:
            own.insert(9, "vilething")
        rows.append((i, " ".join(own), tongue, "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(LARGE, "a shared line of three documents\nown", None, None, None), (LARGE + 1, "A shared line of three documents ", "aa", None, None), (LARGE + 2, "a shared line of three documents", "aa", None, None)]
    rows += [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 34", "bb", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    data = np.random.default_rng(3).normal(size=(60, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path), rows, data


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_op1(spark, folder):
    path, rows, _ = folder
    found = {r["doc_id"]: r for r in queries.op1_simhash(spark, path).collect()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{brute_fingerprint(t):016x}" for i, t, *_ in rows}
    assert found[1000]["component_id"] == found[1001]["component_id"] == 1000


def test_op2(spark, folder):
    path, rows, _ = folder
    found = {r["doc_id"]: r for r in queries.op2_language_id(spark, path).collect()}
    assert {i: r["held_out"] for i, r in found.items()} == {i: fold(i, 3) == 1 for i, *_ in rows}
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    told = [(found[i]["lang_pred"], x) for i, _, x, *_ in rows[:150] if fold(i, 3) == 1]
    assert sum(a == b for a, b in told) >= 0.98 * len(told)


def test_op4(spark, folder):
    path, _, data = folder
    found = queries.op4_nearest(spark, path).collect()
    data = data.astype(np.float32).astype(np.float64)
    want = []
    for q in (0, 20, 40):
        scores = (data * data[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(60), -scores)) if i != q][:20]
        want += [(q, k + 1, int(i), float(scores[i])) for k, i in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == want


def test_op5_and_op6(spark, folder):
    import public_tokenizers
    import sentencepiece

    path, rows, _ = folder
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    ids = {i: library.encode(t or "", add_eos=True) for i, t, *_ in rows}
    found = {r["doc_id"]: tuple(r) for r in queries.op6_pieces(spark, path).collect()}
    assert found == {i: (i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in ids.items()}
    packed = queries.op5_packing(spark, path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == {i: len(x) for i, x in ids.items()}


def test_op8(spark, folder):
    path, rows, _ = folder
    found = {r["doc_id"]: r for r in queries.op8_minhash(spark, path).collect()}
    falling = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, text, *_) in enumerate(falling):
        text, following = text or "", falling[(k + 1) % len(falling)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["fingerprint"] == brute_minhash(text) and found[i]["edited_fingerprint"] == brute_minhash(edited)


def test_op9(spark, folder):
    path, rows, _ = folder
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute_lines([r[:2] for r in rows])}
    assert {tuple(r) for r in queries.op9_line_dedup(spark, path).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
    assert sum(d for _, _, d, _ in want) == 2


def test_op10(spark, folder):
    path, rows, _ = folder
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, path).collect()}
    assert {i: r["held_out"] for i, r in found.items()} == {i: fold(i, 4) == 2 for i, *_ in rows}
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found.values())
    held = [i for i in range(150) if fold(i, 4) == 2]
    assert sum(found[i]["predicted"] == int(i % 4 == 0) for i in held) >= len(held) - 1
    assert words(1, 1)
