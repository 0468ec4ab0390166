from __future__ import annotations

import json
import random
import subprocess
import sys
import textwrap

import pytest

import corpus_pipeline
from inkgraph.llm import langid, packing, toxicity
from inkgraph.llm.shared import fold
from tests.llm.test_operators import CLASH, EDGE, TONGUES, brute_kept, brute_lines, brute_toxicity, sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        tongue = rng.choice(list(TONGUES))
        own = sentence(rng, tongue, 80).split()
        bad = i % 3 == 0
        if bad:
            own.insert(40, rng.choice(["vilething", "grimword"]))
        rows.append((i, " ".join(own), tongue, "s", None))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[1][1] + (" x" if i else ""), "aa", "s", None) for i in range(3)]
    shared = "a passage that several documents hold, word for word"
    rows += [(2000 + i, sentence(rng, "bb", 50) + "\n" + shared, "bb", "s", None) for i in range(4)]
    rows += [(3000 + k, t, None, None, None) for k, (_, t) in enumerate(EDGE)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return tmp_path, rows, labels, shared


def test_stages(spark, tables):
    folder, rows, labels, shared = tables
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(str(folder / f"stage-{k}"))
        docs = spark.read.parquet(str(folder / f"stage-{k}"))
        left[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, _, y in labels if y}
    assert {r[0] for r in rows} - set(left["toxicity"]) == toxic
    assert {i for i in left["toxicity"]} - {i for i in left["language_id"]} <= {3000 + k for k in range(len(EDGE))}
    held = [i for i, r in left["line_dedup"].items() if shared in r["text"]]
    assert held == [2003] and left["line_dedup"][2000]["n_chars"] == len(left["line_dedup"][2000]["text"])
    assert 1 in left["simhash"] and 1000 not in left["simhash"]
    assert set(left["packing"]) == set(left["simhash"])


def test_run_matches_brute_force(spark, tables):
    """Stage by stage over plain rows; the models that the stages learn are taken as they are."""
    import public_tokenizers
    import sentencepiece

    folder, rows, _, _ = tables
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    left = [(r[0], r[1]) for r in rows]
    model = toxicity.fit(docs, spark.read.parquet(str(folder / "labels.parquet")).where(fold("doc_id", 4) != 2))
    left = [r for r in left if brute_toxicity(model, r[1]) < 0.3]
    stay = spark.createDataFrame([(i,) for i, _ in left if i is not None], "doc_id long").distinct()
    none = docs.where("doc_id IS NULL") if any(i is None for i, _ in left) else docs.limit(0)
    classifier = langid.Classifier(langid.fit(docs.join(stay, "doc_id", "left_semi").unionByName(none).where("crc32(cast(doc_id AS string)) % 3 <> 1")))
    left = [r for r, told in zip(left, classifier.classify([t for _, t in left]), strict=True) if not told[3]]
    left = brute_kept([(i, text) for i, text, _, _ in brute_lines(left)])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(library.encode(t, add_eos=True))) for i, t in left if i is not None)
    found = corpus_pipeline.run(spark, str(folder)).collect()
    by = {}
    for r in found:
        by.setdefault((r["doc_id"], r["piece"]), []).append(r["n_tokens"])
    whole = {}
    for (doc, _), parts in by.items():
        whole[doc] = [a + b for a, b in zip(whole.get(doc, [0] * len(parts)), parts, strict=True)]
    assert sorted((i, n) for i, parts in whole.items() if i is not None for n in parts) == want
    assert sum(r["n_tokens"] for r in found if r["doc_id"] is not None) == sum(n for _, n in want)
    assert max(r["capacity"] for r in found) in packing.CAPACITIES


def test_near_duplicates_of_five_words(spark, tmp_path):
    """Every sixtieth word changed leaves a likeness of 0.8 or more, which a few SimHash bits don't reach."""
    rng = random.Random(5)
    rows = []
    for i in range(0, 60, 2):
        own = [f"{rng.choice(TONGUES['aa'])}{rng.randrange(900)}" for _ in range(400)]
        rows.append((i, " ".join(own), "aa", "s", None))
        rows.append((i + 1, " ".join("other" if k % 60 == 30 else w for k, w in enumerate(own)), "aa", "s", None))
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left) == list(range(0, 60, 2))


def test_run_equals_stages(spark, tables):
    folder, *_ = tables
    found = corpus_pipeline.run(spark, str(folder))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_subpackage():
    code = textwrap.dedent("""
        import sys
        sys.modules["inkgraph.llm"] = None
        sys.modules["corpus_pipeline"] = None
        import __spark_entry__ as entry, json
        print(json.dumps(sorted(entry.queries())))
    """)
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    names = json.loads(said.stdout.splitlines()[-1])
    assert names and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
    assert CLASH
