from __future__ import annotations

import hashlib
import random
import struct
import zlib
from itertools import combinations, product

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from inkgraph.llm import ann, hosts, langid, linededup, minhash, nearsets, packing, pieces, simhash, toxicity, warc
from inkgraph.llm.components import connected_components
from inkgraph.llm.shared import fold, hashed_sample
from inkgraph.llm.words import letters

DOCS = "doc_id long, text string"
#: Extra columns under names that operators use themselves.
CLASH = "doc_id long, text string, fp long, component string, n_lines string, score string, lang_pred string, _lid int, n_tokens string, bin_id int, fingerprint string, next_text string, _struct int, _stays int, _lines int, _rt int, _tox int"


def clash(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "x", "s", "l", 2, "3", 4, "f", "n", 5, 6, 7, 8, 9) for r in rows], CLASH)


def kept(found, replaced=()):
    """Whether every extra column but those that are ``replaced`` is as it was."""
    want = {"fp": 1, "component": "c", "n_lines": "x", "score": "s", "lang_pred": "l", "_lid": 2, "n_tokens": "3", "bin_id": 4, "fingerprint": "f", "next_text": "n", "_struct": 5, "_stays": 6, "_lines": 7, "_rt": 8, "_tox": 9}
    return all(r[c] == v for r in found.collect() for c, v in want.items() if c not in replaced)


#: Ids that a float can't hold, beside a null.
LARGE = 2**53 + 1


def words(n, seed, vocabulary=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "x " * 40_000), (6, "A b"), (6, "A b"), (7, "same line of twenty characters\n" * 3), (None, "no id at all")]


# ---- SimHash


def brute_fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    grams = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [b" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_brute_force():
    for text in [None, "", " ", "A", "a B\tc\x0bd", words(300, 1), "Ünï cödé " * 9]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_uses_sparks_hash(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint("A b\nC") == want % 2**64


@pytest.mark.parametrize("part", [20_000, 7])
def test_trie_links_match_brute_force(spark, part):
    """Also where every subtrie is dealt out in parts; chains of near fingerprints are one component."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(12):
            f = b
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << bit
            fps.add(f)
    fps |= {0, 1, 3, 7, 15, 2**64 - 1, 2**63}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"] % 2**64: r["component"] for r in connected_components(simhash.trie_links(frame, 3, part)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    for members in groups.values():
        if len(members) > 1:
            assert {found[f] for f in members} == {min(map(signed, members))}
        else:
            assert not members & set(found)


@pytest.mark.parametrize(("budget", "part"), [(3, 1 << 17), (11, 1 << 17), (11, 90), (15, 200)])
def test_wide_tries_match_brute_force(spark, budget, part):
    """Every pair within the budget once, however the tries are dealt out; a limit leaves each its pairs in part."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 2**63, 2**64 - 1}
    for f in sorted(fps)[:60]:
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << bit
            fps.add(f)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = sorted((a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= budget)
    pairs = lambda found: sorted(tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in found.collect())
    assert pairs(simhash.near_pairs(frame, budget, None, part)) == want
    few = pairs(simhash.near_pairs(frame, budget, 1, part))
    assert set(few) <= set(want) and {f for p in few for f in p} == {f for p in want for f in p}
    assert simhash.near_pairs(frame.limit(0), budget).count() == 0


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 500), (700, 600), (700, 600), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, 201), 1), 600: 600, 700: 600}
    assert connected_components(edges.limit(0)).count() == 0


def test_simhash_edges(spark):
    rows = [*EDGE, (20, words(300, 1)), (21, words(300, 1) + " tail"), (22, words(300, 2))]
    found = simhash.near_duplicates(clash(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert by[1] == by[2] == 1 and by[4] == 4 and by[6] == 6 and by[22] == 22 and by[21] in (20, 21)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.keep_one(clash(spark, rows))
    assert 2 not in {r["doc_id"] for r in kept.collect()} and set(kept.columns) == set(clash(spark, rows).columns)


def test_simhash_keeps_a_row_of_each_group_of_repeated_ids(spark):
    a, b = words(300, 1), words(300, 2)
    rows = [(3, a), (5, a), (5, b), (9, b)]
    kept = simhash.keep_one(clash(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(3, a), (5, b)]


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(None, words(5, 0, 9)), (LARGE, words(5, 0, 9)), (LARGE + 1, None), (LARGE + 2, " ")]
    for k in range(30):
        own = words(80, k).split()
        rows.append((10 * k, " ".join(own)))
        for n in range(1, 4):
            own[rng.randrange(80)] = "other"
            rows.append((10 * k + n, " ".join(own)))
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min(r[0] for r, own in zip(rows, group, strict=True) if own == g and r[0] is not None) for g in set(group)}
    want = [(r[0], f, least[g]) for r, f, g in zip(rows, fps, group, strict=True)]
    found = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(clash(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len(set(least.values())) < len(rows) - 20


# ---- near-duplicates by shingle sets


def brute_kept(rows):
    """(doc_id, text) that stay, by all pairs."""
    split = [(t or "").lower().split() for _, t in rows]
    own = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {""} for w in split]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if own[i] == own[j] or len(own[i] & own[j]) * 5 >= len(own[i] | own[j]) * 4:
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [r for r, g in zip(rows, group, strict=True) if r[0] is None or r[0] == least[g]]


@pytest.mark.parametrize(("hub", "part"), [(256, 1_000_000), (3, 500)])
def test_near_sets_match_brute_force(spark, monkeypatch, hub, part):
    """Pairs around the least likeness, groups and chains; SimHash within three bits finds few of them."""
    monkeypatch.setattr(nearsets, "HUB", hub)
    monkeypatch.setattr(nearsets, "PART", part)
    rng = random.Random(8)
    rows = [*EDGE]
    for k in range(40):
        base = words(200, k, 5000).split()
        rows.append((100 + 10 * k, " ".join(base)))
        for n in range(1, 6):
            own = list(base) if k % 2 else own if n > 1 else list(base)
            for at in rng.sample(range(200), rng.randrange(1, 8)):
                own[at] = f"new{rng.random()}"
            rows.append((100 + 10 * k + n, " ".join(own)))
    # one large group whose members are alike by others only, or not at all
    base = words(200, 77, 5000).split()
    for n in range(60):
        own = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 12)):
            own[at] = f"new{rng.random()}"
        rows.append((2000 + n, " ".join(own)))
    rows += [(LARGE, words(90, 902)), (LARGE + 1, words(90, 902)), (LARGE + 2, words(90, 903))]
    rows += [(7001, words(90, 900)), (7002, words(90, 900)), (7002, words(90, 901)), (7003, words(90, 901)), (None, words(90, 900))]
    found = nearsets.keep_one(clash(spark, rows))
    assert set(found.columns) == set(clash(spark, rows).columns)
    want = brute_kept(rows)
    assert sorted(map(tuple, found.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)
    assert 40 < len(want) < len(rows) - 60
    assert nearsets.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_near_sets_link_by_tries(spark, monkeypatch):
    """Copies with some words replaced are linked without the buckets where their SimHashes are near."""
    monkeypatch.setattr(nearsets, "rest", lambda members, sets, links: links)
    base = words(300, 5, 5000).split()
    rows = [(n, " ".join([*base[: 60 * n], *[f"new{n}"] * bool(n), *base[60 * n + 1 :]])) for n in range(5)]
    rows += [(10 + n, words(300, 50 + n, 5000)) for n in range(5)]
    assert sorted(r["doc_id"] for r in nearsets.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == [0, *range(10, 15)]


def test_near_sets_shuffle_few_texts(spark):
    """Texts that have no near copy stay where they are, whatever Spark may broadcast."""
    rng = random.Random(3)
    rows = [(n, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for n in range(200)]
    rows += [(1000 + n, f"{t} tail") for n, t in rows[:5]]
    docs = spark.createDataFrame(rows, DOCS)
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        left = nearsets.keep_one(docs).select("doc_id", "text").collect()
        spark.range(1).count()
        after = written()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(map(tuple, left)) == rows[:200]
    assert 0 < after - before < sum(len(t) for _, t in rows) / 2


def test_cells_bound_what_sets_share():
    """Never less than what two sets share, and near it; sets that may link are all suspected, others mostly not."""
    rng = np.random.default_rng(5)
    draw = lambda n, top=2**64: np.unique(rng.integers(0, top, n, np.uint64))
    sets = [draw(n) for n in (0, 1, 2, 3, 17, 400, 400, 500, 511, 512, 3000)] + [draw(700, 2**50), draw(650, 2**50)]
    for base in list(sets[5:]):
        for share in (0.3, 0.75, 0.88, 0.92, 0.99):
            sets.append(np.union1d(base[rng.random(len(base)) < share], draw(max(1, int(len(base) * (1 - share))), 2**64 if base[-1] > 2**50 else 2**50)))
    held, sizes = [nearsets.cells(s) for s in sets], np.array([len(s) for s in sets])
    assert any(not h for h in held) and max(map(len, held)) == 2048
    labels = np.arange(len(sets)) // 2
    links, suspected = set(), set()
    for i, j in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        most = nearsets.most_common(held[i], held[j], sizes[i], sizes[j])
        assert common <= most <= min(sizes[i], sizes[j])
        if labels[i] != labels[j] and nearsets.enough(common, sizes[i], sizes[j]) and sizes[i]:
            links |= {i, j}
        if labels[i] != labels[j] and nearsets.enough(most, sizes[i], sizes[j]):
            suspected |= {i, j}
    found = nearsets.suspects(np.arange(len(sets)), sizes, held, labels)
    assert links and set(np.flatnonzero(found).tolist()) == suspected >= links and len(suspected) < len(sets)


# ---- lines


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    often = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often or often[key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    pool = [f"shared line number {i} of many É" for i in range(30)] + ["short", "", "  \t padded shared line of text \x0b"]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0]), (7, rows[7][1]), (102, "x" * 50_000 + "\n" + pool[1])]
    rows += [(LARGE + k, "a line of documents with large ids\n\nown") for k in range(3)]
    found = linededup.dedup_lines(clash(spark, rows))
    assert kept(found, {"n_lines"}) and set(found.columns) == {*clash(spark, []).columns, "n_dropped"}
    assert sorted(map(tuple, found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == sorted(brute_lines(rows), key=repr)
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    mph = linededup.PerfectHash.build(keys)
    assert sorted(mph.lookup(keys)) == list(range(len(keys)))
    shard = linededup.Shard(linededup.pack_shard(keys, keys + np.uint64(1), np.arange(len(keys)) + 3, np.arange(len(keys)) * 2))
    count, keeper = shard.probe(keys, keys + np.uint64(1))
    assert (count == np.arange(len(keys)) + 3).all() and (keeper == np.arange(len(keys)) * 2).all()
    count, _ = shard.probe(keys ^ np.uint64(5), keys)
    assert not count.any()


def test_lines_of_one_short_hash_are_told_apart():
    h1 = np.array([7, 9, 7, 8, 7], np.uint64)
    h2 = np.array([1, 2, 3, 4, 5], np.uint64)
    shard = linededup.Shard(linededup.pack_shard(h1, h2, np.array([3, 4, 5, 6, 7]), np.array([30, 40, 50, 60, 70])))
    count, keeper = shard.probe(np.append(h1, np.uint64(7)), np.append(h2, np.uint64(9)))
    assert count.tolist() == [3, 4, 5, 6, 7, 0] and keeper.tolist() == [30, 40, 50, 60, 70, 0]


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    rows = [(d, "\n".join(f"a line that is shared, number {i}" for i in range(20))) for d in range(3)]
    found = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {0: 20, 1: 20, 2: 0}


# ---- language and toxicity

TONGUES = {"aa": "kari mona telu sipo rane".split(), "bb": "shtrok vlim grond pfest dwarch".split(), "cc": "ouai eleau iere tion eux".split()}


def sentence(rng, tongue, n=60):
    return " ".join(rng.choice(TONGUES[tongue]) + rng.choice(TONGUES[tongue]) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, t), t) for i, t in enumerate(list(TONGUES) * 40)]
    labelled = spark.createDataFrame(rows[:90] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    asked = [(i, t) for i, t, _ in rows[90:]] + EDGE
    found = langid.identify(clash(spark, asked), labelled)
    assert kept(found, {"lang_pred", "score"})
    found = found.select("doc_id", "text", "lang_pred", "score", "rejected").collect()
    truth = {i: t for i, _, t in rows[90:]}
    assert len(found) == len(asked)
    assert all(r["lang_pred"] == truth[r["doc_id"]] and not r["rejected"] for r in found if r["doc_id"] in truth)
    assert all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        if r["text"] in (None, "", "..."):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
    nothing = langid.identify(clash(spark, asked[:2]), labelled.limit(0))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS), labelled).count() == 0


def test_language_learns_every_label(spark):
    rows = [(3 * k + i, words(60, k, 40).replace("w", "".join(chr(97 + k // 12**j % 12) for j in range(3))), f"l{k:03}") for k in range(200) for i in range(2 if k < 199 else 1)]
    rows = [(i, "".join(chr(ord(c) - 48 + 110) if c.isdigit() else c for c in t), x) for i, t, x in rows]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.fit(labelled)
    assert sorted(found) == sorted({x for _, _, x in rows}) and len(found) == 200
    last = spark.createDataFrame(rows[-1:], "doc_id long, text string, lang string")
    assert langid.identify(last, labelled).first()["lang_pred"] == "l199"


def test_letters_keep_their_marks():
    assert letters("हिन्दी, ภาษา-ไทย: ที่ x_1é E\u0301") == " हिन्दी ภาษา ไทย ที่ x é e\u0301 "
    assert letters(None) == letters("") == letters("1 2 _!") == " "


def test_language_matches_brute_force():
    """Every chunk of every text with a compressor of its own."""
    rng = random.Random(4)
    dictionaries = {t: " ".join(sentence(rng, t) for _ in range(20)).encode() for t in TONGUES}
    texts = [None, "", "12 !", sentence(rng, "aa", 400), sentence(rng, "bb", 3), "हिन्दी " * 300, "kari shtrok ouai"]
    for text, found in zip(texts, langid.Classifier(dictionaries).classify(texts), strict=True):
        own = " ".join(regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()))
        if not own:
            assert found == ("und", 0.0, 0.0, True)
            continue
        data, sizes = f" {own} ".encode(), []
        for t in sorted(dictionaries):
            settings = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, **langid.SETTINGS)
            primed = zstandard.ZstdCompressionDict(dictionaries[t] + langid.FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(compression_params=settings)
            one = lambda part: len(zstandard.ZstdCompressor(dict_data=primed, compression_params=settings).compress(langid.FRAME + part + langid.FRAME))  # noqa: E731, B023
            sizes.append(sum(one(data[i : i + 1024]) for i in range(0, len(data), 1024)))
        assert found[0] == sorted(dictionaries)[sizes.index(min(sizes))]
        assert found[1] == pytest.approx(1 / sum(np.exp(-(s - min(sizes)) / 4) for s in sizes))
        assert found[3] == ((sorted(sizes)[1] - min(sizes)) / sorted(sizes)[1] < 0.003)


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        own = sentence(rng, rng.choice(list(TONGUES)), 80).split()
        bad = i % 5 == 0
        if bad:
            own.insert(rng.randrange(80), rng.choice(["vilething", "grimword", "foulish"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 0, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (999, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks.where(fold("doc_id", 4) != 2))
    found = toxicity.score(clash(spark, rows + EDGE), model)
    assert kept(found, {"score"})
    found = found.select("doc_id", "text", "score", "predicted").collect()
    assert len(found) == len(rows) + len(EDGE)
    truth = {i: y for i, _, y in labels}
    held = [r for r in found if r["doc_id"] in truth and r["text"] == rows[r["doc_id"]][1] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert {r["predicted"] for r in found if not r["text"]} == {0}
    named = docs.withColumns({c: F.lit("x") for c in ("_i", "_t", "_y", "_fold", "toxic", "fragment")})
    again = toxicity.fit(named, marks.where(fold("doc_id", 4) != 2))
    assert (again.toxic, again.ordinary, again.coefficients.tolist()) == (model.toxic, model.ordinary, model.coefficients.tolist())
    for r in found:
        assert r["score"] == pytest.approx(brute_toxicity(model, r["text"]), abs=1e-12)
    empty = toxicity.fit(docs.limit(0), marks.limit(0))
    assert toxicity.score(docs, empty).count() == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_toxicity(model, text):
    """Every window with compressors of its own, and sums over all windows."""
    own = regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())

    def gain(words):
        window = toxicity.FRAME + f" {' '.join(words)} ".encode() + toxicity.FRAME
        sizes = []
        for content in (model.toxic, model.ordinary):
            settings = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, **toxicity.SETTINGS)
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(compression_params=settings)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=primed, compression_params=settings).compress(window)))
        return max(0, sizes[1] - sizes[0])

    split = lambda words, n: [words[i : i + n] for i in range(0, len(words), n - 1) if i == 0 or i + 1 < len(words)]
    saved = [gain(short) for long in split(own, 24) if gain(long) for short in split(long, 4)]
    n, best = len(own) / 3 + 20, [*sorted(saved, reverse=True), 0, 0, 0]
    row = [*best[:3], sum(s >= 2 for s in saved) / n, sum(s >= 2 for s in saved) / n**0.5, sum(s >= 6 for s in saved) / n**0.5, sum(saved) / n, sum(saved) / n**0.5]
    return 1 / (1 + np.exp(-model.coefficients[0] - sum(a * b for a, b in zip(model.coefficients[1:], row, strict=True))))


def test_cover_matches_brute_force():
    rng = random.Random(3)
    found = {f" {words(3, k, 30)} ".encode() for k in range(200)}
    weights = {f: rng.choice([1.0, 2.5, 7.0]) for f in sorted(toxicity.fragments(f"w{i}" for i in range(30))) if rng.random() < 0.5}
    left, want, size = dict(weights), [], 0
    while size < 300:
        value = lambda w: sum(left.get(f, 0) for f in toxicity.fragments(w.decode().split())) / len(w)
        best = min(found, key=lambda w: (-value(w), w))
        if not value(best):
            break
        want.append(best)
        size += len(best)
        for f in toxicity.fragments(best.decode().split()):
            left.pop(f, None)
    assert toxicity.cover(found, weights, 300) == want and len(want) > 5
    toxic, ordinary = toxicity.dictionaries([b" a bad word "], {" bad ": 1.0}, b"common")
    assert (toxic, ordinary) == (b" a bad word  common" + toxicity.FRAME, b" a \0\0\0 word  common" + toxicity.FRAME)


def test_toxicity_reads_one_row_of_a_repeated_id(spark):
    rows = [(i % 7, words(40, i)) for i in range(700)]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 0, i % 2) for i in range(7)], "doc_id long, quality int, toxic int"))
    assert len(model.ordinary) < 7 * 700


@pytest.mark.parametrize("per_class", [1, 40, 5000])
def test_hashed_sample_is_of_the_least_hashes(spark, per_class):
    rows = [(("a", "b", "b", None)[i % 4], i // 2 if i % 5 else None, "x") for i in range(6000)]
    frame = spark.createDataFrame(rows, "c string, i long, _hash string")
    hashed = frame.where("c IS NOT NULL AND i IS NOT NULL").select("c", "i", F.xxhash64("i")).collect()
    want = sorted((c, i) for k in "ab" for c, i, _ in sorted((r for r in hashed if r[0] == k), key=lambda r: (r[2], r[1]))[:per_class])
    assert sorted(map(tuple, hashed_sample(frame, "c", "i", per_class).collect())) == want
    assert hashed_sample(frame.limit(0), "c", "i", per_class).count() == 0


# ---- packing


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 3000)) for i in range(400)] + [(500, 100_001), (501, 0), (502, None), (503, 8192), (3, 77), (3, 77), (None, 5)]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, n_tokens long, bin_id string, capacity int")
    found = packing.pack(frame, shard=100).collect()
    whole = {}
    bins = {}
    for r in found:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
        else:
            assert r["n_tokens"] == 0
    expected = {}
    for doc, n in rows:
        expected[doc] = expected.get(doc, 0) + (n or 0)
    assert {d: sum(n for _, n in p) for d, p in whole.items()} == expected
    for parts in bins.values():
        parts.sort()
        at = 0
        for offset, n, capacity in parts:
            assert offset == at and n > 0
            at += n
        assert at <= capacity == min(c for c in packing.CAPACITIES if c >= at)
    used, held = sum(c[0][2] for c in bins.values()), sum(n or 0 for _, n in rows)
    assert held / used > 0.97
    assert packing.pack(frame.limit(0)).count() == 0


def placed(lengths, choose):
    """Fill of each bin under best fit; ``choose`` names the capacity of a bin by its number, length and what remains."""
    bins = []
    for at, length in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= length]
        if fits:
            least = min(b[0] - b[1] for b in fits)
            chosen = [b for b in fits if b[0] - b[1] == least]
            chosen = max(chosen, key=lambda b: b[2])
        else:
            chosen = [choose(len(bins), length, lengths[at + 1 :]), 0, 0]
            bins.append(chosen)
        chosen[1] += length
        chosen[2] = at
    return [b[1] for b in bins]


def brute_choice(capacities, overhead):
    """The capacity that costs least a token when it is filled from what remains, greatest first."""

    def choose(_, length, rest):
        best = None
        for capacity in capacities:
            if capacity >= length:
                full = length
                for n in sorted(rest, reverse=True):
                    full += n if full + n <= capacity else 0
                cost = (min(c for c in capacities if c >= full) + overhead) / full
                if best is None or cost < best[0] - 1e-12:
                    best = cost, capacity
        return best[1]

    return choose


def test_best_fit_matches_brute_force():
    """The same bins as by trying every capacity at every opening over plain lists, and a cost near the least that any
    choice of capacities gives."""
    rng = random.Random(2)
    worst, better = 1.0, 0
    for trial in range(60):
        capacities, overhead = ((16, 32, 64), (10, 25, 64))[trial % 2], (0, 2, 9)[trial % 3]
        lengths = sorted((rng.choice([rng.randrange(1, 65), rng.randrange(1, 20)]) for _ in range(rng.randrange(1, 10))), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths, capacities, overhead)
        fill = [sum(n for n, b in zip(lengths, bins, strict=True) if b == k) for k in range(len(sizes))]
        assert fill == placed(lengths, brute_choice(capacities, overhead))
        assert sizes == [min(c for c in capacities if c >= f) for f in fill]
        cost = lambda fill: sum(min(c for c in capacities if c >= f) + overhead for f in fill)  # noqa: B023, E731
        every = [cost(placed(lengths, lambda k, n, _, p=plan: next(c for c in capacities if c >= max(n, p[k])))) for plan in product(capacities, repeat=min(6, len(lengths))) if len(lengths) <= 6]  # noqa: B023
        if every:
            worst, better = max(worst, cost(fill) / min(every)), better + (cost(fill) < max(every))
    assert worst < 1.5 and better > 5


def test_best_fit_opens_several_capacities():
    lengths = sorted([500] * 3 + [12] * 3 + [1000, 24], reverse=True)
    _, _, sizes = packing.best_fit(lengths, (512, 1024), overhead=0)
    assert sorted(sizes) == [512, 512, 512, 1024]


def test_packing_spreads_a_repeated_row(spark):
    found = packing.pack(spark.createDataFrame([(7, 100)] * 3000, "doc_id long, n_tokens long"), shard=300).collect()
    shards = {}
    for r in found:
        shards[r["bin_id"] >> 32] = shards.get(r["bin_id"] >> 32, 0) + 1
    assert len(shards) == 10 and max(shards.values()) < 600


# ---- pieces


def test_pieces_match_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   ", "▁", "a▁b", "é ﬁ 日本 \U0001f600", "x\n\ty \r\n", "<s> </s> <unk>", "\x00 \x01", words(500, 9), "w" * 5000, "a \u3000b"]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r for r in pieces.round_trip(clash(spark, rows), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    both = clash(spark, rows).select("doc_id", pieces.encode(F.col("text"), path).alias("ids")).withColumn("back", pieces.decode(F.col("ids"), path))
    for r in both.collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text, add_eos=True)
        assert list(r["ids"]) == ids and r["back"] == library.decode(ids)
        own = found[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(spark.createDataFrame([], DOCS), path).count() == 0
    assert kept(pieces.round_trip(clash(spark, rows), path), {"n_tokens"})
    counted = pieces.with_lengths(clash(spark, rows), path)
    assert kept(counted, {"n_tokens"}) and {r["doc_id"]: r["n_tokens"] for r in counted.collect()} == {i: len(library.encode(t or "", add_eos=True)) for i, t in rows}
    assert pieces.with_lengths(spark.createDataFrame([], DOCS), path).count() == 0


# ---- hosts


def test_hosts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "https://a.example.org/en/12", "https://example.org/en/2", "http://xexample.org/es/", "http://shop.COM/fr/a", "http://shop.com/de/a", "http://shop.com?x", "http://org", "http://a.b://c/d"]
    rows = [(i, u, "h", "p", "v") for i, u in enumerate(urls)] + [(3, "http://", "h", "p", "v")]
    found = hosts.judge(spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string")).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert by[0][:3] == by[1][:3] == by[2][:3] == by[3][:3] == ("", "", None)
    assert by[4] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert by[5][2:] == ("example.org/en/1", "block") and by[6][2:] == ("org/", "allow")
    assert by[7][2:] == ("org/", "allow") and by[8][2:] == ("com/fr/", "allow") and by[9][2:] == ("com/de/", "block")
    assert by[10][:3] == ("shop.com", "", None) and by[11][:3] == ("org", "", None) and by[12][:2] == ("a.b:", "//c/d")
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_registered_domains(spark):
    names = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "example.com:8080": ("example.com", "com"),
        "user:word@www.example.com": ("example.com", "com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"),
        "[::1]:8080": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""), "x.com.au": ("x.com.au", "com.au"),
    }
    rows = hosts.split_url(spark.createDataFrame([(f"http://{n}/p",) for n in names], "url string")).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in rows} == names
    own = hosts.split_url(spark.createDataFrame([("http://a.b.c.d.e/",)], "url string"), suffixes=["c.d.e", "e"]).first()
    assert (own["domain"], own["suffix"]) == ("b.c.d.e", "c.d.e")


@pytest.mark.parametrize("urls", [["http://a.org/x"], ["http://a.org/x", "http://b.com/de/", None, "http://c.net/"], [None], ["no scheme", "http://a.net"]])
def test_hosts_of_single_pages(spark, urls):
    """No host, domain or suffix has two outcomes, or any."""
    found = hosts.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert sorted(r["page_id"] for r in found) == list(range(len(urls)))
    assert all(0 <= r["bound"] + 1 and r["verdict"] in ("allow", "block") for r in found)


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked, one bad page alone is not; siblings share some of the blame."""
    rows = [(i, f"http://bad.evil.net/{i}", 1) for i in range(200)] + [(300, "http://bad.evil.net/new", None), (301, "http://one.fine.net/a", 1), (302, "http://one.fine.net/b", None)]
    rows += [(400 + i, f"http://h{i % 40}.fine.net/{i}", 0) for i in range(400)] + [(900, "http://new.evil.net/x", None), (901, "http://new.fine.net/x", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    by = {r["page_id"]: r for r in hosts.judge(frame, rules=(), outcome_col="bad").collect()}
    assert by[300]["verdict"] == "block" and by[302]["verdict"] == "allow" and by[901]["verdict"] == "allow"
    assert by[900]["bound"] > by[901]["bound"]


# ---- MinHash


def test_minhash(spark):
    a, b = words(400, 1), words(400, 2)
    rows = [*EDGE, (10, a), (11, a), (12, a.upper().replace(" ", "\t")), (13, b)]
    found = minhash.compare_edited(clash(spark, rows)).collect()
    assert len(found) == len(rows)
    order = sorted(range(len(rows)), key=lambda i: (-(rows[i][0] if rows[i][0] is not None else -(2**63)), rows[i][1] or ""))
    by = []
    for k, i in enumerate(order):
        text, following = rows[i][1] or "", rows[order[(k + 1) % len(order)]][1] or ""
        half = len(text) // 2
        by.append((rows[i][0], hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in found), key=repr) == sorted(by, key=repr)
    one = {r["doc_id"]: r for r in found}
    assert one[10]["fingerprint"] == one[11]["fingerprint"] == one[12]["fingerprint"] != one[13]["fingerprint"]
    assert one[11]["near_next"] == 1.0 and one[13]["near_next"] < 0.15 and 0.2 < one[13]["near_edited"] < 0.6
    assert one[1]["fingerprint"] == one[2]["fingerprint"] == minhash.NONE and len(one[4]["fingerprint"]) == minhash.BINS
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    assert minhash.compare_edited(spark.createDataFrame([], DOCS)).count() == 0
    assert minhash.compare_edited(spark.createDataFrame([(5, "a b")], DOCS)).first()["near_next"] == 1.0


def brute_minhash(text):
    """One draw of every bin, hashed as Spark hashes."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    number = lambda v, seed, kind="<q": xxhash.xxh64_intdigest(struct.pack(kind, signed(v % 2**64) if kind == "<q" else v), seed)
    own = [xxhash.xxh64_intdigest(w.translate({c: c + 32 for c in range(65, 91)}).encode(), 42) for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not own:
        return "0" * 128
    least = {}
    for i in range(max(1, len(own) - 4)):
        h = 42
        for w in own[i : i + 5]:
            h = number(w, h)
        b = (signed(h) >> 57) + 64
        least[b] = min(signed(h), least.get(b, 2**63))
    out = []
    for b in range(128):
        if b in least:
            out.append(least[b] % 16)
        else:
            donor = min(least, key=lambda d: (signed(number(d, number(b, 42, "<i"), "<i")), least[d]))
            out.append(number(b, number(least[donor], 42), "<i") % 16)
    return "".join(f"{d:x}" for d in out)


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", " \x0b", "one", "A b C", words(6, 1), words(60, 2), words(3000, 3), "É ünï Ünï cödé\u00a0x y z"]
    found = minhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert [r["fingerprint"] for r in sorted(found)] == list(map(brute_minhash, texts))
    assert sum(len(set(f)) > 1 for f in map(brute_minhash, texts)) >= 5


def test_next_over_many_ranges(spark):
    ids = [i * i for i in range(300)] + [10**15]
    rows = minhash.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS), "doc_id", ["text"], bucket=10).collect()
    falling = sorted(ids, reverse=True)
    want = {i: f"t{falling[(k + 1) % len(falling)]}" for k, i in enumerate(falling)}
    assert {r["doc_id"]: r["next_text"] for r in rows} == want


def test_likeness_is_unbiased(spark):
    rng = random.Random(8)
    pairs, truth = [], []
    for i in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 300]))]
        cut = rng.randrange(len(own))
        other = own[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(len(own) - cut)]
        pairs.append((i, " ".join(own), " ".join(other)))
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (own, other)]
        truth.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    frame = spark.createDataFrame(pairs, "i int, a string, b string")
    got = frame.select("i", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("l")).orderBy("i").collect()
    errors = np.array([r["l"] for r in got]) - np.array(truth)
    assert abs(errors.mean()) < 0.015 and np.sqrt((errors**2).mean()) < 0.07


# ---- WARC


def test_warc_round_trip(spark):
    forged = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + warc.record("response", "77", "u", b"payload" * 30, "00", None).decode()
    big = "big page " * 3000
    rows = [(5, "http://a/\r\nb é", big), (3, "u", big), (9, None, big), (4, "u", "small"), (2, "u", "small"), (1, "u", None), (8, "u", ""), (7, "u", forged), (None, "u", "no id"), (6, "u", forged), (3, "u", big), (None, "u", big), (10, "u", "WARC/1.1\r\n" * 40)]
    rows += [(LARGE, "u", "another page " * 9), (LARGE + 2, "u", "another page " * 9)]
    frame = spark.createDataFrame([(*r, "t", "d") for r in rows], "page_id long, url string, html string, record_type string, digest string")
    for split in (warc.SPLIT, 1000):
        found = warc.read(warc.write(frame), split).collect()
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            again = len(data) >= 100 and same and page != min(same)
            want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
        assert got == sorted(want, key=repr)
    assert warc.read(warc.write(frame.limit(0))).count() == 0


def test_warc_reads_long_headers_across_ranges(spark):
    rows = [(i, f"http://a/{i}/" + "é" * 250_000, "some page " * 20 + str(i)) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read(warc.write(frame.coalesce(1)), 70_000).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(i, 201) for i in range(3)]


# ---- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 16)).astype(np.float32)
    data[100:200] = data[100]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] + [1.0] * 15), (1080, [float("inf")] * 16), (1100, [1.0, None] + [1.0] * 14), (1120, [1.0] * 3), (None, [1.0] * 16), (20, data[20].tolist())]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    found = ann.search(frame, F.col("vec_id") % 20 == 0, segment=150, block=10).collect()
    own = {}
    for r in found:
        own.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(own) == list(range(0, 600, 20))
    exact = data.astype(np.float64)
    hits = 0
    for q, rest in own.items():
        rest.sort()
        scores = (exact * exact[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        assert [r for r, *_ in rest] == list(range(1, 21)) and all(s == scores[v] for _, v, s in rest)
        assert [(-s, v) for _, v, s in rest] == sorted((-s, v) for _, v, s in rest)
        hits += len({v for _, v, _ in rest} & set(order))
    assert hits / (20 * len(own)) >= 0.9
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0
