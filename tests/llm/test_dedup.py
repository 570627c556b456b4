import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import empty, frame, texts
from tracewright.llm import common, embeddings, minhash, suffixes


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets(text, words):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else ({tuple(found)} if found else set())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_brute_force(spark, words):
    rows = texts()
    got = minhash.near_duplicates(frame(spark), words=words).collect()
    assert len(got) == len(rows)
    known = {i: sets(t, words) for i, t in rows if i is not None}
    links = [(a, b) for a in known for b in known if a < b and known[a] and 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b]) and known[a] & known[b]]
    want = components(known, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(known[r.doc_id]))


def test_classes_and_links_are_confirmed_on_full_sets(monkeypatch):
    monkeypatch.setattr(minhash._WordHash, "__missing__", lambda self, word: 7)  # every word hashes alike
    texts = pa.array(["a b c", "d e f", "a b c a b c", "c b a", "x", "y"])
    ids = pa.array(range(6), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, texts, ids], names=["doc_id", "text", "text_hash"])
    (found,) = minhash._sketch_batches(2)(iter([batch]))
    assert len(set(found.column("sketch").to_pylist()[:4])) == 1
    assert len(set(found.column("digest").to_pylist())) == 6
    assert found.column("n_shingles").to_pylist() == [2, 2, 3, 2, 1, 1]
    none = np.zeros(4, np.int64)
    assert minhash.spanning_links(texts.to_pylist()[:4], np.arange(4), none, 2, 80, minhash._WordHash()) == []


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "some other words are in here"), (2, "some other words are in here")]
    got = minhash.near_duplicates(frame(spark, rows)).join(frame(spark, rows).selectExpr("doc_id", "xxhash64(text) as text_hash", "text").distinct(), ["doc_id", "text_hash"]).collect()
    assert sorted((r.doc_id, r.text[:3], r.component_id) for r in got) == [(1, "one", 1), (2, "one", 1), (2, "som", 2), (2, "som", 2)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 60, 40).astype(np.uint64)])
    one, two, tiny = minhash.sketch([a, b, a[:1]])
    assert (one != minhash._EMPTY).all() and (tiny != minhash._EMPTY).all()
    assert abs((one == two).mean() - 360 / 440) < 0.12


def test_a_large_mixed_bucket_is_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "CLUSTER_TILE", 3)
    rows = [(i, t) for i, t in texts() if i is not None]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), words=5).collect()}
    known = {i: sets(t, 5) for i, t in rows}
    links = [(a, b) for a in known for b in known if a < b and known[a] & known[b] and 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b])]
    assert got == components(known, links)


def test_components_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 50)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 1), (5, 5)]
    with common.Scratch(spark) as scratch:
        got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)


def without_repeats(rows, window=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for k in range(len(data) - window + 1):
                w = data[k : k + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - window + 1):
            if i is not None and first[data[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize(("slice_bytes", "batch", "segment", "bucket", "hot"), [(4 << 20, 1 << 16, 8 << 20, 16 << 20, 1 << 16), (3000, 40, 700, 4000, 1 << 16), (3000, 40, 700, 4000, 4)])
def test_repeats_match_brute_force(spark, monkeypatch, slice_bytes, batch, segment, bucket, hot):
    rows = texts() + [(200, "x" * 500), (201, "y" + "x" * 200), (202, ("é" * 40 + "z") * 4), (203, "ö" + "é" * 40 + "zé"), (204, "\0" * 130), (205, "a" + "\0" * 70)]
    # A passage with other words around it in every document: its ends are grams with very many different cells.
    rng, passage = random.Random(1), " ".join(f"common{i}" for i in range(12))
    rows += [(300 + i, f"{rng.random()} {passage} {rng.random()}") for i in range(40)]
    for name, value in {"SLICE": slice_bytes, "BATCH": batch, "SEGMENT": segment, "BUCKET": bucket, "HOT": hot}.items():
        monkeypatch.setattr(suffixes, name, value)
    got = [tuple(r) for r in suffixes.remove_repeats(frame(spark, rows), with_text=True).collect()]
    assert order(got) == order(without_repeats(rows))


def test_a_hot_gram_is_dealt_by_windows(spark, monkeypatch):
    rng, passage = random.Random(1), " ".join(f"common{i}" for i in range(12))
    docs = frame(spark, [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(200)]).selectExpr("doc_id", "crc32(text) as mark", "text")
    monkeypatch.setattr(suffixes, "HOT", 50)
    with common.Scratch(spark) as scratch:
        hot = suffixes._hot_grams(docs, 1 << 15, scratch)
    assert 2 <= len(hot) < 12
    buckets = {}
    for grams in (hot[:0], hot):
        rows = docs.mapInArrow(suffixes._suffix_batches(64, grams), suffixes.SUFFIXES).where("body is not null").groupBy("bucket").sum("n").collect()
        buckets[len(grams)] = max(r[1] for r in rows) / sum(r[1] for r in rows)
    assert buckets[len(hot)] < buckets[0] / 2


def test_repeats_keep_columns_and_empty_tables(spark):
    assert suffixes.remove_repeats(empty(spark)).collect() == []
    got = suffixes.remove_repeats(frame(spark), carry=["source", "g", "n_chars"])
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "source", "g", "n_chars"]
    assert {r.source for r in got.collect()} == {"s"}


def test_family_merges_levels_of_equal_rank():
    family = suffixes.Family()

    def batch(words, doc):
        data = [w.encode().ljust(60, b".") for w in words]
        gram = np.arange(len(data)) * 60
        rows = suffixes.records(b"".join(data), gram, np.zeros(len(data), np.int64), np.full(len(data), 50))
        return suffixes.Suffixes.of(rows, np.full(len(data), doc), np.zeros(len(data), np.int64), gram)

    for i in range(11):
        found = list(family.scan(batch([f"word {4 * i + j} of a document" for j in range(4)], i)))
        assert sum(len(f[0]) for f in found) == 0
    assert [rank for rank, _ in family.levels] == [3, 1, 0]
    for _, level in family.levels:
        named = [bytes(r) for r in level.rows]
        assert named == sorted(named)
    found = list(family.scan(batch(["word 7 of a document", "another word of it"], 99)))
    assert [int(d) for f in found for d in f[0]] == [99]
    # A smaller document that comes later is matched by those that were there.
    found = list(family.scan(batch(["word 9 of a document"], -1)))
    assert [int(d) for f in found for d in f[0]] == [2]


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 40))
    vectors = [(i, (base[i % 6] + 0.1 * rng.normal(size=40)).astype(np.float32).tolist(), i % 2) for i in range(80)]
    odd = [(200, None, 1), (201, [0.0] * 40, 1), (202, [float("nan")] * 40, 1), (203, [1.0, None] * 20, 1), (204, vectors[0][1], None), (205, vectors[0][1], 0), (205, vectors[0][1], 0), (206, [2 * x for x in vectors[0][1]], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (209, [], 0), (210, [float("inf")] * 40, 0)]
    rows = vectors + odd
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, links = [0] * len(good), []
    for x in range(len(good)):
        for y in range(x):
            (a, v, c), (b, w, d) = good[x], good[y]
            if c == d and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                n[x], n[y] = n[x] + 1, n[y] + 1
                links.append((a, b))
    want = components({r[0] for r in rows}, [x for x in links if x[0] != x[1]])
    counts = {g[0]: k for g, k in zip(good, n, strict=True)}
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (counts.get(r.vec_id, 0), want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_tiles_and_slabs_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = [(i, (np.ones(20) + 0.12 * rng.normal(size=20)).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    whole = sorted(embeddings.near_duplicates(df).collect())
    monkeypatch.setattr(embeddings, "TILE", 7)
    assert sorted(embeddings.near_duplicates(df).collect()) == whole
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_copies_of_a_vector_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(11)
    copies = []
    for n in (300, 1200):
        centres = rng.normal(size=(n // 10, 24))
        vectors = [(i, (centres[i % len(centres)] + 0.02 * rng.normal(size=24)).tolist(), 1) for i in range(n)]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
        sizes = []
        monkeypatch.setattr(embeddings, "_meetings", lambda tiled, width, scratch, real=meetings: sizes.append((real(tiled, width, scratch).join(tiled, ["label", "size", "cell", "tile"]).count(), tiled.count())) or real(tiled, width, scratch))
        got = embeddings.near_duplicates(df).collect()
        assert len({r.component_id for r in got}) == len(centres)
        copies.append(sizes[0][0] / sizes[0][1])
    assert copies[1] < 2 * copies[0]


meetings = embeddings._meetings
