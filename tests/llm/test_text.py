import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import empty, frame, texts
from tracewright.llm import common, language, packing, pieces, quality, token_counts

JSON, RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_ranks_give_the_ids_of_the_tokenizer(tokenizer):
    encode = common.encoder(RANKS)
    for _, text in texts():
        assert encode(text or "").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, tokenizer):
    rows = texts()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame(spark), JSON).collect())
    counts = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted((i is None, i or 0, b, n, n > 512) for i, b, n in counts)
    assert token_counts.token_counts(empty(spark), JSON).collect() == []


def test_pre_tokens_agree_on_all_planes(tokenizer):
    split = token_counts._splitter(JSON)
    for first in [*range(0, 0xD800, 64), *range(0xE000, 0x11000, 64), *range(0x1F000, 0x1FB00, 64)]:
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b " for c in range(first, first + 64))
        words, special = split.pre_tokens(text)
        assert special + sum(split.pieces(words)) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_places_every_id_once(spark, tokenizer, capacity):
    rows = [(i, t) for n, (i, t) in enumerate(texts()) if i is not None and n != 52]
    got = packing.pack_documents(frame(spark, rows), RANKS, capacity=capacity, window=3000, with_ids=True).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    copies = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    for i, part in got.groupby("doc_id"):
        part = part.sort_values("start")
        assert part.length.sum() == copies[i] * len(ids[i]) and (part.doc_tokens == len(ids[i])).all()
        for p in part.itertuples():
            own = ids[i][p.start : p.start + p.length]
            assert list(p.ids) == own and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= capacity
    assert packing.pack_documents(empty(spark), RANKS).collect() == []


def test_assignment_is_balanced_and_full():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 500).tolist()
    found = packing.assign(lengths, 1024)
    fill, cost = {}, {}
    for item, start, n, s, _ in found:
        fill[s] = fill.get(s, 0) + n
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + n * n
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= 1024
    assert 1024 * len(fill) - sum(lengths) < 1024
    assert max(cost.values()) < 1.15 * min(cost.values())
    assert packing.assign([], 1024) == []


def test_assignment_equals_brute_force():
    """Every piece goes, in descending order of items, to the cheapest sequence with room for it whole, else to the cheapest with any room; ties go to the fuller one."""
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 64):
        for _ in range(30):
            lengths = rng.integers(1, 2 * capacity + 2, rng.integers(1, 25)).tolist()
            sequences = [[0.0, capacity, s] for s in range(-(-sum(lengths) // capacity))]
            want = []
            for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                start, left = 0, lengths[item]
                while left:
                    chosen = min([q for q in sequences if q[1] >= left] or [q for q in sequences if q[1]])
                    take = min(left, chosen[1])
                    want.append((item, start, take, chosen[2], capacity - chosen[1]))
                    chosen[0], chosen[1] = chosen[0] + packing.LINEAR * take + take * take, chosen[1] - take
                    start, left = start + take, left - take
            assert packing.assign(lengths, capacity) == want


def test_repeated_ids_leave_texts_of_both_labels(spark):
    rows = [(i, f"{'junk !!! 000' if i % 2 else 'a calm and quiet harbour'} {i}") for i in range(20)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    once = quality.train(frame(spark, rows), labels, per_class=10)
    hot = [(1, rows[1][1])] * 60
    for repeated in (rows * 5, rows + hot):
        model = quality.train(frame(spark, repeated), labels, per_class=10)
        assert sorted(model.labels) == [0] * 10 + [1] * 10 == sorted(once.labels)
        assert np.allclose(model.vectors @ model.vectors.T, once.vectors @ once.vectors.T, atol=1e-4) and (model.votes == 1).all()
    apart = quality.train(frame(spark, [*rows, (0, "zzz"), (0, "yyy")]), labels, per_class=10)
    assert len(apart.labels) == 20


def test_transducer_agrees_with_the_library():
    library, machine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Transducer(MODEL)
    rng = np.random.default_rng(3)
    hard = ["a  b", "  x", "x ", "a\nb\n\n  c", "▁a", "<s> x <unk><0x0A>", "internationalization of 12345", "            deep", "xxxxxxxxxxxxxxxxxxxx", "hhheeelllooo"]
    hard += ["".join(rng.choice(list("abcdehinorst  .,é"), 80)) for _ in range(40)]
    hard += ["".join(str(x).replace("▁", " ") for x in rng.choice(machine.names[260:], 40)) for _ in range(40)]
    for text in [t or "" for _, t in texts()] + hard:
        ids = [i for w in machine.words(text) for i in machine.encode_word(w)]
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids)


def unigram(path, fallback: bool):
    """Writes a unigram model of made pieces with distinct weights; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2

    model, rng = sentencepiece_model_pb2.ModelProto(), np.random.default_rng(5)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, fallback
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.name = "identity"
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback]
    made = {"▁", *"abcde", *("".join(rng.choice(list("▁abcde"), rng.integers(2, 6))) for _ in range(120))}
    for piece, score, kind in pieces_ + [(m, -float(rng.uniform(1, 12)), 1) for m in sorted(made)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_unigram_paths_agree_with_the_library(tmp_path):
    rng, path = np.random.default_rng(9), unigram(tmp_path / "made.model", True)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    for text in ["", " ", "a", "é a", "  abc"] + ["".join(rng.choice(list("abcde  xé"), rng.integers(1, 60))) for _ in range(400)]:
        ids = [i for w in machine.words(text) for i in machine.encode_word(w)]
        assert ids == library.encode(text), text
        assert machine.decode(ids) == library.decode(ids)


def test_encode_and_decode_tables(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 2]
    back = pieces.decode(pieces.encode(frame(spark, rows), MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    trip = pieces.round_trip(frame(spark), MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((len(library.encode(t or "")), zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes())) for _, t in texts())
    assert all(r.round_trip for r in trip) and sorted((r.n_pieces, r.ids_crc32) for r in trip) == want
    assert pieces.round_trip(empty(spark), MODEL).collect() == []


ENGLISH = "the quick brown fox jumps over the lazy dog and then the other things that were with this"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann ist die andere sache mit einer"


def test_language_profiles(spark):
    rows = [("en", ENGLISH), ("de", GERMAN), ("en", ENGLISH[20:]), ("de", GERMAN[20:]), (None, ENGLISH), ("en", None)]
    known = spark.createDataFrame(rows, "lang string, text string")
    profiles = language.train(known)
    assert list(profiles) == ["de", "en"]
    cases = [(1, "there were other things with the dog"), (2, "die andere sache über einer"), (3, None), (4, ""), (5, "123 !!"), (6, "THE OTHER THINGS"), (None, "the dog")]
    got = {r.doc_id: r for r in language.predict(frame(spark, cases), profiles, keep=["component_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.lang_pred != "und") and r.component_id == "x" for r in got.values())
    assert language.train(known.limit(0)) == {}
    assert {r.lang_pred for r in language.predict(frame(spark, cases), {}).collect()} == {"und"}
    assert language.predict(empty(spark), profiles).collect() == []


def test_bundles_are_sums_of_bound_trigrams():
    (vector,) = language.bundles(["ab"])
    letters = language._letter_vectors().astype(int)
    bind = lambda a, b, c: np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert (vector == bind(0, 1, 2) + bind(1, 2, 0)).all()


def test_quality_votes(spark):
    good = [(i, " ".join(f"word{chr(97 + (i * j) % 26)}{chr(97 + j % 26)} of the" for j in range(20))) for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! " * (5 + i)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:30]] + [(i, 0) for i, _ in bad[:30]] + [(35, 1), (35, 0), (None, 1), (36, None), (999, 1)], "doc_id long, quality int")
    docs = frame(spark, [*good, *bad, (500, None), (501, ""), (None, "BUY!! NOW!!")])
    model = quality.train(docs, labels, per_class=20)
    assert len(model.labels) <= 40
    got = {r.doc_id: r for r in quality.score(docs, model, keep=["label"]).collect()}
    assert all(got[i].predicted == 1 for i, _ in good) and all(got[i].predicted == 0 for i, _ in bad)
    assert got[500].score == got[501].score == model.prior and got[None].predicted == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), model).collect() == []


def test_predictions_match_brute_force(spark):
    """Profiles and cosines by loops over letters, for whole texts of several languages."""
    letters, symbols = language._letter_vectors().astype(int), language._symbols()

    def bundle(text):
        codes = [0] + [int(symbols[ord(c)]) for c in (text or "").replace("\0", " ").lower()] + [0]
        out = np.zeros(language.DIMENSIONS, int)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if b:
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    rows = [(1, "the cat sat on the mat and the dog ran", "en"), (2, "der Hund und die Katze sind im Garten", "de"), (3, "le chat est sur la table avec le chien", "fr"), (4, "the dog and the cat", "en")]
    asked = [*rows, (5, "die Katze", None), (6, "", "en"), (7, None, "en"), (8, "12 !", "en"), (9, "la table " * 50_000, None), (10, "日本語", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = {}
    for _, text, lang in rows:
        profiles[lang] = profiles.get(lang, 0) + bundle(text)
    names = sorted(profiles)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), language.train(train)).collect()}
    for i, text, _ in asked:
        vector = bundle(text if i != 9 else "la table " * 50)
        if not vector.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = [vector @ profiles[n] / np.linalg.norm(vector) / np.linalg.norm(profiles[n]) for n in names]
        assert got[i].lang_pred == names[int(np.argmax(cosines))]
        assert abs(got[i].score - min(1, max(0, max(cosines)))) < (1e-5 if i != 9 else 1e-2)


def test_nearest_with_ties_equals_sorting():
    rng = np.random.default_rng(5)
    for columns in (3, 16, 40):
        cosine = rng.integers(-2, 3, (50, columns)).astype(np.float32) / 2
        got = quality.nearest(cosine, 16)
        want = [set(sorted(range(columns), key=lambda j, row=row: (-row[j], j))[:16]) for row in cosine]
        assert [set(np.flatnonzero(r)) for r in got] == want


def test_quality_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(t for _, t in texts() if t and len(t) < 3000)]
    rows += [(1000 + i, t) for i, t in rows[:9]]  # copies with another label
    labels = spark.createDataFrame([(i, int(i >= 1000) or i % 2) for i, _ in rows if i % 3], "doc_id long, quality int")
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (5002, "the " * 200_000)])
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, text in [*rows, (5000, None), (5001, ""), (5002, "the " * 200_000)]:
        cosine = model.latent(quality.term_counts([text]))[0] @ model.vectors.T
        near = sorted(range(len(cosine)), key=lambda j: (-cosine[j], j))[: quality.NEIGHBOURS]
        votes = [(max(float(cosine[j]), 0.0) ** quality.SHARPNESS * float(model.votes[j]), float(model.labels[j])) for j in near]
        total = sum(v for v, _ in votes)
        assert abs(got[i] - (sum(v * x for v, x in votes) / total if total else model.prior)) < 1e-4
    assert len(got) == len(rows) + 3 and quality.score(docs.limit(0), model).count() == 0


def test_pre_tokens_of_all_documents_are_dealt_by_slices(spark, tokenizer):
    """A rare pre-token of several pieces that every document has."""
    rows = [(i, f"zzqxvblorg zzqxvblorg {'word ' * (i % 5)}kjw{i % 9}xx") for i in range(600)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, JSON).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}
    packed = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_bytes")).repartition(6).mapInArrow(token_counts._pack(JSON, 50), token_counts.PACKED)
    holders = [r.bucket for r in packed.where("bucket >= 0").collect() for p in r.parts if b"zzqxvblorg" in token_counts._unsqueeze(p.size, p.packed)[0]]
    assert len(set(holders)) > 1
