"""Source divergence, repeated passages and spelling variants against brute force, with every edge."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, texts
from tracewright.llm import divergence, seeds, variants
from tracewright.llm.common import Scratch, owned


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# Divergence


def audited(docs, min_docs, top):
    held = [(lang or "", source or "", [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in docs]
    out = []
    for lang in {h[0] for h in held}:
        mine = [h for h in held if h[0] == lang]
        kept = {t for t, n in Counter(t for _, _, ts in mine for t in set(ts)).items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, ts in mine:
            counts[source].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        for a in counts:
            pairs = [(-sum(abs(share(counts[a], t) - share(counts[b], t)) for t in kept), b) for b in counts if b != a]
            terms = [(share(whole, t) - share(counts[a], t), t) for t in counts[a]]
            out += [(lang, a, "pair", b, -v, i) for i, (v, b) in enumerate(sorted(pairs), 1)]
            out += [(lang, a, "term", t, -v, i) for i, (v, t) in enumerate(sorted((v, t) for v, t in terms if v < 0)[:top], 1)]
    return sorted(out, key=str)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        words = [rng.choice(["Über", "über", "the", "The", "naïve", "日本", "x1y", f"w{rng.randrange(9)}", "zoë"]) for _ in range(rng.randrange(30))]
        docs.append((" ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]) if i % 3 else "a"))
    docs += [(None, None, None), ("", "xx", "lone"), ("!!! 123", "de", "quiet"), ("the " * 5000, "en", "long"), ("rare words", "yy", "p"), ("other", "yy", "q")] * 2
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n long").repartition(3)
    found = divergence.audit(df, min_docs=4, top_terms=3)
    assert rows_of(found, "lang", "source", "part", "item", "value", "rank") == audited(docs, 4, 3)
    assert [r.value for r in found.where("lang = 'yy'").collect()] == [0, 0]  # no kept term
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    cases = [(10**13, 3 * 10**13, 10**6), (0, 0, 1), (0, 0, 0), (0, 10**15, 1), (7, 7, 1)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got[:2] + got[3:] == [1 + 10**9 * (n + 5) // (t + 5 * k) for n, t, k in cases if k]


# Repeated passages


def covered(rows, length):
    """Per row the flags of its words: covered by a stretch that starts earlier, too."""
    texts_ = [(t or "").encode("utf-8", "surrogatepass").split() for _, t in rows]
    places = defaultdict(list)
    for r, (words, (i, _)) in enumerate(zip(texts_, rows, strict=True)):
        if i is not None:
            for s in range(len(words) - length + 1):
                places[tuple(words[s : s + length])].append((i, r, s))
    flags = [[False] * len(w) for w in texts_]
    for held in places.values():
        for i, r, s in held:
            if any(j < i or (q == r and z < s) for j, q, z in held):
                flags[r][s : s + length] = [True] * length
    return texts_, flags


def check_repeats(spark, rows, length):
    words, flags = covered(rows, length)
    df = frame(spark, rows)
    kept = [b" ".join(w for w, f in zip(ws, fs, strict=True) if not f).decode("utf-8", "surrogatepass") for ws, fs in zip(words, flags, strict=True)]
    want = sorted(((i, len(ws), sum(fs), k) for (i, _), ws, fs, k in zip(rows, words, flags, kept, strict=True)), key=str)
    found = seeds.remove_repeats(df, length)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept") == want
    by_row = defaultdict(set)
    for r in seeds.repeats(df, length).collect():
        assert r.n_words >= length and (r.first_doc, r.first_start) < (r.doc_id, r.start)
        by_row[r.doc_id, r.text_hash] |= set(range(r.start, r.start + r.n_words))
    ids = {(r.doc_id, r.h): r.text for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFFFFFF).alias("h"), F.coalesce("text", F.lit("")).alias("text")).collect()}
    for (i, t), fs in zip(rows, flags, strict=True):
        key = next((k for k, v in ids.items() if k[0] == i and v == (t or "")), None)
        assert by_row.get(key, set()) == {n for n, f in enumerate(fs) if f}


def test_repeats_equal_brute_force(spark):
    check_repeats(spark, texts() + [(2, "a different text under an id that another row has " * 4), (20, "a different text under an id that another row has " * 4)], 20)


def test_repeats_of_few_words_everywhere(spark, monkeypatch):
    """A line that all documents hold within different words makes its anchors hot; they are dealt by stretch."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3))
    line = " ".join(word() for _ in range(11))
    rows = [(i, " ".join([word() for _ in range(rng.randrange(30))] + line.split() + [word() for _ in range(rng.randrange(30))])) for i in range(150)]
    rows += [(i + 200, rows[i][1]) for i in range(0, 150, 7)] + [(999, "x y " * 200)]
    monkeypatch.setattr(seeds, "SAMPLE", 1)
    monkeypatch.setattr(seeds, "HOT", 1)
    check_repeats(spark, rows, 12)


def test_maximal_repeats(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(70)]
    fill = lambda n: [f"{rng.random()}" for _ in range(n)]
    rows = [(1, " ".join(fill(9) + passage + fill(9))), (2, " ".join(fill(3) + passage + fill(5))), (3, " ".join(passage[10:40]))]
    found = seeds.repeats(frame(spark, rows), 20)
    assert rows_of(found, "doc_id", "start", "n_words", "first_doc", "first_start") == [(2, 3, 70, 1, 9), (3, 0, 30, 1, 19)]
    assert seeds.repeats(empty(spark)).count() == 0 and seeds.remove_repeats(empty(spark)).count() == 0


def test_what_all_documents_hold_is_sent_once_a_task(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(500)]
    docs = seeds._identified(frame(spark, rows).coalesce(2), "doc_id", "text")
    asked = docs.select("doc_id", "text_hash", "text").mapInArrow(seeds._anchors(20), seeds.MEET_SCHEMA)
    anchors = asked.select("anchor").distinct().count()
    assert asked.where("state <> 2").count() <= 2 * anchors and asked.where("state = 2").count() == 500 * anchors
    shared = asked.groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    sent = seeds._compressed(docs).join(F.broadcast(shared), "doc_id").select("doc_id", "text_hash", "size", "body", "shared").mapInArrow(seeds._plant(20), seeds.SEED_SCHEMA)
    assert sent.where("first_doc is null").agg(F.sum("n")).first()[0] <= 2 * 21


# Spelling variants


def slipped(docs, every, least_length, least_count):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def edits(word):
    letters = {c for w in (word,) for c in w} | set("abcdefghijklmnopqrstuvwxyzé")
    halves = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in halves if b} | {a + c + b[1:] for a, b in halves if b for c in letters} | {a + c + b for a, b in halves for c in letters}) - {word}


def grouped(words, ratio):
    out = {}
    for w, n in words.items():
        near = [v for v in edits(w) if v in words]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (top if top and words[top] >= ratio * n else None, n, len(near))
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, form, root, n, k, words[form] if form else None


def test_dictionary_equals_brute_force(spark):
    for every in (None, 3):
        found = variants.dictionary(frame(spark), every, 3, 2)
        assert dict(rows_of(found, "word", "n")) == slipped(texts(), every, 3, 2)
    assert variants.dictionary(empty(spark)).count() == 0


def test_variants_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(2, 9))) for _ in range(300)] + ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)]
    words = {w: rng.choice([5, 6, 30, 30, 200, 1000]) for b in base for w in [b, *rng.sample(sorted(edits(b)), 3)] if len(w) > 1}
    words |= {"z" * 3000: 5, "z" * 3001: 50, "z" * 1500 + "y" + "z" * 1499: 7}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [(None, 5, "x", 1), ("", 5, "x", 1)], "word string, n long, form string, near_n long")
    want = sorted(grouped(words, 5), key=str)
    for block in (4, 128):  # small blocks are divided to the end
        assert rows_of(variants.group_variants(df, 5, block), "word", "form", "root", "n", "n_near", "form_n") == want
    assert variants.group_variants(df.limit(0)).count() == 0


def test_large_blocks_are_divided(spark):
    """Words that all share their first and last letters."""
    words = {f"abcdef{a}{b}{c}uvwxyz": 5 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    with Scratch(spark) as scratch:
        assert variants.near_words(df, scratch, 16).groupBy("word").count().where("count = 21").count() == 512


# Tables that results keep


def test_tables_go_with_their_owner_only(spark):
    rows = [("abcdef", 5), ("abcdex", 50)]
    df = spark.createDataFrame(rows, "word string, n long")
    before = variants.group_variants(df)
    with owned(spark) as paths:
        inside = variants.group_variants(df)
        assert inside.count() == 2 and paths
    assert rows_of(before, "word", "form") == [("abcdef", "abcdex"), ("abcdex", None)]
