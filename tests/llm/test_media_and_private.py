import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import empty, frame
from tracewright.llm import chroma, surrogates


def tone(seconds, *pitches, seed=0):
    t = np.arange(int(seconds * chroma.RATE)) / chroma.RATE
    wave = sum(np.sin(2 * np.pi * 220 * 2 ** (p / 12) * (t - i * 0.05)) * ((t * 8).astype(int) % len(pitches) == i) for i, p in enumerate(pitches))
    return np.clip(128 + 60 * wave + np.random.default_rng(seed).normal(size=len(t)), 0, 255).astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def recordings():
    song, other = tone(2, 0, 4, 7, 9, 2), tone(2, 1, 6, 10)
    rows = [(50, song), (1, song), (2, song[64 * 20 :]), (3, other), (100, other[64 * 30 :]), (150, None), (4, b""), (5, b"\x80" * 9000), (200, song), (None, song), (250, b"\x80" * 9000)]
    return rows + [(i, tone(1, i % 12, (3 * i) % 12, seed=i)) for i in range(10, 22)]


def test_alignment_matches_brute_force(spark, recordings):
    df = spark.createDataFrame([(*r, "x") for r in recordings], "doc_id long, samples binary, rep string").repartition(3)
    got = chroma.align(chroma.fingerprints(df)).collect()
    assert len(got) == len(recordings)
    found = [(i, chroma.items(chroma.pitch_frames(np.frombuffer(s or b"", np.uint8)))) for i, s in recordings]
    for r in got:
        own = next(x for i, x in found if i == r.doc_id)
        if r.doc_id is None or r.doc_id % 50 or not len(own):
            assert r.n_matches is None
            continue
        best, n = None, 0
        for i, x in found:
            if i is None or i == r.doc_id or not len(x):
                continue
            votes = Counter(int(b - a) for a in range(len(own)) for b in np.flatnonzero(x == own[a]))
            if not votes:
                continue
            offset = min(votes, key=lambda o: (-votes[o], o))
            start = max(0, -offset)
            overlap = min(len(own), len(x) - offset) - start
            same = len(x) == len(own) and (x == own).all()
            if same:
                offset, start, overlap = 0, 0, len(own)
            elif votes[offset] < chroma.VOTES or overlap < chroma.OVERLAP:
                continue
            error = np.bitwise_count(own[start : start + overlap] ^ x[start + offset : start + offset + overlap]).sum() / (32 * overlap)
            if error <= chroma.BIT_ERROR:
                n += 1
                key = (not same, float(error), -overlap, i, offset)
                best = min(best, key) if best else key
        assert r.n_matches == n
        if best:
            assert (r.bit_error, -r.match_overlap, r.match_id, r.match_offset) == pytest.approx(best[1:])


def test_a_shifted_recording_aligns(spark, recordings):
    df = spark.createDataFrame([(50, recordings[0][1]), (2, recordings[2][1])], "doc_id long, samples binary")
    row = next(r for r in chroma.align(chroma.fingerprints(df)).collect() if r.doc_id == 50)
    assert (row.match_id, row.match_offset, row.bit_error) == (2, -20, 0.0)
    assert chroma.align(chroma.fingerprints(df.limit(0))).collect() == []


def test_short_recordings_have_items_and_meet_their_copies(spark):
    words = "the quiet harbour kept seven lanterns burning while old sailors counted coins and argued about winter storms near the broken pier until morning came with gulls and salt on every wet rope".split()
    text, other = " ".join(words), " ".join(reversed(words))[:170]
    near = text.replace("coins", "stamps")
    rows = [(50, text), (1, near), (2, other), (100, "ok"), (3, "ok"), (150, "x"), (200, words[0] * 400), (4, words[0] * 400 + "!"), (5, "")]
    df = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc_id long, samples binary")
    got = {r.doc_id: r for r in chroma.align(chroma.fingerprints(df)).collect()}
    assert all((got[i].n_items >= chroma.OVERLAP) == (t != "") for i, t in rows)
    assert got[50].match_id == 1 and got[50].n_matches == 1 and got[50].bit_error < 0.1
    assert (got[100].match_id, got[100].bit_error, got[100].match_offset) == (3, 0.0, 0)
    assert got[200].match_id == 4 and got[150].n_matches is not None


def test_every_matching_class_and_shared_passages(spark):
    noise = lambda seed, n: np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8).tobytes()
    song, passage = tone(2, 0, 4, 7, 9, 2), noise(1, 64 * 90)
    near = [bytes([128 + (x - 128) * (40 - i) // 40 for x in song]) for i in range(1, 11)]
    long, other = noise(2, 64 * 300) + passage + noise(3, 64 * 200), noise(4, 64 * 100) + passage + noise(5, 64 * 350)
    rows = [(50, song), (1, song), *((10 + i, x) for i, x in enumerate(near)), (100, long), (2, other), (3, other), (150, noise(6, 64 * 500))]
    df = spark.createDataFrame(rows, "doc_id long, samples binary")
    got = {r.doc_id: r for r in chroma.align(chroma.fingerprints(df)).collect()}
    classes = {m.class_id: m for m in got[50].matches}
    assert {got[i].class_id for i, _ in rows[:12]} == set(classes) and len(got[50].matches) == len(classes) > 5
    assert got[50].class_id == got[1].class_id == 1 == got[50].match_id and classes[1].whole and classes[1].bit_error == 0
    found = next(m for m in got[100].matches if m.class_id == 2)
    assert (found.whole, got[100].n_matches, got[100].match_id) == (False, 0, None) and abs(found.offset + 200) <= 1
    assert found.start <= 300 and found.start + found.overlap >= 300 + 64 and found.overlap < 130 and found.bit_error <= chroma.BIT_ERROR
    assert 2 not in {m.class_id for m in got[150].matches} and got[3].matches is None and got[3].class_id == 2


@pytest.mark.parametrize("seed", range(4))
def test_best_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(1, 30, 40)
    bits = rng.choice([0, 1, 3, 9, 14], widths.sum())
    got, begin = list(zip(*chroma._runs(bits, widths), strict=True)), 0
    for w, (first, n, wrong, equal) in zip(widths, got, strict=True):
        part = bits[begin : begin + w]
        begin += w
        worth = lambda i, j: 480 * (j - i) - 100 * int(part[i:j].sum())  # noqa: B023, E731
        assert worth(first, first + n) == max(0, *(worth(i, j) for i in range(w) for j in range(i, w + 1)))
        assert (wrong, equal) == (part[first : first + n].sum(), (part[first : first + n] == 0).sum())


def drawn(seed):
    """Recordings (rep, members, items, short, least) that share items and stretches, and those of them that are asked."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    base = rng.choice(values, 90)
    found = []
    for i in range(70):
        n = int(rng.choice([22, 23, 24, rng.integers(25, 52), rng.integers(52, 90)]))
        at, short = int(rng.integers(0, 91 - n)), n < 52
        own = base[at : at + n].copy() if i % 3 else rng.choice(values, n)
        if i % 2 and n > 45:
            own[: n - 40] = rng.integers(0, 1 << 32, n - 40)
        noise = rng.integers(0, 1 << 32, (5, n), dtype=np.uint32)
        own = own ^ np.where(rng.random(n) < rng.choice([0, 0.3, 0.6]), np.bitwise_and.reduce(noise[: 2 + i % 4]), np.uint32(0))
        found.append((10 * i, 1 + i % 3, own.astype("<u4").tobytes(), short, max(1, min(chroma.VOTES, n - chroma.EDGE)) if short else chroma.VOTES))
    found = list({x[2]: x for x in found}.values())
    names = ["rep", "members", "items", "short", "least"]
    table = lambda rows: pa.table({c: list(x) for c, x in zip(names, zip(*rows, strict=True), strict=True)})
    return found, table(found), table(found[::2])


def aligned(own, other):
    """The match of two recordings as (start, offset, overlap, bit error, whole), offset by offset and run by run."""
    (a, b), enough = (np.frombuffer(x[2], "<u4") for x in (own, other)), min(own[4], other[4])
    calm = own[3] or other[3]
    shortest, limit = chroma.OVERLAP + chroma.EDGE * calm, chroma.BIT_ERROR / (1 + calm)
    votes = Counter(int(j - i) for i in range(len(a)) for j in np.flatnonzero(b == a[i]))
    found = []
    for offset in votes:
        start = max(0, -offset)
        w = min(len(a), len(b) - offset) - start
        if votes[offset] < enough or w < chroma.OVERLAP:
            continue
        bits = np.bitwise_count(a[start : start + w] ^ b[start + offset : start + offset + w]).astype(int)
        sums = np.append(0, np.cumsum(bits))
        if offset == min(votes, key=lambda o: (-votes[o], o)) and sums[-1] / (32 * w) <= limit:
            found.append((False, -w, sums[-1] / (32 * w), offset, start))
        gain, last, first = max((480 * (j - i) - 100 * int(sums[j] - sums[i]), -j, -i) for i in range(w) for j in range(i + 1, w + 1))
        first, last = -first, -last
        if gain > 0 and last - first >= shortest and (bits[first:last] == 0).sum() >= enough and sums[last] - sums[first] <= limit * 32 * (last - first):
            found.append((True, first - last, (sums[last] - sums[first]) / (32 * (last - first)), offset, start + first))
    passage, length, error, offset, start = min(found, default=(None,) * 5)
    return found and (start, offset, -length, error, not passage)


@pytest.mark.parametrize(("seed", "counted"), [(0, 1 << 21), (1, 60), (2, 25)])
def test_only_offsets_that_may_match_are_compared_and_all_matches_found(monkeypatch, seed, counted):
    found, recordings, queries = drawn(seed)
    monkeypatch.setattr(chroma, "COUNTED", counted)
    compared, runs = [], chroma._runs
    monkeypatch.setattr(chroma, "_runs", lambda bits, widths: compared.append(len(widths)) or runs(bits, widths))
    got = {r["query"]: r for r in chroma._align(recordings, queries).to_pylist()}
    wanted, offsets = {}, 0
    for own in found[::2]:
        offsets += sum(len({int(j - i) for i, x in enumerate(np.frombuffer(own[2], "<u4")) for j in np.flatnonzero(np.frombuffer(other[2], "<u4") == x)}) for other in found)
        matches = {other[0]: match for other in found if other is not own and (match := aligned(own, other))}
        if matches:
            wanted[own[0]] = matches
    assert sum(map(len, wanted.values())) > 40 and {m[4] for x in wanted.values() for m in x.values()} == {True, False}
    assert {q: {m["class_id"]: tuple(m[c] for c in ("start", "offset", "overlap", "bit_error", "whole")) for m in r["matches"]} for q, r in got.items()} == wanted
    members = {x[0]: x[1] for x in found}
    for q, matches in wanted.items():
        whole = {i: m for i, m in matches.items() if m[4]}
        assert got[q]["n"] == sum(members[i] for i in whole)
        best = min(((m[3], -m[2], i, m[1]) for i, m in whole.items()), default=None)
        assert (got[q]["bit_error"], got[q]["overlap"], got[q]["rep"], got[q]["offset"]) == ((best[0], -best[1], best[2], best[3]) if best else (None,) * 4)
    assert sum(compared) < offsets / 10


PRIVATE = [
    (1, "Call +1 (017) 555-7713 or 017-555-7713."),
    (2, "ann.lee@mail7.example.com and ANN.LEE@mail7.example.com, bob@mail7.example.com"),
    (3, "card 4444 3333 2222 1111, 4444-3333-2222-1111, 9807915762804490"),
    (4, "host 97.51.17.173 not 300.1.1.1"),
    (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    (6, "Mr. John Smith met Mrs Smith; Госпожа Анна Каренина"),
    (7, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000"),
    (8, "ssn 123-45-6789"),
    (9, None),
    (10, ""),
    (11, "clean text of the year 2024, chapter 3.1, and an @ sign"),
    (11, "clean text of the year 2024, chapter 3.1, and an @ sign"),
    (None, "write to bob@mail7.example.com"),
    (12, "дуня.5@почта.рф"),
]


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_short_recordings_are_computed_together(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(30, 120, n).astype(np.uint8).tobytes() for n in (1, 0, chroma.WHOLE - 1, chroma.WHOLE, chroma.FRAME, 2 * chroma.TOGETHER, *rng.integers(0, 3000, 60))] + [None, b"a" * 2000]
    wanted = [chroma.items(chroma.pitch_frames(chroma.padded(np.frombuffer(x or b"", np.uint8)))).astype("<u4").tobytes() for x in texts]
    calls, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda part, axis: calls.append(len(part)) or rfft(part, axis=axis))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "samples"])
    got = pa.Table.from_batches(chroma._fingerprints(iter([batch]))).to_pydict()
    assert got["items"] == wanted and got["n_samples"] == [len(x or b"") for x in texts] and got["n_items"] == [len(x) // 4 for x in wanted]
    assert len(calls) < len(texts) and sum(calls) == sum(got["n_frames"]) and max(calls) <= chroma.FRAMES


def test_surrogates_keep_type_format_and_reference(spark):
    got = surrogates.replace_private(frame(spark, PRIVATE), "key")
    assert got.columns == [*frame(spark, []).columns, "n_entities"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(PRIVATE)
    old = {i: t for i, t in PRIVATE}
    for i in (9, 10, 11):
        assert rows[i].text == old[i] and rows[i].n_entities == 0
    shape = lambda t: re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", t)))
    for i in (1, 3, 4, 5, 7, 8):
        assert rows[i].text != old[i]
        if i not in (5,):
            assert shape(rows[i].text) == shape(old[i])
    long, short = re.findall(r"[\d-]{8,}|\(\d+\) [\d-]+", rows[1].text)
    assert re.sub(r"\D", "", long) == re.sub(r"\D", "", short) and "+1 (" in rows[1].text
    mails = re.findall(r"\S+@[\w.]+\w", rows[2].text)
    assert mails[0] == mails[1] != mails[2] and len({m.split("@")[1] for m in mails}) == 1
    assert mails[2] in rows[None].text
    cards = re.findall(r"\d[\d -]{14,17}\d", rows[3].text)
    cards = [re.sub(r"\D", "", c) for c in cards]
    assert cards[0] == cards[1] and luhn(cards[0]) and luhn(cards[2]) == luhn("9807915762804490")
    ip = re.search(r"host (\S+) not 300.1.1.1", rows[4].text)[1]
    assert all(0 <= int(x) <= 255 for x in ip.split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', rows[5].text)
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+); Госпожа (\w+) (\w+)", rows[6].text)
    assert found[2] == found[3] != "Smith" and found[1] in surrogates.GIVEN["m", "latin"] and found[4] in surrogates.GIVEN["f", "cyrillic"]
    assert re.fullmatch(r"[а-яё]+\.\d@[а-яё]+\.рф", rows[12].text)
    one, two = re.findall(r"DE[\d ]+\d", rows[7].text)
    number = one.replace(" ", "")
    assert number == two and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def test_clashing_surrogates_are_drawn_again(spark):
    rows = [(i, f"Mr {chr(65 + i // 26)}{chr(97 + i % 26)}xo Tannar") for i in range(120)] + [(500 + i, f"{i}@a.io") for i in range(10)]
    got = surrogates.replace_private(frame(spark, rows), "key")
    texts = {r.doc_id: r.text for r in got.collect()}
    assert len(set(texts.values())) == len(rows)
    assert not set(texts.values()) & {t for _, t in rows}
    assert surrogates.replace_private(empty(spark), "key").collect() == []


def test_matches_without_digits_imply_a_hint(spark):
    some = {
        "email": "ann@mail.example", "iban": "DE89370400440532013000", "ip": "97.51.17.173", "ssn": "123-45-6789", "phone": "017-555-7713", "card": "4444333322221111",
        "person": "Frau Klein", "key": "sk-AbCdEfGhIjKlMnOpQrStUv", "hex": "abcdef" * 6,
        "ipv6": "2001:db8::1", "address": "12 Elm Grove Road",
    }
    more = ["AKIA" + "ABCDEFGHIJKLMNOP", *(f"gh{c}_" + "aBcDeF" * 6 for c in "pousr"), "ABCDEF" * 6, "the secret is sk-AbCdEfGhIjKlMnOpQrStUv and nobody knows"]
    more += [f"{t} Klein" for t in surrogates.MALE_TITLES + surrogates.FEMALE_TITLES + surrogates.OTHER_TITLES]
    more += ["we met Anna Karenina there", "Лидия Гинзбург", "fe80:0:0:0:1:2:3:4"]
    assert set(some) == set(surrogates.PATTERNS)
    rows = list(enumerate([*some.values(), *more]))
    got = {r.doc_id: r for r in surrogates.replace_private(frame(spark, rows), "key").collect()}
    for i, text in rows:
        assert got[i].n_entities == 1 and got[i].text != text, text


def test_phone_layouts(spark):
    phones = ["+14155550123", "415 555 0123", "1-800-555-0199", "1 800 555 0199", "+49 30 123456", "+33 1 42 68 53 00", "+44 (0)20 7946 0958", "+1 415.555.0123", "+1 (017) 555-7713", "(017) 555-7713", "017.555.7713", "+4915112345678", "1 (415) 555-0123"]
    rows = [*enumerate(f"call {p}, today" for p in phones), (100, "in 2024 +5 of 100 200 and 1 000 000 or 3.141592"), (101, "card 123 456 7890 1234")]
    got = {r.doc_id: r for r in surrogates.replace_private(frame(spark, rows), "key").collect()}
    shape = lambda t: re.sub(r"\d", "9", t)
    for i, text in rows[: len(phones)]:
        assert got[i].n_entities == 1 and got[i].text != text and shape(got[i].text) == shape(text), text
    for i, code in ((0, "+1"), (4, "+49 "), (5, "+33 "), (6, "+44 ("), (11, "+49")):
        assert got[i].text.startswith(f"call {code}")
    own = lambda i: re.sub(r"\D", "", got[i].text)[-10:]
    assert own(0) == own(1) == own(7) == own(12) and own(2) == own(3) and own(8) == own(9) == own(10)
    assert got[100].n_entities == 0 and got[101].n_entities == 1 and luhn(got[101].text) == luhn("1234567890 1234")


def test_names_addresses_and_long_texts(spark):
    rows = [
        (1, "Dr. John Smith wrote to Anna Karenina at 221 Baker Street, from 2001:db8::1 and 2001:DB8:0:0:0:0:0:1."),
        (2, "Anna Karenina and Mr Smith live at 221 Baker Street"),
        (3, "std::string a::b cd::ef, 12 Monkeys, 5 Big Things, The Drive, anna karenina, Annabel Lee"),
        (4, "word " * 400_000 + "Mrs Klein"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_private(frame(spark, rows), "key").collect()}
    one = re.fullmatch(r"Dr\. ([A-Z][a-z]+) ([A-Z][a-z]+) wrote to ([A-Z][a-z]+) ([A-Z][a-z]+) at (\d{3} [A-Z][a-z]+ Street), from ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]) and ([0-9a-f:]+)\.", got[1].text)
    two = re.fullmatch(r"([A-Z][a-z]+) ([A-Z][a-z]+) and Mr ([A-Z][a-z]+) live at (\d{3} [A-Z][a-z]+ Street)", got[2].text)
    assert one and two and got[1].n_entities == 5 and got[2].n_entities == 3
    assert two.groups() == (one[3], one[4], one[2], one[5])
    assert not {"John", "Smith", "Anna", "Karenina", "221 Baker Street"} & {*one.groups(), *two.groups()}
    assert got[3].n_entities == 0 and got[3].text == rows[2][1]
    assert got[4].n_entities == 1 and got[4].text.startswith(rows[3][1].removesuffix("Klein")) and got[4].text != rows[3][1]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, f"Mr {chr(65 + i)}axo Tannar", "m", "h", "a") for i in range(20)], "doc_id long, text string, matches string, HASH string, again string")
    got = surrogates.replace_private(docs, "key")
    assert got.columns == [*docs.columns, "n_entities"] and {(r.matches, r.HASH, r.again) for r in got.collect()} == {("m", "h", "a")}


def test_a_format_with_too_few_values_ends(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 3)
    rows = [(i, f"1.1.1.{i}, 1{i % 10}.1.1.1") for i in range(10)] + [(100 + i, f"{a}@b.io") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")]
    got = surrogates.replace_private(frame(spark, rows), "key").collect()
    assert len(got) == len(rows) and all(r.n_entities for r in got)


def test_surrogates_run_no_python(spark):
    plan = surrogates.replace_private(frame(spark, PRIVATE), "key")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
