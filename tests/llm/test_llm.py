"""Operators against brute force, on texts with nulls, empty and long texts, ties and repeats."""

import datetime
import hashlib
import hmac
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, byte_dedup, decontamination, exact_dedup, licences, near_dedup, private, quality, shared, substring_dedup, suffix_array, toxicity

SCHEMA = "doc_id long, text string, digest string, kept int"  # the last two clash with names of the operators


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(40, 160))) for _ in range(12)]
    texts = [None, "", "  \n", "one", "two words", "x" * 300, "The " * 90, *base]
    for b in base[:8]:
        w = b.split()
        texts.append(b)
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(r.choice(base) + "\n" + b[: len(b) // 2])
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, empty, weak):
    digest = (lambda t: F.length(t).cast("string").cast("binary")) if weak else exact_dedup.sha256
    got = rows(exact_dedup.exact_groups(docs, digest=digest, files_per_batch=1))
    groups = {}
    for i, t in corpus():
        groups.setdefault(t or "", []).append(i)
    for i, t in corpus():
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), max(g) == i)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_near(docs, empty):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in corpus()}
    component = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = {k: new if v == old else v for k, v in component.items()}
    got = rows(near_dedup.near_groups(docs, shingle_words=3, percent=85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), component[i]) for i in sets}
    assert near_dedup.near_groups(empty).count() == 0


def test_substrings(docs, empty):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in corpus()}
    count = {}
    for w in words.values():
        for s in range(len(w) - 34):
            count[tuple(w[s : s + 35])] = count.get(tuple(w[s : s + 35]), 0) + 1
    got = rows(substring_dedup.substring_dedup(docs, window=35))
    for i, w in words.items():
        gone = {p for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), kept)
        assert all(f["n_words"] >= 35 for f in got[i]["factors"])
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [250_000, 1])
def test_bytes(docs, empty, limit, monkeypatch):
    monkeypatch.setattr(byte_dedup, "TEXT", limit)
    seen = {}
    got = rows(byte_dedup.byte_dedup(docs))
    for i, t in corpus():
        b = (t or "").encode()
        gone = set()
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) < i:
                gone.update(range(s, s + 50))
        kept = bytes(x for p, x in enumerate(b) if p not in gone)
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(b), len(gone), kept)
        assert got[i]["n_spans"] == sum(p - 1 not in gone for p in gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert byte_dedup.byte_dedup(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in range(60):
        x = rng.integers(0, 3, n)
        assert suffix_array.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.encode(docs, path))
    for i, t in corpus():
        assert list(got[i]["ids"]) == known.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    codec, r = bpe.Codec(open(path, "rb").read()), random.Random(1)
    texts = ["".join(r.choice("ab'stmdrevl \n\t　é9²%中") for _ in range(r.randrange(40))) for _ in range(500)]
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    ids, ends = codec.encode(np.frombuffer("".join(texts).encode(), dtype=np.uint8), offsets)
    assert all(ids[a:b].tolist() == known.encode_ordinary(t) for t, a, b in zip(texts, ends, ends[1:]))
    assert bpe.encode(empty, path).count() == 0


def test_leaks(spark, docs, empty):
    r = random.Random(5)
    w = ["".join(r.choice("ghijk") for _ in range(5)) for _ in range(40)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, " ".join(w[::-1]))], "item_id long, text string")
    edited = list(w)
    edited[7], edited[20] = "other", "words"
    del edited[30]
    texts = [(1, "before it " + " ".join(w).upper() + ", after it"), (2, "a " * 30 + " ".join(edited)), (3, " ".join(w[:20])), (4, None), (5, "clean text of no item " * 20)]
    found = decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(1, 1), (2, 1)}
    assert {x["doc_id"]: x["distance"] for x in found} == {1: 0, 2: 3}
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def last_row(item, text, row):
    """Edit distances of item to the ends of text by the plain table; row has zeros if runs of text begin anywhere."""
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_leaks_by_brute_force(monkeypatch, tolerance=0.2):
    monkeypatch.setattr(decontamination, "MEETINGS", 300)
    r = random.Random(8)
    common = [f"w{k}" for k in range(150)]
    items = [(i, [r.choice(common) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 5, 9, 15, 40, 60, 100, 200, 200])]
    texts = []
    for i, w in items:
        for kind in ("sub", "del", "ins", "mixed") if len(w) > 3 else ("none",):
            for extra in (0, 1):
                w2 = list(w)
                for _ in range(int(len(w) * tolerance) + extra if kind != "none" else 0):
                    p, what = r.randrange(len(w2)), kind if kind != "mixed" else r.choice(("sub", "del", "ins"))
                    if what == "sub":
                        w2[p] = r.choice(common)
                    elif what == "del":
                        del w2[p]
                    else:
                        w2.insert(p, r.choice(common))
                texts.append([r.choice(common) for _ in range(r.randrange(20))] + w2 + [r.choice(common) for _ in range(r.randrange(20))])
    texts.append([])
    run = decontamination._leaks([(i, " ".join(w)) for i, w in items], tolerance)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), type=pa.int64()), pa.array([" ".join(t) for t in texts])], ["doc_id", "text"])
    got = {(x["doc_id"], x["item_id"]): x for out in run(iter([batch])) for x in out.to_pylist()}
    expect = {(d, i): k for d, t in enumerate(texts) for i, w in items if t and (k := min(last_row(w, t, [0] * (len(t) + 1)))) <= int(len(w) * tolerance)}
    assert {k: x["distance"] for k, x in got.items()}.items() <= expect.items() and len(got) >= decontamination.RECALL * len(expect)
    for (d, i), x in got.items():
        rest = texts[d][x["start_word"] :]
        assert min(last_row(items[i][1], rest, list(range(len(rest) + 1)))) == x["distance"]


def test_licences(spark, empty):
    texts = [(1, "Released under the MIT License. mit license"), (2, None), (3, "MIT, License; Apache\nLICENSE"), (4, "GNU General Public License"), (5, "mit licensed"), (6, "Licensed under CC BY-NC 4.0"), (7, ""), (8, "mit")]
    got = rows(licences.licence_scan(spark.createDataFrame(texts, "doc_id long, text string")))
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (7, 2, 3, 5, "mit")
    assert (got[3]["n_base"], got[3]["labels"]) == (2, "apache,mit") and got[4]["base_labels"] == "gpl"
    assert got[6]["labels"] == "cc-by-nc" and got[6]["n_base"] == 0 and got[5]["n_base"] == 0
    assert (got[2]["n_words"], got[7]["n_words"], got[8]["n_words"], got[2]["first_word"]) == (0, 0, 1, None)
    assert licences.licence_scan(empty).count() == 0


def test_licence_spans_are_verified(spark):
    notice = dict((v, k) for k, v in licences.NOTICES if len(k.split()) > licences.SHORT)["bsd"].split()
    pairs = [" ".join(notice[i : i + 2]) + " filler" for i in range(len(notice) - 1)]
    texts = [" ".join(pairs), " ".join(notice[:5] + ["added", "words"] + notice[5:]), " ".join(notice[:6]), "word " * 30_000 + " ".join(notice), " ".join(notice[::-1])]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate([*texts, texts[1]])], "doc_id long, text string, labels string, score double")
    got = rows(licences.licence_scan(docs))
    assert [got[i]["labels"] for i in range(6)] == ["", "bsd", "", "bsd", "", "bsd"] and got[3]["n_words"] == 30_000 + len(notice)


def test_private(spark, empty):
    texts = [(1, "card 4512463504900732 and 4512 4635 0490 0732, born 1999-02-28."), (2, "again 4512463504900732 not 1234567812345678"), (3, None), (4, "ann.05@mail8.example.com 10.0.0.255 +1 (949) 555-3739 2001-02-30")]
    got = rows(private.pseudonymised(spark.createDataFrame(texts, "doc_id long, text string"), key="k"))
    a = re.match(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), born (\d{4}-\d\d-\d\d)\.$", got[1]["text"])
    assert a and "4512463504900732" not in got[1]["text"] and a[1] == a[2].replace(" ", "")
    assert sum(sum(divmod(int(x) * 2, 10)) if k % 2 == 0 else int(x) for k, x in enumerate(a[1])) % 10 == 0
    assert got[2]["text"] == f"again {a[1]} not 1234567812345678" and got[2]["n_found"] == 1
    assert "2001-02-30" in got[4]["text"] and got[4]["kinds"] == "email,ip,phone" and "555-3739" not in got[4]["text"]
    assert got[3]["text"] == "" and private.pseudonymised(empty, key="k").count() == 0


def by_python(kind, value, key):
    """The pseudonyms of whole values of digits, by the standard library."""
    mac = lambda *parts: int(hmac.new(key.encode(), "|".join(map(str, parts)).encode(), "sha256").hexdigest()[:15], 16)

    def pair(a, b, m, n, tweak):
        for r in range(1, private.ROUNDS + 1):
            if r % 2:
                a = (a + mac(tweak, m, n, r, b) % m) % m
            else:
                b = (b + mac(tweak, m, n, r, a) % n) % n
        return a, b

    def digits(s, tweak):
        h = len(s) // 2
        a, b = pair(int("0" + s[:h]), int("0" + s[h:]), 10**h, 10 ** (len(s) - h), tweak)
        return (str(a).zfill(h) if h else "") + str(b).zfill(len(s) - h)

    def refill(shape, s):
        s = iter(s)
        return "".join(next(s) if c.isdigit() else c for c in shape)

    only = "".join(c for c in value if c.isdigit())
    if kind == "ssn":
        return refill(value, digits(only, kind))
    if kind == "card":
        body = only[0] + digits(only[1:-1], kind)
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        return refill(value, body + str(-total % 10))
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, kind)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    day = datetime.date.fromisoformat(value)
    begin = day.year // 400 * 400
    # Python has no year 0, so day numbers are taken one cycle later.
    number = datetime.date(day.year + 400, day.month, day.day).toordinal() - datetime.date(begin + 400, 1, 1).toordinal()
    a, b = pair(*divmod(number, 5411), 27, 5411, "date")
    moved = datetime.date.fromordinal(datetime.date(begin + 400, 1, 1).toordinal() + a * 5411 + b)
    return f"{moved.year - 400:04d}-{moved.month:02d}-{moved.day:02d}"


def test_private_by_brute_force(spark):
    r = random.Random(7)
    values = [("date", d) for d in ("1999-02-28", "2000-02-29", "1799-05-01", "2300-01-01", "0400-03-01")] + [("ip", "10.0.0.255"), ("ssn", "123-45-6789"), ("ip", "255.255.255.255")]
    for n in (13, 15, 16, 19):
        body = "".join(r.choice("123456789") for _ in range(n - 1))
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        values.append(("card", body + str(-total % 10)))
    values.append(("card", "4512 4635-0490 0732"))
    long = "plain words of no kind " * 20_000
    texts = [(i, f"it: {v}, then {v}") for i, (_, v) in enumerate(values)] + [(0, f"it: {values[0][1]}, then {values[0][1]}"), (0, "another text of row 0"), (50, long + "1999-02-28"), (51, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, values string, found int")
    out = private.pseudonymised(docs, key="k")
    expect = [(i, 2, k, f"it: {n}, then {n}") for i, (k, v) in enumerate(values) for n in [by_python(k, v, "k")]]
    expect += [expect[0], (0, 0, "", "another text of row 0"), (50, 1, "date", long + by_python("date", "1999-02-28", "k")), (51, 0, "", "")]
    assert sorted(map(tuple, out.collect())) == sorted(expect)
    secret = private.pseudonymised(docs, key="a key that no plan shows")
    assert "a key that" not in secret._jdf.queryExecution().toString()


def test_feistel_is_a_permutation(spark):
    df, key = private.with_key(spark.range(27 * 11), "k")
    df = df.select(private.feistel_pair(F.floor(F.col("id") / 11), F.col("id") % 11, F.lit(27).cast("long"), F.lit(11).cast("long"), key, "t").alias("p"))
    assert df.distinct().count() == 27 * 11
    df, key = private.with_key(spark.range(1000), "k")
    three = F.lpad(F.col("id").cast("string"), 3, "0")
    df = df.select(private.feistel_text(three, key, (private.DIGITS,), "t").alias("t"), private.feistel_digits(three, key, "t").alias("d"))
    assert df.select("t").distinct().count() == 1000 == df.select("d").distinct().count() and df.where("length(t) != 3 OR length(d) != 3").isEmpty()


def test_quality(spark, empty):
    r = random.Random(2)
    good = ["".join(r.choice("abc de.") for _ in range(200)) for _ in range(150)]
    texts = [(i, t if i % 3 else t.upper() + "!!! %%%", int(i % 3 > 0)) for i, t in enumerate(good)] + [(900, None, None), (901, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    got = rows(quality.quality_scores(docs, labels))
    held = [(got[i]["predicted"], y) for i, _, y in texts if got[i]["held_out"] and y is not None]
    assert np.mean([a == b for a, b in held]) > 0.95 and len(got) == len(texts)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert quality.quality_scores(empty, labels.limit(0)).count() == 0
    assert quality.isotonic(np.array([3.0, 1.0, 2.0, 5.0]), np.ones(4)).tolist() == [2.0, 2.0, 2.0, 5.0]


def test_toxicity(spark, empty):
    r = random.Random(2)
    make = lambda bad: " ".join(["vile"] * bad + ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(30)])
    texts = [(i, make(i % 10 == 0), int(i % 10 == 0)) for i in range(600)] + [(900, None, None), (901, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    got = rows(toxicity.toxicity_scores(docs, labels))
    held = [(got[i]["predicted"], y) for i, _, y in texts if got[i]["held_out"] and y is not None]
    assert np.mean([a == b for a, b in held]) > 0.97 and got[901]["predicted"] == 0
    assert toxicity.toxicity_scores(empty, labels.limit(0)).count() == 0
    assert isinstance(pa.array([1]), pa.Array)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, source)
        assert kept.columns == docs.columns, name
    assert [len(corpus_pipeline.STAGES)] == [5]


def edited_families(r, families=4, members=60, words=90):
    """Copies of a few texts with 0 to 12 words changed, so that links chain and fail around the threshold."""
    texts = []
    for _ in range(families):
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for p in r.sample(range(words), r.choice((0, 1, 2, 3, 4, 5, 6, 8, 12))):
                w[p] = f"v{r.randrange(10**6)}" if r.random() < 0.8 else "same"
            if r.random() < 0.3:
                del w[: r.randrange(14)]
            texts.append(" ".join(w))
    r.shuffle(texts)
    return [*texts, *texts[:20], None, "", "one"]


def brute_components(texts, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    component = list(range(len(texts)))
    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and component[a] != component[b] and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = [new if c == old else c for c in component]
    return component


@pytest.mark.parametrize("block, k, percent", [(1 << 18, 3, 85), (2000, 3, 85), (700, 5, 80)])
def test_near_groups_of_any_size(spark, monkeypatch, block, k, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = edited_families(random.Random(block))
    got = rows(near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle_words=k, percent=percent))
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(texts, k, percent)


def test_near_settles_like_brute_force():
    r = random.Random(4)
    for seed in range(30):
        texts = [t for t in edited_families(r, 2, 25, 40) if t]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), type=pa.int64()), pa.array(texts)], ["doc_id", "text"])
        packed = [x for out in near_dedup._set_rows(3)(iter([batch])) for x in out.column("shingles").to_pylist()]
        component = list(range(len(texts)))
        for a, b in near_dedup.settle(packed, component, 85):
            old, new = max(component[a], component[b]), min(component[a], component[b])
            component = [new if c == old else c for c in component]
        assert component == brute_components(texts, 3, 85), seed


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_near_radius_follows_the_threshold(percent):
    assert near_dedup.missed(near_dedup.radius_of(percent), percent) <= near_dedup.MISS < near_dedup.missed(near_dedup.radius_of(percent) - 1, percent)


def test_near_links_beyond_thirteen_symbols(spark):
    r, texts = random.Random(6), []
    for i in range(6000):
        w = [f"w{r.randrange(10**9)}" for _ in range(90)]
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:80], *(f"v{r.randrange(10**9)}" for _ in range(10))]))]  # 80 of 100 words in common
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], type=pa.int64()), pa.array([t for _, t in texts])], ["doc_id", "text"])
    signed = pa.Table.from_batches(near_dedup._signed(1)(iter([batch]))).combine_chunks().to_batches()[0]
    symbols = near_dedup._symbols(signed)
    far = (symbols[::2] != symbols[1::2]).sum(axis=1)
    pairs = np.flatnonzero((far > 13) & (far <= near_dedup.radius_of(80)))
    assert len(pairs)
    some = [x for p in pairs.tolist() for x in texts[2 * p : 2 * p + 2]]
    got = rows(near_dedup.near_groups(spark.createDataFrame(some, "doc_id long, text string"), shingle_words=1, percent=80))
    assert all(got[i]["component_id"] == i - i % 2 for i, _ in some)


def test_pipeline_rows(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import corpus_pipeline
    import public_tokenizers as p

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    good = [[word() for _ in range(60)] for _ in range(120)]
    items = [[word() for _ in range(n)] for n in (15, 40, 100)]
    texts = [" ".join(w) for w in good]
    texts += texts[:10]  # copies
    texts += [" ".join([*w[:-1], "changed"]) for w in good[10:20]]  # near copies
    texts += [" ".join("changed" if k in (10, 25, 40) else x for k, x in enumerate(w)) for w in good[20:30]]  # not near enough
    for w, item in zip(good[30:36], items * 2):
        edited = list(item)
        for k in r.sample(range(len(item)), len(item) // 5):
            edited[k] = "other"
        texts.append(" ".join(w[:20] + edited + w[:20][::-1]))  # leaks at the tolerance
        texts.append(" ".join(w[:20][::-1] + item[: len(item) // 2] + w[40:]))  # half an item
    clean = len(texts)
    texts += [" ".join(w).upper() + " !!! %%% $$$" * 10 for w in ([word() for _ in range(60)] for _ in range(60))]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < clean)) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    def near(ids):
        sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in ids for w in [texts[i].split()]}
        component = {i: i for i in ids}
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    old, new = max(component[a], component[b]), min(component[a], component[b])
                    component = {k: new if v == old else v for k, v in component.items()}
        return {i for i in ids if component[i] == i}

    def leaked(i):
        w = texts[i].split()
        return any(min(last_row(x, w, [0] * (len(w) + 1))) <= len(x) // 5 for x in items)

    brute = {
        "quality": lambda ids: {i for i in ids if i < clean},
        "exact copies": lambda ids: set({texts[i]: i for i in sorted(ids)}.values()),
        "near copies": near,
        "benchmark leaks": lambda ids: {i for i in ids if not leaked(i)},
    }
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), set(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, ids = ids, brute[name](ids)
        docs = shared.written(stage(spark, docs, d), f"test-{name.replace(' ', '-')}")
        assert ids < before and sorted((x["doc_id"], x["text"]) for x in docs.collect()) == [(i, texts[i]) for i in sorted(ids)], name
    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = [(i, len(t), sha(",".join(map(str, t))), sha(texts[i])) for i in sorted(ids) for t in [known.encode_ordinary(texts[i])]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == expect


def test_toxicity_drops_copies_only():
    low = np.argsort(toxicity.mix(np.arange(3000).astype(np.uint64)))
    least, rest = low[:3], np.sort(low[3:])
    text = lambda a, b: np.sort(np.concatenate((least, rest[a:b])))
    docs = [text(0, 40), text(0, 40), text(0, 42), text(100, 140), text(20, 60), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
    kept = toxicity.distinct(docs)
    assert [x.tolist() for x in kept] == [docs[i].tolist() for i in (0, 3, 4, 5)]


def test_toxicity_draws_from_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UNLABELLED", 60)
    drawn = []
    monkeypatch.setattr(toxicity, "train", lambda positive, unlabelled, prior: drawn.append((len(positive), len(unlabelled))) or toxicity.Classifier())
    texts = [(i, "the same text again" if i % 4 else f"text {i} of its own x{i}y") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels, "toxic", (5, 0))
    assert drawn == [(1, 60)]
    monkeypatch.setattr(toxicity, "UNLABELLED", 400)
    toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels, "toxic", (5, 0))
    assert drawn[1][0] == 1 and 60 < drawn[1][1] <= 101


def test_reference_block_parses_by_words():
    r, window = random.Random(11), 35
    left, count, content = [], [], []
    for _ in range(60):
        n_left, n_right = r.randrange(24), r.randrange(24)
        if n_left + n_right + 12 < window:
            continue
        words = [r.choice(["a", "b"]) if r.random() < 0.1 else "a" for _ in range(n_left)] + [r.choice(["x", "y"])] * 12 + [r.choice(["a", "b"]) if r.random() < 0.1 else "a" for _ in range(n_right)]
        left.append(n_left)
        count.append(len(words) - window + 1)
        content.append(" ".join(words).encode())
    left, count = np.array(left), np.array(count)
    whole = np.array([i % 7 == 0 for i in range(len(left))])
    x, start, n, y, source = substring_dedup.ReferenceBlock(left, count, content, window).factors(whole)
    words, places = [c.split() for c in content], {}
    for i, w in enumerate(words):
        for s in range(count[i]):
            places.setdefault((left[i] - s, tuple(w[s : s + window])), []).append((i, s))
    repeated = {p for ps in places.values() if len(ps) > 1 for p in ps if not whole[p[0]]}
    assert repeated and repeated == {(i, s + k) for i, s, m in zip(x.tolist(), start.tolist(), n.tolist()) for k in range(m - window + 1)}
    for i, s, m, j, t in zip(x, start, n, y, source):
        assert (i, s) != (j, t) and words[i][s : s + m] == words[j][t : t + m]


def test_suffix_arrays_settle_windows(monkeypatch):
    r, window = random.Random(12), 50
    gram = bytes(range(65, 65 + byte_dedup.GRAM))
    rows_ = []
    for i in range(80):
        n_left, n_right = r.randrange(27), r.randrange(27)
        if n_left + n_right + len(gram) >= window:
            text = bytes(r.choice(b"aab") if r.random() < 0.1 else 97 for _ in range(n_left)) + gram + bytes(r.choice(b"aab") if r.random() < 0.1 else 97 for _ in range(n_right))
            rows_.append((i % 3, n_left, len(text) - window + 1, 1000 - i, text))
    rows_.sort(key=lambda x: x[0])
    key, left, count, doc = (np.array(c) for c in list(zip(*rows_))[:4])
    least = {}
    for k, n, c, d, t in rows_:
        for s in range(c):
            at = k, n - s, t[s : s + window]
            least[at] = min(least.get(at, d), d)
    expect = [least[k, n - s, t[s : s + window]] for k, n, c, _, t in rows_ for s in range(c)]
    for limit in (250_000, 300, 1):
        monkeypatch.setattr(byte_dedup, "TEXT", limit)
        assert byte_dedup._Windows(key, left, count, doc, [t for *_, t in rows_], window).settle().tolist() == expect


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    """Rows that repeat a document give a row each, with the same answer; other columns, whatever their names, change nothing."""
    import public_tokenizers

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(2, 8)))
    long = " ".join(word() for _ in range(30_000))
    item = " ".join(word() for _ in range(40))
    texts = [(1, long), (2, "short text"), (3, "before " + item + " after"), (4, None), (5, ""), (6, " ".join(long.split()[500:700]))]
    clash = "doc_id long, text string, n string, found string, data string, x string, g string, shingles string, class_id string, label string, h string, kept string, file string, row string, digest string, score string, ids string, item_id string"
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    names = clash.count(",") - 1
    docs = spark.createDataFrame([(*x, *["z"] * names) for x in [*texts, *texts]], clash)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    operators = {
        "licences": licences.licence_scan,
        "bytes": lambda d: byte_dedup.byte_dedup(d).select("doc_id", "n_removed", "kept_sha256"),
        "leaks": lambda d: decontamination.leaks(d, items),
        "quality": lambda d: quality.quality_scores(d, labels).select("doc_id", "held_out"),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels).select("doc_id", "predicted"),
        "near": near_dedup.near_groups,
        "exact": lambda d: exact_dedup.exact_groups(d).select("doc_id", "keep_id", "kept"),
        "bpe": lambda d: bpe.encode(d, path),
        "private": lambda d: private.pseudonymised(d, key="k"),
    }
    for name, run in operators.items():
        once, twice = (sorted(map(str, run(d).collect())) for d in (plain, docs))
        assert twice == sorted(once * 2), name
    # A repeated row is a place elsewhere, so all its windows of words repeat.
    got = substring_dedup.substring_dedup(docs, window=35).collect()
    assert sorted((x["doc_id"], x["n_words"] - x["n_removed"]) for x in got) == sorted([(1, 0), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0)] * 2)


def test_byte_blocks_bound_a_workers_memory():
    """What a worker holds for a block of op2 at once: it shares its executor's memory with another and Spark's heap."""
    import tracemalloc

    from graphloom.llm import anchors

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, row)) for row in rng.integers(97, 123, (1000, 4000), dtype=np.uint8).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), type=pa.int64()), pa.array(texts), pa.array([None] * 1000, type=pa.list_(pa.binary()))], ["doc_id", "text", "found"])
    for run in (anchors._anchor_rows("bytes", 50, byte_dedup.GRAM, 8, True), byte_dedup._looked_up(50, False)):
        tracemalloc.start()
        assert sum(x.num_rows for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20


def test_contexts_of_a_task_are_settled_some_anchors_at_a_time(monkeypatch):
    """Against brute force; a task never has all of its windows at once."""
    from graphloom.llm import anchors

    rng = np.random.default_rng(5)
    common = [bytes(rng.integers(97, 123, 90, dtype=np.uint8)) for _ in range(12)]
    texts = [b"".join(bytes(rng.integers(97, 123, 20, dtype=np.uint8)) + common[i] for i in rng.permutation(12)[:5]) for _ in range(60)]
    windows = [anchors.pack(np.array([0]), np.array([len(t) - 49])) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), type=pa.int64()), pa.array([t.decode() for t in texts]), pa.array(windows, type=pa.binary())], ["doc_id", "text", "windows"])
    sent = list(byte_dedup._context_rows(50, 4)(iter([batch])))
    monkeypatch.setattr(byte_dedup, "CONTEXTS", 400, raising=False)
    monkeypatch.setattr(byte_dedup, "WINDOWS", 300, raising=False)
    settled = []

    class Windows(byte_dedup._Windows):
        def settle(self):
            settled.append(len(self.owner))
            return super().settle()

    monkeypatch.setattr(byte_dedup, "_Windows", Windows)
    found = [anchors.unpack(x) for b in byte_dedup._repeats(50, 7)(iter(sent)) for x in b.column("data").to_pylist()]
    got = {(d, s + i) for d, s, n in np.concatenate(found, axis=1).T.tolist() for i in range(n)}
    first: dict[bytes, int] = {}
    expect = {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49) if first.setdefault(t[s : s + 50], d) < d}
    assert got == expect and len(settled) > 5 and max(settled) < sum(settled) / 3
