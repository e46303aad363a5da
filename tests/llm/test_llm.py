"""Training-data operators against brute force, round trips and held-out labels, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from shelfwise.llm import (
    embedding_dedup,
    mixing,
    ngram_join,
    packing,
    pii,
    queries,
    records,
    token_counts,
    topk,
    toxicity,
    url_reputation,
)

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, start string"


@pytest.fixture(autouse=True)
def workers(spark):
    queries.on_workers(spark)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 997} a{i}" for i in range(20_000))
    rows = [
        (1, None, None, None, None, "x", "y"),
        (None, "some text with mail a.b@c.de inside", "en", "s", 9, None, None),
        (2, "", "en", "s", 0, "x", None),
        (3, long, "en", "t", len(long), None, "z"),
        (4, long, "en", "t", len(long), None, "z"),
        (5, "one two three four five six", "en", None, 27, "k", "s"),
        (5, "one two three four five six", "en", None, 27, "k", "s"),
        (6, " \n\t ", "en", "s", 4, "k", "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


def encode(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# -- 1: top-k --------------------------------------------------------------------


def test_top_k_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(260, 6)).round(1)
    vectors[100:160] = vectors[100]  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [math.nan] * 6), (1050, [math.inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, queries.F.col("id") % 50 == 0, k=5, block=64, bins=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = np.floor(vectors * 256).astype(np.int64)
    for q in range(0, 260, 50):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in range(260) if c != q)[:5]
        assert sorted(got[q]) == [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert set(got) == set(range(0, 260, 50))


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert topk.top_k(spark.createDataFrame([], schema), queries.F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1)], schema)
    assert [tuple(r) for r in topk.top_k(few, queries.F.col("id") % 50 == 0).collect()] == [(0, 1, 7, 65536)]


# -- 2: n-gram join --------------------------------------------------------------------


def brute_components(texts: dict, words: int, threshold: tuple[int, int]) -> dict:
    sets = {}
    for doc, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and threshold[1] * both >= threshold[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("words", "threshold"), [(3, (90, 100)), (5, (80, 100)), (1, (80, 100))])
def test_ngram_join_brute_force(spark, words, threshold):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 30, 120, 400]))]
        for _ in range(10):  # near copies from close to far, and exact ones
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[n * 7 % 1009] = " ".join(copy)
            n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, words, threshold).collect()}
    assert got == brute_components(texts, words, threshold)


def test_ngram_join_large_group_of_near_copies(spark):
    """More near copies than a leaf holds, some of them linked through others only."""
    rng = random.Random(1)
    base = [f"t{i}" for i in range(80)]
    texts = {}
    for i in range(200):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(80)] = f"x{rng.randrange(30)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, 1, (90, 100)).collect()}
    assert got == brute_components(texts, 1, (90, 100))


def test_every_link_meets_at_a_root():
    rng = np.random.default_rng(3)
    for threshold in ((80, 100), (90, 100)):
        for size in (4, 5, 9, 10, 11, 17, 40, 150, 700):
            for _ in range(40):
                a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                most = ngram_join.largest_difference(size, size * threshold[1] // threshold[0], threshold)
                gone = rng.integers(0, most + 1)
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, most - gone, dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                shared = len(np.intersect1d(a, b))
                if len(b) and ngram_join.reaches(shared, len(a), len(b), threshold) and shared < max(len(a), len(b)):
                    keys = [ngram_join.root_keys(x, threshold) for x in (a, b)]
                    assert len(np.intersect1d(*keys)), (threshold, size, most, gone)


def test_ngram_join_awkward(awkward):
    got = [tuple(r) for r in ngram_join.near_duplicates(awkward, 5, (80, 100)).collect()]
    assert len(got) == 8
    found = {d: (n, c) for d, n, c in got}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[6] == (0, 6)
    assert found[4][1] == 3 and found[5] == (2, 5) and found[None][1] is None
    kept = ngram_join.drop_near_duplicates(awkward, 5, (80, 100))
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "None"]
    assert ngram_join.near_duplicates(awkward.limit(0)).count() == 0


# -- 3, 5, 7: tokens ---------------------------------------------------------------------


def check_packing(rows, texts):
    places: dict = {}
    pieces: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for found in places.values():  # gapless, within the capacity
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, found in pieces.items():
        if doc in texts:
            ids = [*encode(texts[doc]), 0]
            cut = packing.cut(len(ids), 2048)
            assert sorted(found) == [(k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(cut)]
    return len(places)


def test_packing(documents, texts):
    rows = packing.pack(documents, BPE).collect()
    sequences = check_packing(rows, dict(list(texts.items())[:60]))
    total = sum(r["length"] for r in rows)
    assert sequences <= math.ceil(total / 2048) * 1.03 + 1
    assert {r["doc_id"] for r in rows} == set(texts)


def test_packing_plan_places_every_piece():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(0, 40))}
        patterns = packing.plan_patterns(histogram, 64)
        placed: dict = {}
        for p in patterns:
            assert p.count > 0 and sum(n * k for n, k in p.items) <= 64
            for n, k in p.items:
                placed[n] = placed.get(n, 0) + k * p.count
        assert placed == histogram
    assert packing.plan_patterns({40: 3, 14: 3, 10: 3}, 64) == [packing.Pattern(((40, 1), (14, 1), (10, 1)), 3)]


def test_packed_sequences_hold_the_ids(documents, texts):
    some = documents.filter("doc_id < 20")
    placed = packing.pack(some, BPE)
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(some, placed, BPE).collect()}
    for r in placed.collect():
        assert crc(found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"]


def test_token_operators_awkward(awkward, spark, tmp_path):
    rows = packing.pack(awkward, BPE).collect()
    check_packing(rows, {})
    assert sorted((r["doc_id"], r["length"]) for r in rows if r["doc_id"] in (1, 2)) == [(1, 1), (2, 1)]
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    assert packing.pack(awkward.limit(0), BPE).count() == 0
    manifest = records.write_records(awkward, BPE, folder=str(tmp_path / "r"))
    found = sorted(map(tuple, records.read_digests(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 1, 2, 3, 4, 5, 5, 6]
    assert found[1][2:] == (1, crc([2])) and sum(r[2] for r in found[:-1]) == found[-1][1]
    shard = manifest.orderBy("first_id").first()
    doc, ids = records.read_record(shard["path"], shard["index_path"], 0)
    assert doc is None and ids[-1] == 2
    empty = records.write_records(awkward.limit(0), BPE)
    assert records.read_digests(empty).count() == 0
    counts = sorted(map(tuple, token_counts.count_tokens(awkward, PIECES, limit=10).collect()), key=str)
    assert len(counts) == 8 and (1, 0, 0, False) in counts and (2, 0, 0, False) in counts
    assert token_counts.count_tokens(awkward.limit(0), PIECES).count() == 0


def test_records_round_trip(documents, texts):
    found = [tuple(r) for r in records.read_digests(records.write_records(documents, BPE)).collect()]
    start = 0
    for doc, at, n, check in sorted(found):
        ids = [*encode(texts[doc]), 2]
        assert (at, n, check) == (start, len(ids), crc(ids))
        start += n
    assert len(found) == len(texts)


def test_records_detect_damage(tmp_path):
    import io

    data = records.frame(b"hello")
    assert records.read_frame(io.BytesIO(data)) == b"hello" and records.read_frame(io.BytesIO(b"")) is None
    for i in range(len(data)):
        with pytest.raises(records.CorruptRecord):
            records.read_frame(io.BytesIO(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]))


def test_token_counts_and_cache(documents, texts, spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.count_tokens(documents.filter("doc_id < 90"), PIECES, cache).collect()))
    stored = spark.read.parquet(cache).count()
    again = sorted(map(tuple, token_counts.count_tokens(documents, PIECES, cache).collect()))
    assert again[: len(first)] == first and spark.read.parquet(cache).count() > stored
    assert spark.read.parquet(cache).count() == len(set(texts.values()))
    for doc, n_bytes, n, over in again:
        want = len(model.encode(texts[doc]))
        assert (n_bytes, n, over) == (len(texts[doc].encode()), want, want > 4096)


def test_word_wise_encoding_equals_whole_texts():
    from shelfwise.llm.tokens import ByteBpeEncoder, PieceCounter

    odd = ["", " ", "a  b", " lead", "trail ", "\n", "a\n b", "a \nb", "x \n \n y", "<|endoftext|> hi<|endoftext|>",
           "don't it's ,, a, b.c é, ñ! 12, 3. \x1c x", "日本 語, テ。 a　b", "tab\tx y\r\nz", "a\xa0b ٣, ²! <s> </s>"]
    encoder, counter = ByteBpeEncoder(BPE, 3), PieceCounter(PIECES, 3)
    for _ in range(2):
        assert encoder.encode(odd) == encoder._pack(odd)
        assert counter.count(odd) == counter._counts(odd)


# -- 4: mixing -----------------------------------------------------------------------------


def test_mixing_rates_and_determinism(spark):
    rows = [(i, "a" if i < 3000 else "b" if i < 3300 else None) for i in range(3400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 1.0)], "source string, weight double")
    one = sorted(map(str, mixing.mix(docs, weights, size=8000.0, copy_column="copy").collect()))
    assert one == sorted(map(str, mixing.mix(docs.repartition(7), weights, size=8000.0, copy_column="copy").collect()))
    counts = {r["source"]: r["count"] for r in mixing.mix(docs, weights, size=8000.0).groupBy("source").count().collect()}
    for source, want in (("a", 2000), ("b", 4000), (None, 2000)):
        assert abs(counts[source] - want) < 5 * math.sqrt(want)


def test_mixing_awkward(awkward):
    mixed = mixing.mix(awkward, copy_column="kind")
    assert sorted(mixed.columns) == sorted(awkward.columns)
    assert mixing.mix(awkward.limit(0)).count() == 0
    none = awkward.sparkSession.createDataFrame([("s", 0.0)], "source string, weight double")
    assert mixing.mix(awkward, none).count() == 0


# -- 6: toxicity ---------------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert right > 0.98 and sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.01


def test_toxicity_awkward(awkward, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(awkward, none).collect()] == [0.0] * 8
    odd = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(awkward, odd)
    assert kept.columns == awkward.columns
    assert toxicity.toxicity(awkward.limit(0), odd).count() == 0


def colliding():
    """Two words of four letters, so also two beginnings, whose hashes agree in their last 20 bits."""
    import itertools
    import string

    import xxhash

    seen = {}
    for letters in itertools.product(string.ascii_lowercase, repeat=4):
        word = "".join(letters)
        other = seen.setdefault(xxhash.xxh3_64_intdigest(word.encode()) % (1 << 20), word)
        if other != word:
            return other, word


def marked(spark, toxic_word, clean_word, n=300):
    """Every third document is toxic; a single word tells the two kinds apart."""
    rng = random.Random(3)
    docs = [
        (i, " ".join([*(f"w{rng.randrange(60)}" for _ in range(12)), clean_word if i % 3 else toxic_word])) for i in range(n)
    ]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(n)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_counts_by_the_whole_word(spark):
    docs, labels = marked(spark, *colliding())
    rows = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert rows and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in rows)


def test_toxicity_counts_all_that_is_not_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION", 40)
    docs, labels = marked(spark, "vile", "good", n=600)
    # One of the toxic words is found in fold 4 and among held-out documents only.
    other = toxicity.fold().isin(0, 4)
    text = queries.F.expr("replace(text, 'vile', 'evil')")
    docs = docs.withColumn("text", queries.F.when(other, text).otherwise(docs["text"]))
    rows = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert rows and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in rows)


@pytest.mark.parametrize("least, wrong", [(10, 0.01), (1000, 0.1)])
def test_toxicity_finds_a_rare_class(spark, monkeypatch, least, wrong):
    """A uniform sample of 40 labels mostly holds no toxic one; without a logistic model the ratio's sign decides."""
    monkeypatch.setattr(toxicity, "CALIBRATION", 40)
    monkeypatch.setattr(toxicity, "LEAST", least, raising=False)
    docs, labels = marked(spark, "vile", "good", n=3000)
    clean = "doc_id % 60 <> 0 and doc_id % 3 = 0"  # one in forty is left toxic
    docs, labels = docs.filter(f"not ({clean})"), labels.filter(f"not ({clean})")
    # Labels without a document take no place in the sample.
    labels = labels.union(spark.range(100_000, 150_000).selectExpr("id", "1", "0"))
    rows = toxicity.toxicity(docs, labels).filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["doc_id"] % 3 == 0]
    good = [r["predicted"] for r in rows if r["doc_id"] % 3]
    assert toxic and min(toxic) == 1 and sum(good) <= wrong * len(good)


def test_toxicity_joined_ratios_are_those_at_hand(spark, monkeypatch):
    docs, labels = marked(spark, "vile", "kind")
    docs = docs.union(docs.limit(20)).union(docs.limit(1).selectExpr("doc_id + 1000", "''"))
    want = sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, labels).collect())
    for frequent in (0, 20):
        monkeypatch.setattr(toxicity, "FREQUENT", frequent)
        got = sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, labels).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=0, atol=1e-9)


# -- 8: urls ----------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/x?q", "https://www.example.com/en/", "http://x.net/es/1#a",
            "http://x.net/de/1", "http://com", "http://y.org/", "http://example.com?x://b", ""]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_reputation.judge(pages, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[9] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[6][:3] == ("com", "", None)
    assert got[7][2:] == (None, "allow") and got[8][:2] == ("example.com", "")
    assert url_reputation.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("a.x.net", 95, 100), ("b.x.net", 1, 1), ("c.y.net", 0, 200), ("d.y.net", 1, 1)]
    tables = url_reputation.reputation(spark.createDataFrame(rows, "host string, bad long, n long"))
    mean = {r["host"]: r["mean"] for r in tables["host"].collect()}
    assert mean["a.x.net"] > 0.9 and mean["c.y.net"] < 0.05
    assert mean["d.y.net"] < mean["b.x.net"] < 1  # one bad page says less under a clean domain


# -- 9: embeddings ----------------------------------------------------------------------------


def test_embedding_dedup_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 12))
    x[200:400] = x[200] + rng.normal(size=(200, 12)) * 0.25
    x[500:520] = x[500]
    x[600] = 3 * x[601]
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(800, None), (801, [0.0] * 12), (802, [math.nan] * 12), (803, [None] * 12), (None, [1.0] * 12), (804, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    d = x.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    component = np.arange(len(d))
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], len(d)).min(axis=1))
        if np.array_equal(least, component):
            break
        component = least
    for block in (4096, 64):
        got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, 0.95, block=block).collect()}
        for i in range(len(d)):
            assert got[i] == (linked[i].sum(), component[i], component[i] == i)
        assert all(got[i] == (0, i, True) for i in (800, 801, 802, 803, 804)) and got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# -- 10: personal data --------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1])))
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_brute_force(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "m_n@o.p-q.r", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.1.1.1", ".",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "12", "+1 (017) 555-7713", "+49.89 123 456-78",
             "+1+2", "+", "é", "日本", "😀", " ", "\n", "--", "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f9\"", "w"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts += [None, "", "9" * 30_000, "a" * 30_000 + "@", "1." * 9000, "+" + "1 " * 9000, "a@b.c " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        counts = [sum(s.startswith(f"{k}:") for s in want) for k in PATTERNS]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert [s for s in r["spans"].split(",") if s and not s.startswith("secret")] == want


def test_pii_method_finds_secrets_and_leaves_numbers(documents, texts):
    rows = {r["doc_id"]: r["spans"] for r in pii.find(documents.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    full = {r["doc_id"]: r["text"] for r in documents.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for doc, text in full.items():
        found = [tuple(map(int, s.split(":")[1:])) for s in rows[doc].split(",") if s.startswith("secret")]
        want = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{20,})"', text)]
        assert set(want) <= set(found)
        assert all(re.search("[0-9]", text[s:e]) for s, e in found)


def test_redaction(awkward):
    new = {str(r["doc_id"]): r for r in pii.redact(awkward).collect()}
    assert new["None"]["text"] == "some text with mail <EMAIL> inside" and new["None"]["n_chars"] == 34
    old = {str(r["doc_id"]): r for r in awkward.collect()}
    assert all(new[k] == old[k] for k in old if k != "None")
    assert pii.redact(awkward.limit(0)).count() == 0 and pii.find(awkward.limit(0)).count() == 0


def test_em_finds_reliable_labelers():
    rng = random.Random(8)
    patterns: dict = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple((1 if truth else -1) if rng.random() < q else (-1 if truth else 1) for q in (0.95, 0.9, 0.9, 0.55))
        patterns[votes] = patterns.get(votes, 0) + 1
    posterior, tables = pii.fit_em(sorted(patterns.items()))
    accuracy = [t[1][1] for t in tables]
    assert accuracy[0] > 0.85 and accuracy[3] < 0.7
    assert dict(zip(sorted(patterns), posterior))[(1, 1, 1, -1)] > 0.9
    assert pii.fit_em([]) == ([], [])


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        if name == "packing":
            check_packing(after.collect(), {})
            assert after.agg(queries.F.sum("length")).first()[0] > 0
        else:
            assert after.columns == documents.columns
        if name == "near_duplicates":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            want = {c for _, c in brute_components(before, 5, (80, 100)).values()}
            assert {r["doc_id"] for r in after.collect()} == want
        if name == "personal_data":
            assert not [s for r in after.collect() for s in base_spans(r["text"])]
        docs = after


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert [len([n for n in names if n.startswith(f"op{i}_")]) for i in range(1, 11)] == [1] * 10
