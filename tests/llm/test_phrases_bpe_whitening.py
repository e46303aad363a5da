"""Byte-level BPE, whitening and collocations against the library, numpy and brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import bpe, collocations, queries, toxicity, whitening

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, phrase string"


@pytest.fixture(autouse=True)
def workers(spark):
    queries.on_workers(spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def _awkward(spark):
    long = " ".join(f"word{i % 997} a{i}." for i in range(20_000))
    rows = [
        (1, None, None, None, None, "x", "y"),
        (None, "some text, with a mail a.b@c.de inside", "en", "s", 9, None, None),
        (2, "", "en", "s", 0, "x", None),
        (3, long, "en", "t", len(long), None, "z"),
        (5, "one two three four five six", "en", None, 27, "k", "s"),
        (5, "one two three four five six", "en", None, 27, "k", "s"),
        (6, " \n\t ", "en", "s", 4, "k", "s"),
        (7, "ends <|endoftext|> inside", None, "s", 4, "k", "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


# -- 11: BPE --------------------------------------------------------------------


def _strings(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    odd = [0x10940, 0x558, 0x88F, 0x208F]  # of a kind that older character tables do not know
    scraps = [" ", "  ", "\n", "\t", "a", "bc", "'s", "'ll", "1", "22", "!", "é", "　", "\xa0", "\x85", "\x1c",
              "<|endoftext|>", "<|end", "日本", "hello", "world"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            points = [rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), rng.choice(odd)]) for _ in range(20)]
            out.append("".join(map(chr, points)))
        elif kind < 0.7:
            out.append("".join(rng.choice(scraps) for _ in range(rng.randrange(60))))
        elif kind < 0.8:
            out.append("".join(rng.choice("abcdeABC") for _ in range(rng.randrange(3000))))
        else:
            out.append(" ".join(rng.choice(["the", "of", "a1", "x  y", "", "don't", "we're", ",", "end."]) for _ in range(30)))
    return out


@pytest.mark.parametrize("section", [64, bpe.SECTION])
def test_bpe_equals_the_library(library, monkeypatch, section):
    monkeypatch.setattr(bpe, "SECTION", section)
    monkeypatch.setattr(bpe, "GROUP", 4 * section)
    texts = _strings(section, 1500)
    got = bpe.RankEncoder(BPE).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_bpe_remembers_little(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 5)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    encoder, texts = bpe.RankEncoder(BPE), _strings(3, 200)
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_long_word(library):
    word = "".join(random.Random(1).choice("abcdeé") for _ in range(20_000))
    assert np.frombuffer(bpe.RankEncoder(BPE).encode([word])[0], "<u4").tolist() == library.encode(word).ids


def test_bpe_decodes_any_ids(library):
    rng = random.Random(2)
    ids = [[rng.randrange(50_257) for _ in range(rng.randrange(20))] for _ in range(2000)]
    got = bpe.token_bytes(BPE).decode(pa.array([*ids, None, [99_999, -1, 50_256, None]], pa.list_(pa.int32())))
    assert got[:-2] == [library.decode(i, skip_special_tokens=False) for i in ids]
    assert got[-2:] == [None, "<|endoftext|>"]


def test_bpe_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), text)]
        assert [row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]] == [len(ids), *digests]


def test_bpe_awkward(spark, library):
    docs = _awkward(spark)
    rows = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    want = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in docs.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.decode(bpe.encode(docs.filter("false"), BPE), BPE).columns == ["doc_id", "ids", "text"]
    assert bpe.encode(docs.filter("false"), BPE).count() == 0


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.RankEncoder(public_tokenizers.path("word_bpe_49k.json"))


# -- 12: whitening --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_spectrum_equals_numpy(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    dim, n = int(rng.integers(1, 20)), int(rng.integers(1, 60))
    x = rng.integers(-100, 100, size=(n, dim)) * 10 ** int(rng.integers(0, 9))
    if seed % 3 == 0:
        x[:, : dim // 2] = x[:, :1]  # equal and zero eigenvalues
    monkeypatch.setattr(whitening, "BLOCK", int(rng.integers(1, 40)))
    a, b = whitening.Spectrum.empty(dim), whitening.Spectrum.empty(dim)
    a.add(x[: n // 2])
    b.add(x[n // 2 :])
    a.combine(b)
    centred = x - x.mean(axis=0)
    want = centred.T @ centred
    assert np.allclose((a.vectors * a.values) @ a.vectors.T, want, atol=1e-10 * max(1, np.abs(want).max()))
    assert np.allclose(a.vectors.T @ a.vectors, np.eye(dim), atol=1e-11)
    assert (a.n, [int(s) for s in a.sums]) == (n, [int(s) for s in x.sum(axis=0)])


def _whitening_by_hand(ids, vectors, scale=256, components=4):
    x = np.array([[math.floor(scale * float(c)) for c in v] for v in vectors], dtype=object)
    fit = [list(r) for r in sorted({tuple(r) for r in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = (np.array(fit, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, row in zip(ids, x):
        d = row * n - np.array(sums, dtype=object)
        white = (d.astype(float) / n) @ basis
        for c in range(min(components, x.shape[1])):
            out[i, c + 1] = (n, int((d * d).sum()), white[c] / math.sqrt(max(values[c], 1e-300)), values[c] / values.sum())
    return out


def _check(rows, want):
    signs = {}
    assert {(r["id"], r["component"]) for r in rows} == set(want)
    for r in rows:
        n, deviation, white, explained = want[r["id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert math.isclose(r["explained"], explained, rel_tol=1e-9) and r["identity_error"] < 1e-9
        sign = signs.setdefault(r["component"], 1 if r["whitened"] * white >= 0 else -1)
        assert math.isclose(r["whitened"], sign * white, rel_tol=1e-7, abs_tol=1e-8)


def test_whitening_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(700, 6)) * [1, 2, 3, 4, 5, 6]
    vectors[50:90] = vectors[3]  # copies count once in the fit
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    broken = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [-math.inf] * 6), (904, [])]
    df = spark.createDataFrame([*rows, *broken], "vec_id long, embedding array<double>").repartition(40)
    got = whitening.whiten(df).collect()
    _check(got, _whitening_by_hand([i for i, _ in rows], vectors))


def test_whitening_of_lengths_repeats_and_clashes(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(30, 2))
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(a)] + [(100 + i, [float(c) for c in v], 1, 2) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>, n int, dim int")
    got = whitening.whiten(df).collect()
    assert len(got) == 43 * 3 + 30 * 2
    for ids, vectors in ((range(40), a), (range(100, 130), b)):
        of = {(r["id"], r["component"]): r for r in got if r["id"] in ids}
        _check(of.values(), _whitening_by_hand(ids, vectors.astype(np.float32)))


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])], schema)).collect()
    assert {(r["id"], r["component"]) for r in one} == {(i, c) for i in (1, 2, None) for c in (1, 2)}
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 1} == {False}
    assert {r["whitened"] for r in line if r["component"] > 1} == {None}


def test_whitening_exact_deviation_of_large_numbers(spark):
    vectors = [[1e9 + i * 1e7, 3.0 * i] for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    want = _whitening_by_hand(range(20), vectors)
    assert {(r["id"], int(r["deviation"])) for r in got} == {(i, want[i, 1][1]) for i in range(20)}


def test_whitening_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = [r.asDict() | {"id": r["vec_id"]} for r in queries.op12_whitening(spark, SF).collect()]
    _check(got, _whitening_by_hand(list(rows), list(rows.values())))


# -- 13: collocations --------------------------------------------------------------------


def _frequent(rows, least):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    return {k: v for k, v in counts.items() if v >= least}, total


def _collocations_by_hand(rows, least, top):
    f, total = _frequent(rows, least)
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        longer = (g for (other, q), g in f.items() if other == lang and len(q) > len(p) and g >= a
                  and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if next(longer, None) is not None:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, x, y, total[lang], -score)
        for lang, phrases in found.items()
        for i, (score, a, p, x, y) in enumerate(sorted(phrases)[:top])
    }


def _texts(seed, n=400):
    rng = random.Random(seed)
    fixed = ["new york city", "of the", "a b a b a b a", "Über allem", "the new york city council.", "x\ty", "one, two"]
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((i, rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("sample", [1, 4, 1000])  # 1000: nearly nothing is proposed, all comes from expansion
def test_collocations_equal_brute_force(spark, monkeypatch, sample):
    rows = _texts(sample)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = {tuple(r) for r in collocations.collocations(df, least=12, top=60, sample=sample).collect()}
    assert got == _collocations_by_hand([r[1:] for r in rows], 12, 60)


@pytest.mark.parametrize("density", [0.0, 0.3, 0.8, 1.0])
def test_crowded_bit_tables_and_chunks_change_nothing(monkeypatch, density):
    """Lookups are false positives more often than not, proposals are arbitrary, and texts are cut into chunks."""
    rows = _texts(11, 250) + [(999, "en", " ".join(t for _, _, t in _texts(12, 60)))]
    want, total = _frequent([r[1:] for r in rows], 9)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 400)
    rng = np.random.default_rng(0)
    proposed, frequent = collocations.Proposals(1 << 15), collocations.Proposals(1 << 15)
    proposed.table[:] = np.packbits(rng.random(1 << 15) < density, bitorder="little")

    def passed(counter):
        counts = Counter()
        for _, lang, text in rows:
            for batch in collocations._long_text(counter, lang or "und", text.encode().translate(collocations.CLEAN)):
                for r in batch.to_pylist():
                    phrase, found_lang = r["counted"].split("\n", 1)
                    counts[found_lang, tuple(phrase.split(" ")) if phrase else ()] += r["f"]
        return counts

    first = passed(collocations._Counter(range(1, 6), proposed))
    found = pa.RecordBatch.from_pylist([{"lang": k[0], "phrase": " ".join(k[1])} for k, v in first.items() if v >= 9 and k[1]])
    (hashed,) = collocations._phrase_hashes(iter([found]))
    for h in hashed.column("h").to_numpy().view(np.uint64):
        for at in (int(h) & 0x7FFF, int(h) >> 32 & 0x7FFF):
            frequent.table[at >> 3] |= 1 << (at & 7)
    second = passed(collocations._Counter(range(2, 6), proposed, frequent))
    assert not {k for k in first if k[1]} & set(second)  # a phrase is counted in one of the passes
    counts = first + second
    assert {k: v for k, v in counts.items() if k[1] and v >= 9} == want
    assert {k[0]: v for k, v in counts.items() if not k[1]} == {k: v for k, v in total.items() if v}


def test_bit_table_holds_what_was_put_in(spark):
    numbers = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, size=3000)
    table = collocations._bit_table(spark.createDataFrame([(int(i),) for i in numbers], "h long"))
    assert table.has(numbers.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, size=20_000)
    assert table.has(others.view(np.uint64)).mean() < 0.01


def test_collocations_awkward(spark):
    docs = _awkward(spark)
    got = {tuple(r) for r in collocations.collocations(docs, least=2, top=50).collect()}
    assert got == _collocations_by_hand([(r["lang"], r["text"]) for r in docs.collect()], 2, 50)
    assert collocations.collocations(docs.filter("false")).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


# -- 6: without a model --------------------------------------------------------------------


def test_labels_of_one_class_reject_no_document(spark):
    docs = spark.createDataFrame([(i, f"a clean text about number {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 4)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 30
