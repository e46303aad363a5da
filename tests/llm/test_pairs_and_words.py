"""Work that must not grow faster than the input: pairs of the n-gram join, and words given to the tokenizer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers

from shelfwise.llm import ngram_join
from shelfwise.llm.tokens import ByteBpeEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_unrelated_sets_do_not_meet():
    rng = np.random.default_rng(5)
    keys = [ngram_join.root_keys(np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64)), (80, 100)) for _ in range(2000)]
    assert len(np.unique(np.concatenate(keys))) == sum(map(len, keys)) > 200_000


def test_a_set_is_entered_under_one_root_more_than_it_may_differ():
    rng = np.random.default_rng(6)
    for size in (60, 150, 700):
        grams = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        bound = 0
        for number in ngram_join._levels(size, (80, 100)):
            top = ngram_join._level(number, (80, 100))[1]
            bound += ngram_join.largest_difference(size, min(top, size * 100 // 80), (80, 100)) + 1
        assert len(ngram_join.root_keys(grams, (80, 100))) == bound


def _near_sets():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    # Below the threshold of 0.9, but close enough for the coarse points of most pairs.
    return [np.unique(np.concatenate([base[22:], rng.integers(0, 1 << 63, 22, dtype=np.uint64)])) for _ in range(2)] + [
        np.unique(np.concatenate([base[:-5], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
    ]


def test_pairs_come_once_whatever_the_number_of_common_roots():
    threshold = (90, 100)
    sets = _near_sets()
    keys = [ngram_join.root_keys(s, threshold) for s in sets]
    assert len(np.intersect1d(keys[0], keys[2])) > 10
    rows = [
        (int(k), i, i, len(s), ngram_join.count_vector(s, ngram_join.COARSE), ngram_join.lowest(of))
        for i, (s, of) in enumerate(zip(sets, keys))
        for k in of
    ]
    frame = pd.DataFrame(rows, columns=["key", "doc", "component", "n", "point", "lows"])
    frame = frame.sort_values(["key", "n", "point", "doc"], ignore_index=True)
    frame = frame[frame.duplicated("key", keep=False)].reset_index(drop=True)
    points = [ngram_join.count_vector(s, ngram_join.COARSE) for s in sets]
    allowed = {
        (i, j)
        for i in range(3)
        for j in range(i + 1, 3)
        if len(np.intersect1d(keys[i], keys[j]))
        and ngram_join.reaches(
            ngram_join.shared_at_most(points[i], len(sets[i]), points[j], len(sets[j])), len(sets[i]), len(sets[j]), threshold
        )
    }
    assert allowed
    for size in (64, 1):  # roots that are one leaf, and leaves of a single point
        trees = pd.concat(ngram_join._trees(threshold, size)(iter([frame])))
        pairs = list(zip(trees["a"].dropna(), trees["b"].dropna()))
        leaves = trees[trees["leaf"].notna()].drop(columns=["a", "b"])
        both = leaves.merge(leaves, on="key", suffixes=("", "_2"))
        both = both[both["leaf"] <= both["leaf_2"]]
        if len(both):
            import pyarrow as pa

            for batch in ngram_join._join_leaves(threshold)(iter([pa.RecordBatch.from_pandas(both, preserve_index=False)])):
                pairs += list(zip(batch["a"].to_pylist(), batch["b"].to_pylist()))
        pairs = [tuple(sorted(map(int, p))) for p in pairs]
        assert set(pairs) == allowed and len(pairs) <= 2 * len(allowed)


def test_sets_with_a_common_passage_make_no_pairs():
    threshold = (80, 100)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 320, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 80, dtype=np.uint64)])) for _ in range(60)]
    few = [ngram_join.count_vector(s, 64) for s in sets]
    assert sum(  # an index of 0.67 or so, but most points of 64 groups are near enough
        ngram_join.reaches(ngram_join.shared_at_most(x, 400, y, 400), 400, 400, threshold) for x in few for y in few
    ) > 0.7 * len(sets) ** 2
    low = ngram_join.lowest(np.array([1]))
    rows = [(1, i, i, len(s), ngram_join.count_vector(s, ngram_join.COARSE), low) for i, s in enumerate(sets)]
    rows = [(0, -1, -1, *rows[0][3:]), *rows, (2, -2, -2, *rows[0][3:])]
    frame = pd.DataFrame(rows, columns=["key", "doc", "component", "n", "point", "lows"])
    trees = pd.concat(ngram_join._trees(threshold, 64)(iter([frame])))
    assert trees["leaf"].notna().sum() == 2  # the first and the last root, which may go on in other partitions
    assert trees["a"].notna().sum() < 0.02 * len(sets) ** 2


def test_pairs_of_a_group_come_under_its_most_crowded_roots(spark, monkeypatch):
    written = {}
    keep = ngram_join.keep

    def kept(df, name, scratch=None):
        out = keep(df, name, scratch)
        written.setdefault(name, out)
        return out

    monkeypatch.setattr(ngram_join, "keep", kept)
    base = [f"w{i}" for i in range(352)]
    # Indices of 0.79: no links, but near enough for the points, and dozens of common roots.
    docs = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(48))])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, 1, (80, 100)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(20)]
    pairs = [tuple(r) for r in written["trees"].filter("a is not null").select("a", "b").collect()]
    leaves = written["trees"].filter("leaf is not null").drop("a", "b").toPandas()
    both = leaves.merge(leaves, on="key", suffixes=("", "_2")).query("leaf <= leaf_2")
    import pyarrow as pa

    for batch in ngram_join._join_leaves((80, 100))(iter([pa.RecordBatch.from_pandas(both, preserve_index=False)])):
        pairs += list(zip(batch["a"].to_pylist(), batch["b"].to_pylist()))
    pairs = [tuple(sorted(p)) for p in pairs]
    assert len(set(pairs)) > 50
    assert len(pairs) <= 1.1 * len(set(pairs))


def test_letters_serve_all_marks_after_them():
    encoder = ByteBpeEncoder(BPE)
    given: list[str] = []
    pack = encoder._pack_words
    encoder._pack_words = lambda words: given.extend(words) or pack(words)
    words = [f"{w}{m}" for w in ("winter", "été", "снег", "ab") for m in ("", ".", '."', ")", "...", "###", "?!", "'", "-")]
    texts = ["x " + " ".join(words), "x 's don't a1. 1a) .. é́. _a_ ", 'x "Winter"\n(été) <|endoftext|> b.']
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want
    assert not set(given).intersection(words)


def test_known_words_cost_no_pass_over_the_memory():
    encoder = ByteBpeEncoder(BPE, 3)
    encoder.encode(["a b c d e f"])

    class Before(dict):
        def __iter__(self):
            raise AssertionError("the older generation is looked up, not read through")

    encoder.encode(["a b"])
    encoder.before = Before(encoder.before)
    texts = ["a c g", "a f b"]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want
