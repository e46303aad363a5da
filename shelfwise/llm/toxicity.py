"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, share their backoff. Expressions are
words and, as the next shorter context of a rare word, word beginnings of
``PREFIX`` letters (an inflected or invented form backs off to its stem). As in
Kneser-Ney smoothing, an expression counts once per context and not once per
occurrence, a context being a distinct text: a text that was copied a thousand
times counts once. With n_c(x) the contexts of x in class c and N_c their sum,

    p_c(x) = max(n_c(x) - D, 0) / N_c + BACKOFF * p(x),

up to a constant, where the backoff p(x) is proportional to 1 + the contexts of
x in both classes together. For a rare expression the shared part outweighs
what one class happened to see, so it says little either way; a frequent one
speaks for itself.

A text is compared by its log-likelihood ratio per expression: of the whole
text (the mean over its expressions), of its three most telling expressions,
and of the single most telling one, so that a few words in a long text are not
averaged away. A logistic model turns these into a score.

Counts are kept by expression (a 64-bit digest) in a table that grows with the
corpus, so an expression counts alike whatever the number of others. To score,
each text's distinct expressions meet the table of log ratios in a join. The
ratios of the at most ``FREQUENT`` most frequent expressions, which make up most
of every text, are looked up on the way instead; that saves their share of the
join and changes no result. Texts are known by two digests, so copies are scored
once. The logistic model is fitted on a bounded sample of labelled documents of
fold 4, up to half of ``CALIBRATION`` of each class, and its bias corrected by
the classes' true shares; the counts cover every other labelled training text.
If fold 4 holds fewer than ``LEAST`` documents of a class, or no other fold holds
one, nothing is sampled: all are counted and a score is at least one half where
the mean log-likelihood ratios of words and of beginnings have a positive sum.

Training uses labelled rows of folds 1 to 4 only (crc32 of ``doc_id`` as text,
modulo 5). Labels, ids and other columns are never inputs of a score.

Defined results: a null or empty text scores as one without expressions;
repeated rows score alike; of several labels of a document the toxic one
counts, null labels and labels without a document are none; of a document's
different texts one is in the sample; if one class has no training text, every
score is the share of toxic training labels (0 without labels); a null ``doc_id`` is
never training data nor held out; an empty table gives no rows. Texts are read
whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, sliced, small_side

PREFIX = 4
DISCOUNT = 0.75
BACKOFF = 10.0
FREQUENT = 1 << 18  # expressions at most whose ratios every task has at hand; all others are joined
FOLDS = 5
CALIBRATION = 8192
LEAST = 10  # documents of each class that the logistic model needs
NO_EVIDENCE = 1e-6  # what a sum of mean log ratios must exceed without a logistic model
MEMO_WORDS = 200_000  # words that a task remembers; then it starts afresh
MEMO_TEXTS = 100_000  # texts, likewise
HELD = 1 << 20  # expressions of texts that a task adds up at a time
STRIPPED = bytes(b for b in range(33, 127) if not chr(b).isalnum())  # ASCII punctuation
FEATURES = 6


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _with_digests(docs: DataFrame) -> DataFrame:
    """``docs`` and the two digests ``h1, h2`` of the text; a null text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.crc32(text.cast("binary"))})


class _Codes(dict):
    """Word -> digests of the word (even) and of its beginning (odd) in 16 bytes; none for bare punctuation."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        bare = word.strip(STRIPPED)
        codes = b""
        if bare:
            start = bare.decode("utf-8", "replace")[:PREFIX].encode()
            codes = struct.pack("<QQ", xxhash.xxh3_64_intdigest(bare) & ~1, xxhash.xxh3_64_intdigest(start) | 1)
        self[word] = codes
        return codes


def expressions(text: str | None, known: _Codes) -> np.ndarray:
    """Codes of the text's words, and of their beginnings: two rows."""
    if len(known) > MEMO_WORDS:
        known.clear()
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.frombuffer(b"".join(map(known.__getitem__, words)), "<i8").reshape(-1, 2).T


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts per expression and class of a task's texts, added up ``HELD`` at a time."""

    def added() -> pa.RecordBatch:
        codes, at = np.unique(np.concatenate(held), return_inverse=True)
        lengths = [len(x) for x in held]
        of, weight = np.repeat(toxics, lengths), np.repeat(weights, lengths)
        sums = [np.bincount(at, weights=weight * (of == c), minlength=len(codes)) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, sums)], ["code", "ordinary", "toxic"])

    known = _Codes()
    held, toxics, weights, size = [], [], [], 0
    for batch in sliced(batches):
        texts = batch.column("text").to_pylist()
        for text, toxic, weight in zip(texts, batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()):
            codes = np.unique(expressions(text, known))
            held.append(codes)
            toxics.append(toxic)
            weights.append(weight)
            size += len(codes)
            if size > HELD:
                yield added()
                held, toxics, weights, size = [], [], [], 0
    if size:
        yield added()


PARTS = "h1 long, h2 long, code long, rare int, n long, total double, t1 double, t2 double, t3 double"


def _parts(frequent):
    """Each distinct text of a task as rows: by kind of expression one with what the frequent ones give, and
    one for each other expression, with its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Codes(), set()
        table, ratios = frequent.value
        for batch in sliced(batches):
            rows: list[tuple] = []  # whole texts
            rare: list[tuple] = []  # their other expressions
            keys = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist())
            for key, text in zip(keys, batch.column("text").to_pylist()):
                if key in seen:
                    continue
                if len(seen) >= MEMO_TEXTS:
                    seen.clear()
                seen.add(key)
                for kind, codes in enumerate(expressions(text, known)):
                    n = len(codes)
                    codes, times = np.unique(codes, return_counts=True)
                    at = np.searchsorted(table, codes)
                    at[at == len(table)] = 0
                    hit = table[at] == codes if len(table) else np.zeros(len(codes), bool)
                    x, of = ratios[at[hit]], times[hit]
                    best = np.sort(np.repeat(x, np.minimum(of, 3)))[::-1][:3].tolist()
                    # Whole texts are dealt by their digest; the flag keeps them apart from expressions.
                    rows.append((*key, key[0] & ~1 | kind, n, float((x * of).sum()), *best, *[None] * (3 - len(best))))
                    rare.append((*key, codes[~hit], times[~hit]))
            if not rows:
                continue
            h1, h2, code, n, total, *top = (list(c) for c in zip(*rows))
            lengths = [len(r[2]) for r in rare]
            others = sum(lengths)
            columns = [
                np.concatenate([np.array(h1, np.int64), np.repeat(np.array(h1, np.int64), lengths)]),
                np.concatenate([np.array(h2, np.int64), np.repeat(np.array(h2, np.int64), lengths)]),
                np.concatenate([np.array(code, np.int64), *(r[2] for r in rare)]),
                np.repeat(np.array([0, 1], np.int32), [len(rows), others]),
                np.concatenate([np.array(n, np.int64), *(r[3] for r in rare)]),
            ]
            arrays = [pa.array(c) for c in columns]
            arrays += [pa.array(c + [None] * others, pa.float64()) for c in (total, *top)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PARTS.split(", ")])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best, mean of the best three, and mean log-likelihood ratio; of words, then of beginnings."""
    for batch in sliced(batches):
        found = batch.column("found")
        ends = np.cumsum(pa.compute.list_value_length(found).to_numpy(zero_copy_only=False))
        items = pa.Table.from_struct_array(pa.chunked_array([found.flatten()]))
        code, rare, n, ratio, total, *top = (
            items.column(c).to_numpy() for c in ("code", "rare", "n", "ratio", "total", "t1", "t2", "t3")
        )
        ratio = np.nan_to_num(ratio.astype(np.float64))  # not in the table: it says nothing
        x = []
        for start, end in zip(np.r_[0, ends[:-1]], ends):
            out: list[float] = []
            for kind in (0, 1):
                at = start + np.flatnonzero(code[start:end] & 1 == kind)
                whole, others = at[rare[at] == 0][0], at[rare[at] == 1]
                if n[whole] == 0:
                    out += [0.0, 0.0, 0.0]
                    continue
                known = np.array([t[whole] for t in top], dtype=np.float64)
                best = np.sort(np.r_[known[~np.isnan(known)], np.repeat(ratio[others], np.minimum(n[others], 3))])[-3:]
                all_of_it = total[whole] + np.sort(ratio[others] * n[others]).sum()
                out += [float(best[-1]), float(best.mean()), float(all_of_it / n[whole])]
            x.append(out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), pa.array(x, pa.list_(pa.float64()))], ["h1", "h2", "x"]
        )


@dataclass(frozen=True)
class ToxicityModel:
    ratios: DataFrame | None = field(repr=False)  # code, ratio: log-likelihood ratios of expressions that are not frequent
    frequent: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)  # codes in order, ratios
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0
    share: float = 0.0  # of toxic training labels: the score if there is no model

    def features(self, texts: DataFrame) -> DataFrame:
        """``h1, h2, x`` for each distinct text of ``texts (h1, h2, text)``."""
        shared = texts.sparkSession.sparkContext.broadcast(self.frequent)
        parts = texts.select("h1", "h2", "text").mapInArrow(_parts(shared), PARTS)
        table = self.ratios.select("code", F.lit(1).alias("rare"), "ratio")
        found = F.struct("code", "rare", "n", "total", "t1", "t2", "t3", "ratio")
        # A set: copies of a text that met in no task give the same rows.
        gathered = parts.join(table, ["code", "rare"], "left").groupBy("h1", "h2").agg(F.collect_set(found).alias("found"))
        return gathered.mapInArrow(_features, "h1 long, h2 long, x array<double>")

    def scores(self, texts: DataFrame) -> DataFrame:
        """``h1, h2, score`` for each distinct text of ``texts (h1, h2, text)``."""
        z = F.lit(self.bias)
        for i in range(FEATURES):
            z = z + (F.col("x")[i] - float(self.centre[i])) / float(self.scale[i]) * float(self.weights[i])
        return self.features(texts).select("h1", "h2", (1 / (1 + F.exp(-z))).alias("score"))


def _log_ratios(counts: DataFrame) -> DataFrame | None:
    """``code, both, ratio`` of ``counts (code, ordinary, toxic)``; None if a class has no expression."""
    kind = F.col("code").bitwiseAND(1)
    both = F.col("ordinary") + F.col("toxic") + 1
    sums = [F.round(F.sum(c), 3) for c in (F.col("ordinary"), F.col("toxic"), both)]
    of = {r[0]: r[1:] for r in counts.groupBy(kind).agg(*sums).collect()}
    if not all(all(x) for x in of.values()) or not of:
        return None

    def total(i: int) -> Column:
        return F.when(kind == 0, F.lit(float(of[0][i]))).otherwise(F.lit(float(of[1][i])))

    shared = BACKOFF * both / total(2)
    p = [F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total(i) + shared for i, c in enumerate(("ordinary", "toxic"))]
    return counts.select("code", both.alias("both"), F.log(p[1] / p[0]).alias("ratio"))


def _split(ratios: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The ratios of rarer expressions, and codes and ratios of the at most ``FREQUENT`` most frequent ones."""
    power = F.floor(F.log2("both"))
    level, size = 64, 0  # powers of two, so that the histogram is short
    for power_of, n in sorted(map(tuple, ratios.groupBy(power).count().collect()), reverse=True):
        size += n
        if size > FREQUENT:
            break
        level = power_of
    top = ratios.filter(power >= level).select("code", "ratio").toArrow()  # at most FREQUENT rows
    codes, x = (top.column(c).to_numpy() for c in ("code", "ratio"))
    order = np.argsort(codes)
    return ratios.filter(power < level), (codes[order], x[order])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, with a ridge on the weights."""
    a = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, scratch: str | None = None) -> ToxicityModel:
    """Train on the labelled rows of ``docs (doc_id, text)``; ``labels (doc_id, toxic)``."""
    docs = _with_digests(docs.select("doc_id", "text"))
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).cast("int").alias("toxic"))
        .withColumn("fold", fold())
        .filter("fold <> 0")
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    known = keep(known, "toxicity-labels", scratch)
    size = {(r[0], r[1]): r[2] for r in known.groupBy("toxic", F.col("fold") == 4).count().collect()}
    of = [size.get((c, True), 0) + size.get((c, False), 0) for c in (0, 1)]
    share = of[1] / sum(of) if sum(of) else 0.0
    if not all(of):
        return ToxicityModel(None, share=share)
    calibrated = all(size.get((c, True), 0) >= LEAST and (c, False) in size for c in (0, 1))
    each = CALIBRATION // 2 if calibrated else 0
    sample = [
        known.filter((F.col("fold") == 4) & (F.col("toxic") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        for c in (0, 1)
    ]
    sample = sample[0].union(sample[1]).select("doc_id", "toxic")
    sample = F.broadcast(keep(sample, "toxicity-sample", scratch))  # at most CALIBRATION rows
    counted = known.select("doc_id", "toxic").join(sample, "doc_id", "left_anti")
    # Copies share one context: each of m copies weighs 1 / m. Only digests travel here.
    labelled = docs.select("doc_id", "h1", "h2").join(counted, "doc_id")
    copies = labelled.groupBy("h1", "h2", "toxic").agg(F.count(F.lit(1)).alias("m"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h1", "h2", "toxic")]
    weights = (
        labelled.alias("a")
        .join(copies.alias("b"), same)
        .groupBy("a.doc_id", "a.toxic")
        .agg(F.avg(1 / F.col("m")).alias("weight"))
    )
    training = docs.select("doc_id", "text").filter(fold() != 0).join(weights.hint("shuffle_hash"), "doc_id")
    training = training.select("text", "toxic", "weight")
    counts = (
        training.mapInArrow(_counts, "code long, ordinary double, toxic double")
        .groupBy("code")  # sums of 1 / m in any order
        .agg(F.round(F.sum("ordinary"), 6).alias("ordinary"), F.round(F.sum("toxic"), 6).alias("toxic"))
    )
    ratios = _log_ratios(keep(counts, "toxicity-counts", scratch))
    if ratios is None:
        return ToxicityModel(None, share=share)
    model = ToxicityModel(*_split(ratios), share=share)

    if not calibrated:
        weights = np.zeros(FEATURES)
        weights[[2, 5]] = 1.0  # the means
        return replace(model, weights=weights, bias=-NO_EVIDENCE)

    # One text of each document.
    text = F.min(F.struct("h1", "h2"))
    chosen = docs.select("doc_id", "h1", "h2").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(text.alias("text"))
    chosen = F.broadcast(keep(chosen.select("doc_id", "toxic", "text.h1", "text.h2"), "toxicity-chosen", scratch))
    texts = docs.join(chosen.select("doc_id", "h1", "h2"), ["doc_id", "h1", "h2"])
    rows = model.features(texts).join(chosen, ["h1", "h2"]).select("doc_id", "x", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    x = np.array([r["x"] for r in rows])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w, bias = _logistic((x - centre) / scale, y)
    bias += np.log(of[1] / of[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return replace(model, centre=centre, scale=scale, weights=w, bias=float(bias))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, scratch: str | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``."""
    docs = _with_digests(docs.select("doc_id", "text"))
    model = fit(docs, labels, scratch)
    if model.ratios is None:
        scored = docs.withColumn("score", F.lit(float(model.share)))
    else:
        scored = docs.select("doc_id", "h1", "h2").join(model.scores(docs), ["h1", "h2"], "left")
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, scratch: str | None = None) -> DataFrame:
    """``docs`` without the documents that score at least ``threshold``, with all columns.

    Without a model (labels of one class only, or of none of the documents) no document is told from another: all stay.
    """
    plain = _with_digests(docs.select("doc_id", "text"))
    model = fit(plain, labels, scratch)
    if model.ratios is None:
        return docs
    rejected = model.scores(plain).filter(F.col("score") >= threshold)
    rejected = small_side(keep(rejected.select("h1", "h2"), "toxic", scratch))
    # Named so that input columns may have any names.
    named = rejected.toDF("__h1", "__h2")
    text = F.coalesce(docs["text"], F.lit(""))
    same = (F.xxhash64(text) == named["__h1"]) & (F.crc32(text.cast("binary")) == named["__h2"])
    return docs.join(named, same, "left_anti")
