"""Operator 13: phrase collocations by Toivonen's mining of frequent phrases.

Phrases are runs of two to five words inside a piece of text between marks. A
phrase is frequent only if its parts are, so frequent phrases are found so:

1. A fixed share of the documents is the sample. In it, phrases that reach a
   lowered threshold are proposed, length by length.
2. One pass over all documents counts exactly every word, every proposed phrase,
   and the proposals' negative border: phrases that were not proposed although
   their beginning and their end (all but the last, all but the first word)
   were. Border phrases that occur nowhere have no count and are never formed.
3. A border phrase (or word) that turns out frequent is a failure: longer
   phrases with it were not counted. Then the border is expanded until it is
   closed: a phrase may be frequent if it was counted and is, or if it was not
   counted and its beginning and end may be. One more pass counts all that were
   not counted and may be. What it counts has no border of its own that was not
   counted, so no failure can follow it, whatever the sample was.

In a pass, tasks know the proposals, and then the frequent phrases, by bit tables
of bounded size (Bloom filters with two hashes). A false positive only has
something counted that need not be. Which phrases the first pass counts is a
fixed function of its table, so the second one knows it exactly, and a phrase is
counted wholly in one of them. Inside a task, words and phrases are numbered per
chunk of text without collisions, so counts are of the phrases themselves; the
table of counts is added up by Spark, with partial sums before the shuffle.

Scores are exact: integers of up to 38 digits, divided as integers.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows count each time; ties in score and count go by the phrase's UTF-8
bytes; an empty table gives no rows; other columns are not read. Texts are taken
whole; very long ones are worked on in chunks that overlap by four words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, sliced

LONGEST = 5
SAMPLE = 8  # one document in so many
CHUNK_BYTES = 4 << 20  # text of a language counted at a time
WAITING_BYTES = 12 << 20  # text of all languages that waits to be counted
BITS_EACH = 32  # of a table, for a phrase
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29  # 64 MB; beyond it more than the border is counted, with the same result

MARK = b"."  # stands for every mark that ends a piece, so no word has it
# Fixed value: the marks that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes(
    MARK[0] if b in ENDS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)

# One string for phrase and language makes the shuffled rows short; a phrase has no line feed, "" stands for all words.
COUNTS = "counted string, f long"
HASHED = "lang string, phrase string, h long"


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Proposals:
    """A bit table of phrase hashes. No phrase at all is in the empty one."""

    def __init__(self, bits: int = 0, rows: list = ()):
        self.bits = bits
        self.table = np.zeros(bits // 8, dtype=np.uint8)
        for bucket, content in rows:
            start = (bucket - 1) * 4096
            self.table[start : start + 4096] = np.frombuffer(content, dtype=np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(h), dtype=bool)
        out = np.ones(len(h), dtype=bool)
        for shift in (0, 32):
            at = ((h >> np.uint64(shift)) & np.uint64(self.bits - 1)).astype(np.int64)
            out &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _bit_table(proposed: DataFrame) -> Proposals:
    """The table of the column ``h``, built by tasks in pieces of 4 KB; its size is bounded by ``MOST_BITS``."""
    n = proposed.count()
    bits = LEAST_BITS
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))
    at = proposed.select(F.explode(F.array(low, high)).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("content")
    )
    return Proposals(bits, [(r["bucket"], bytes(r["content"])) for r in rows.toLocalIterator()])


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their beginnings and of their last words."""
    return _mixed(h * np.uint64(0x100000001B3) + last)


def _phrase_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase, word by word as tasks compute it."""
    for batch in batches:
        phrases = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
        seeds = [_seed(lang) for lang in batch.column("lang").to_pylist()]
        words = [[xxhash.xxh64_intdigest(w, seed) for w in phrase] for phrase, seed in zip(phrases, seeds)]
        h = np.array([w[0] for w in words], dtype=np.uint64)
        for k in range(1, LONGEST):
            has = np.array([len(w) > k for w in words], dtype=bool)
            last = np.array([w[k] if len(w) > k else 0 for w in words], dtype=np.uint64)
            h = np.where(has, _longer(h, last), h)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], ["lang", "phrase", "h"])


def _hashed(phrases: DataFrame) -> DataFrame:
    return phrases.select("lang", "phrase").mapInArrow(_phrase_hashes, HASHED)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the number of every key."""
    encoded = pa.array(keys).dictionary_encode()
    number = np.asarray(encoded.indices)
    found = np.asarray(encoded.dictionary)
    place = np.empty(len(found), dtype=np.int64)
    place[number] = np.arange(len(keys))
    return found, place, number


class _Counter:
    """Counts of the words and phrases of texts in one language, in the first pass or in a second.

    In the first pass a phrase is open if the table of proposals has it and its
    beginning and its end are open too; the pass counts a phrase whose beginning
    and end are open. In a second pass a phrase may be frequent if the table of
    frequent phrases has it, or if the first pass did not count it, and if its
    beginning and its end may be; the pass counts a phrase that the first one
    did not, and whose beginning and end may be frequent. Both are exact
    functions of the tables, false positives included.
    """

    def __init__(self, lengths: range, proposed: Proposals, frequent: Proposals | None = None):
        self.lengths, self.proposed, self.frequent = lengths, proposed, frequent

    def count(self, lang: str, text: bytes, skip: int = 0) -> Iterator[pa.RecordBatch]:
        """Counts in cleaned ``text``, of phrases that end behind its first ``skip`` tokens (words and marks)."""
        spaced = pa.array([text.replace(MARK, b" . ")], pa.binary()).view(pa.string())
        encoded = pc.split_pattern(spaced, " ").flatten().dictionary_encode()
        words, code = encoded.dictionary, np.asarray(encoded.indices)
        del spaced, encoded
        names = words.to_pylist()
        code = code[code != names.index("")] if "" in names else code
        mark = names.index(".") if "." in names else -1
        seed = _seed(lang)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), dtype=np.uint64, count=len(names))
        del names

        # Phrases of the present length: where each ends and its number; by number their hashes, texts, and state.
        end = np.flatnonzero(code != mark)
        number, h, texts = code[end], hashes, words
        if 1 in self.lengths:
            n = np.bincount(number[end >= skip], minlength=len(words))
            yield self._rows(lang, texts, n, np.flatnonzero(n))
            yield self._rows(lang, pa.array([""]), n.sum(keepdims=True), np.arange(1))
        opened = self.proposed.has(h)
        may = self.frequent.has(h) if self.frequent else opened
        place = np.empty(len(code), dtype=np.int32)
        for length in range(2, self.lengths[-1] + 1):
            # Only phrases that are open (or may be frequent) can be parts of one that is counted.
            on = may[number]
            end, number = end[on], number[on]
            place[:] = -1
            place[end] = number
            # A phrase is the one that ends a word earlier, and the word at its end.
            end = end[end > 0]
            end = end[place[end - 1] >= 0]
            if not len(end):
                return
            found, at, number = _numbered(place[end - 1].astype(np.int64) * len(words) + code[end])
            beginning, last = found // len(words), found % len(words)
            rest = place[end[at]]  # without its first word it ends at the same place
            h = _longer(h[beginning], hashes[last])
            texts = pc.binary_join_element_wise(texts.take(pa.array(beginning)), words.take(pa.array(last)), " ")
            first = opened[beginning] & opened[rest]  # the first pass counts it
            wanted = may[beginning] & may[rest]
            if self.frequent:
                may = wanted & (~first | self.frequent.has(h))
                wanted &= ~first
            opened = first & self.proposed.has(h)
            if not self.frequent:
                may = opened
            if length in self.lengths:
                n = np.bincount(number[end >= skip], minlength=len(found))
                yield self._rows(lang, texts, n, np.flatnonzero(wanted & (n > 0)))

    @staticmethod
    def _rows(lang: str, phrases: pa.Array, n: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        counted = pc.binary_join_element_wise(phrases.take(pa.array(some)), pa.scalar(lang), "\n")
        return pa.RecordBatch.from_arrays([counted, pa.array(n[some].astype(np.int64))], _NAMES)


_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def _tokens(text: bytes) -> list[bytes]:
    return [t for t in text.replace(MARK, b" . ").split(b" ") if t]


def _long_text(counter: _Counter, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
    """A text of more than a chunk: chunks end before a separator and repeat the last words of the one before."""
    start, carried = 0, b""
    while start < len(text):
        end = start + CHUNK_BYTES
        if end < len(text):
            stops = [p for p in (text.find(b" ", end), text.find(MARK, end)) if p >= 0]
            end = min(stops, default=len(text))
        chunk = carried + b" " + text[start:end]
        yield from counter.count(lang, chunk, len(_tokens(carried)))
        carried = b" ".join(_tokens(chunk)[1 - LONGEST :])
        start = end


def _tasks(lengths: range, tables: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(lengths, *(t.value for t in tables))
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                content = text.encode().translate(CLEAN)
                if len(content) > CHUNK_BYTES:
                    yield from _long_text(counter, lang, content)
                    continue
                waiting.setdefault(lang, []).append(content)
                sizes[lang] = sizes.get(lang, 0) + len(content)
                total += len(content)
                full = [lang] if sizes[lang] > CHUNK_BYTES else list(sizes) if total > WAITING_BYTES else []
                for one in full:
                    total -= sizes.pop(one)
                    yield from counter.count(one, MARK.join(waiting.pop(one)))
        for one, texts in waiting.items():
            yield from counter.count(one, MARK.join(texts))

    return run


def _counts(texts: DataFrame, lengths: range, tables: list, least: int) -> DataFrame:
    """Exact counts in ``texts`` of what the pass counts, from ``least`` on (and the number of words)."""
    partial = texts.mapInArrow(_tasks(lengths, tables), COUNTS)
    total = partial.groupBy("counted").agg(F.sum("f").alias("f"))
    kept = total.filter((F.col("f") >= least) | F.startswith(F.col("counted"), F.lit("\n")))
    border = F.position(F.lit("\n"), F.col("counted"))
    lang = F.substr(F.col("counted"), border + 1)
    return kept.select(lang.alias("lang"), F.substr(F.col("counted"), F.lit(1), border - 1).alias("phrase"), "f")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    least: int = 100, sample: int = SAMPLE, scratch: str | None = None,
) -> DataFrame:
    """``lang, phrase, words, f``: all phrases of one to five words that occur at least ``least`` times.

    A row with ``words`` 0 per language holds the number of its words.
    """
    spread = docs.sparkSession.sparkContext.broadcast
    texts = docs.filter(F.coalesce(F.length(text_col), F.lit(0)) > 0).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
    )
    sampled = texts.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(sample)) == 0).select("lang", "text")
    sampled, texts = keep(sampled, "sample", scratch), texts.select("lang", "text")
    # A phrase at the threshold is expected least / sample times in the sample; half a deviation below is proposed.
    expected = least / sample
    lowered = max(2, int(expected - expected**0.5 / 2))

    # The sample, length by length: a length's proposals prune the next one.
    words = _counts(sampled, range(1, 2), [spread(Proposals())], lowered).filter("phrase <> ''")
    proposed = keep(_hashed(words), "proposed", scratch)
    for length in range(2, LONGEST + 1):
        tables = [spread(_bit_table(proposed))]
        longer = _counts(sampled, range(length, length + 1), tables, lowered).filter("phrase <> ''")
        proposed = proposed.union(keep(_hashed(longer), "proposed", scratch))

    tables = [spread(_bit_table(proposed))]
    found = keep(_counts(texts, range(1, LONGEST + 1), tables, least), "counts", scratch)
    frequent = found.filter("phrase <> ''")
    if not frequent.join(proposed, ["lang", "phrase"], "left_anti").isEmpty():  # failures of the border
        tables.append(spread(_bit_table(keep(_hashed(frequent), "frequent-hashes", scratch))))
        found = found.union(keep(_counts(texts, range(2, LONGEST + 1), tables, least), "counts", scratch))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return found.select("lang", "phrase", size.alias("words"), "f")


def _words(phrase: Column, start: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    least: int = 100, top: int = 2000, sample: int = SAMPLE, scratch: str | None = None,
) -> DataFrame:
    """Each language's ``top`` phrases of two to five words by how much they exceed their parts.

    ``lang, rank, phrase, a, l, r, n, score``: ``a`` occurrences of the phrase;
    of its cuts into two parts, ``l`` and ``r`` times in the text, the one with the
    lowest score ``floor(1000 * a * n / (l * r))`` (``n`` words in all; of equal
    scores the shortest first part). A phrase inside a longer one that occurs as
    often is left out.
    """
    found = keep(frequent_phrases(docs, text_col, lang_col, id_col, least, sample, scratch), "frequent", scratch)
    counts = found.filter("words > 0").select("lang", "phrase", "f")
    total = found.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = found.filter("words > 1").withColumnRenamed("f", "a")

    # A longer phrase that occurs as often: one of one more word does too.
    longer = phrases.filter("words > 2").select(
        "lang", F.col("a").alias("f"),
        F.explode(F.array(
            _words(F.col("phrase"), 1, F.col("words") - 1), _words(F.col("phrase"), 2, F.col("words") - 1)
        )).alias("phrase"),
    )
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = phrases.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")

    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", _words(F.col("phrase"), 1, F.col("cut"))).withColumn(
        "rest", _words(F.col("phrase"), F.col("cut") + 1, F.col("words") - F.col("cut"))
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    score = F.call_function("div", above.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = (
        cuts.withColumn("score", score.cast("long"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
        .select("lang", "phrase", "best.*")
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
