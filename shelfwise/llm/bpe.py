"""Operator 11: byte-level BPE encoding and decoding with contiguous rank arrays.

The merges of a ``tokenizers`` file become arrays: the rank of a pair of parts
and the part that a rank makes. A short word holds its parts, and beside them
the rank of every adjacent pair, contiguously. Again and again its smallest rank
is found by a scan, the boundary inside that pair is deleted (what follows moves
up by one), and the two ranks at its sides are refreshed; a word is ready when
no pair has a rank. Words of about equal length lie below each other, a row
each, and every step is taken for all of their rows at once; ready rows leave.
Scans cost the square of a word's length, so words of more than ``SHORT`` bytes
take their smallest rank from a heap over linked parts instead.

A text falls into words by the pre-tokenizer's pattern. Texts repeat their words,
so each Python worker remembers what stands between two single spaces, and the
words in it, for a while; a space between two characters that are not white
space always begins a new word. Characters on which the pattern's library and
the tokenizer's disagree (newer code points) are found out one by one, and what
has them is cut into words by the tokenizer. Strings of added tokens are cut out
first, as the library does. Long texts are worked on in sections that end before
such a space.

Decoding looks up the bytes of all ids of a batch at once and reads each text's
bytes as UTF-8, invalid ones as U+FFFD.

Defined results: a null or empty text has no ids; null ids have a null text, ids
outside of the vocabulary are left out; repeated rows each get a row; keys of any
type and null keys are kept; an empty table gives no rows; other columns are not
read. A vocabulary file of other rules (normalizer, dropout, prefixes, tokens
that strip their surroundings) is refused when it is loaded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import sliced
from shelfwise.llm.tokens import byte_alphabet

SHORT = 48  # bytes; longer words take the heap
CELLS = 1 << 19  # parts of the words that are worked on at a time
MEMO_CHUNKS = 500_000  # in each of the two generations that a Python worker remembers
MEMO_WORDS = 150_000
SECTION = 1 << 20  # characters of a text worked on at a time
GROUP = 1 << 21  # characters of several texts worked on at a time
ROWS = 2048  # of a batch taken at a time
WORDS = 200_000  # words of one text looked up at a time

NO_RANK = np.iinfo(np.int32).max

# Fixed value: the pre-tokenizer's pattern for byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenBytes:
    """What decoding needs of a vocabulary file: the bytes of every id."""

    def __init__(self, spec: dict):
        ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens") or []}}
        self.size = max(ids.values()) + 1
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        content: list[bytes | None] = [None] * self.size
        for token, i in ids.items():
            content[i] = bytes(map(byte_of.__getitem__, token)) if byte_of.keys() >= set(token) else token.encode()
        self.known = np.array([c is not None for c in content])
        self.content = pa.array([c or b"" for c in content], pa.large_binary())

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each list of ids."""
        flat = ids.flatten()
        counts = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], dtype=np.int64)
        ends = np.cumsum(counts)
        known = np.asarray(flat.is_valid())
        numbers = np.asarray(flat.fill_null(-1), dtype=np.int64)
        known &= (numbers >= 0) & (numbers < self.size)
        known[known] = self.known[numbers[known]]
        ends = np.concatenate([[0], np.cumsum(known)])[ends] if len(flat) else ends
        tokens = self.content.take(pa.array(numbers[known]))
        at = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        content = memoryview(tokens.buffers()[2]) if len(tokens) and tokens.buffers()[2] else memoryview(b"")
        bounds = at[np.concatenate([[0], ends])].tolist()
        texts = [str(content[a:b], "utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [t if valid else None for t, valid in zip(texts, ids.is_valid().to_pylist())]


class RankTable:
    """The merges of a vocabulary file as arrays, and the BPE of words by them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or any(model.get(name) for name in plain):
            raise ValueError("not a plain byte-level BPE model")
        vocabulary: dict[str, int] = model["vocab"]
        self.size = max(vocabulary.values()) + 1
        self.base = self.size + 1  # the id ``size`` fills rows up and has no pair
        self.of_byte = np.array([vocabulary[c] for c in byte_alphabet()], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[side]] for p in pairs], dtype=np.int64) for side in (0, 1))
        self.makes = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        # An entry beyond all keys, so that a search always ends at one.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank_at = np.append(order, NO_RANK).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts, ``NO_RANK`` where they do not merge."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_at[at], np.int32(NO_RANK))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as packed little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], SHORT, side="right")]
        start = 0
        while start < len(short):
            # A block's rows are as long as its last word: so many rows that they have CELLS parts at most.
            widths = lengths[short[start : start + CELLS]]
            fit = np.arange(1, len(widths) + 1) * np.maximum(widths, 1) <= CELLS
            block = short[start : start + max(1, int(fit.sum()))]
            rows, counts = self._short([words[i] for i in block], lengths[block])
            packed = rows[np.arange(rows.shape[1]) < counts[:, None]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(block.tolist(), [0, *ends], ends):
                out[i] = packed[a:b]
            start += len(block)
        for i in order[len(short) :].tolist():
            out[i] = self._long(words[i])
        return out

    def _short(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of all words, a row each, and how many there are in each row."""
        n, width = len(words), max(int(lengths.max(initial=0)), 1)
        parts = np.full((n, width), self.size, dtype=np.int32)
        parts[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((n, width), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])

        ready, counts = np.full((n, width), self.size, dtype=np.int32), np.zeros(n, dtype=np.int64)
        rows, left = np.arange(n), lengths.copy()
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # of equal ranks the leftmost
            least = ranks[np.arange(len(rows)), at]
            live = least != NO_RANK
            if not live.all():
                done = ~live
                ready[rows[done], : parts.shape[1]] = parts[done]
                counts[rows[done]] = left[done]
                parts, ranks, rows, left, at, least = (x[live] for x in (parts, ranks, rows, left, at, least))
                if not len(rows):
                    break
                width = int(left.max())
                parts, ranks, columns = parts[:, :width].copy(), ranks[:, :width].copy(), columns[:width]
            row = np.arange(len(rows))
            made = self.makes[least]
            behind = columns[:-1] > at[:, None]
            # The boundary inside the pair goes: the parts behind it move up by one, and so do their ranks.
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            parts[:, -1], ranks[:, -1] = self.size, NO_RANK
            parts[row, at] = made
            after = np.where(at + 1 < width, parts[row, np.minimum(at + 1, width - 1)], self.size)
            ranks[row, at] = self.ranks(made, after)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks(parts[before, at[before] - 1], made[before])
            left -= 1
        return ready, counts

    def _long(self, word: bytes) -> bytes:
        """A long word: the smallest rank comes from a heap, and parts are linked instead of moved."""
        parts = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(parts)
        first = self.ranks(parts[:-1], parts[1:])
        some = np.flatnonzero(first != NO_RANK)
        heap = list(zip(first[some].tolist(), some.tolist()))
        heapify(heap)
        rank = [*first.tolist(), NO_RANK]
        ids, following, preceding = parts.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        table = dict(zip(self.keys[:-1].tolist(), self.rank_at[:-1].tolist())) if n > 4096 else None

        def look_up(a: int, b: int) -> int:
            key = a * self.base + b
            if table is not None:
                return table.get(key, NO_RANK)
            i = int(np.searchsorted(self.keys, key))
            return int(self.rank_at[i]) if self.keys[i] == key else NO_RANK

        while heap:
            r, i = heappop(heap)
            if gone[i] or rank[i] != r:
                continue  # an entry from before a merge
            j = following[i]
            ids[i] = int(self.makes[r])
            gone[j] = 1
            following[i] = k = following[j]
            rank[i] = NO_RANK
            if k < n:
                preceding[k] = i
                rank[i] = look_up(ids[i], ids[k])
                if rank[i] != NO_RANK:
                    heappush(heap, (rank[i], i))
            if (h := preceding[i]) >= 0:
                rank[h] = look_up(ids[h], ids[i])
                if rank[h] != NO_RANK:
                    heappush(heap, (rank[h], h))
        return np.array([p for p, g in zip(ids, gone) if not g], dtype="<u4").tobytes()


class _Memory:
    """Results by key in two generations: keys in use pass on to the newer one, the others are forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; the others can be looked up in ``new`` afterwards."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        lacking = keys.difference(self.new)
        known = lacking.intersection(self.old)
        self.new.update((k, self.old[k]) for k in known)
        return list(lacking.difference(known))


class RankEncoder:
    """Ids of whole texts by a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if (
            spec.get("normalizer") is not None
            or pre.get("type") != "ByteLevel"
            or not pre.get("use_regex", True)
            or pre.get("add_prefix_space", True)
            or any(t.get(rule) for t in added for rule in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.table = RankTable(spec)
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.pattern = regex.compile(PATTERN)
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.chunks, self.words = _Memory(MEMO_CHUNKS), _Memory(MEMO_WORDS)
        self.agreed, self.odd = set(map(chr, range(128))), set()

    def _is_odd(self, text: str) -> bool:
        """Whether ``text`` has characters that the pattern and the tokenizer take for different kinds."""
        for c in set(text) - self.agreed:
            if c not in self.odd:
                probe = f"a{c}1{c}-{c} {c}{c}b"
                same = [probe[a:b] for _, (a, b) in self.cut(probe)] == self.pattern.findall(probe)
                (self.agreed if same else self.odd).add(c)
        return bool(self.odd) and not self.odd.isdisjoint(text)

    def _cut_words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        if self._is_odd(text):
            yield [text[a:b] for _, (a, b) in self.cut(text)]
            return
        found = self.pattern.finditer(text)
        while words := [m.group() for m in islice(found, WORDS)]:
            yield words

    def _learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words)
        self.words.new.update(zip(new, self.table.encode_words([w.encode() for w in new])))

    def _whole(self, text: str) -> bytes:
        out = []
        for words in self._cut_words(text):
            self._learn_words(set(words))
            out.append(b"".join(map(self.words.new.__getitem__, words)))
        return b"".join(out)

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Ids of what follows a single space; None for a chunk at whose ends the argument about spaces fails."""
        for start in range(0, len(chunks), WORDS):
            some = chunks[start : start + WORDS]
            fit = [c for c in some if c and not c[0].isspace() and not c[-1].isspace()]
            self.chunks.new.update(dict.fromkeys(set(some).difference(fit)))
            if self._is_odd("".join(set().union(*fit))):
                cuts = [[w for words in self._cut_words(" " + c) for w in words] for c in fit]
            else:
                cuts = [self.pattern.findall(" " + c) for c in fit]
            self._learn_words(set().union(*cuts))
            look_up = self.words.new.__getitem__
            self.chunks.new.update((c, b"".join(map(look_up, words))) for c, words in zip(fit, cuts))

    def _sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """Sections of a text that end before a space between two other characters; whether the space was left out."""
        start, follows = 0, False
        while len(text) - start > SECTION:
            space = regex.search(r"\S \S", text, pos=start + SECTION - 1)
            if space is None:
                break
            yield text[start : space.start() + 1], follows
            start, follows = space.start() + 2, True
        yield text[start:], follows

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut into words as they are."""
        if sum(map(len, texts)) > 2 * GROUP:  # a section in which no space is free of other white space
            return [self._whole(t) for t in texts]
        cuts = [[w for words in self._cut_words(t) for w in words] for t in texts]
        self._learn_words(set().union(*cuts))
        look_up = self.words.new.__getitem__
        return [b"".join(map(look_up, words)) for words in cuts]

    def _encode_sections(self, sections: list[tuple[str, bool]]) -> list[bytes]:
        chunks = [text.split(" ") for text, _ in sections]
        # A section that does not follow a space begins with a chunk without one: it is cut into words by itself.
        inner = [c if follows else c[1:] for c, (_, follows) in zip(chunks, sections)]
        self._learn_chunks(self.chunks.missing(set().union(*inner)))
        look_up = self.chunks.new.__getitem__
        firsts = ["" if follows else c[0] for c, (_, follows) in zip(chunks, sections)]
        out: list[bytes] = []
        whole = []
        for i, ((_, follows), first, rest, ids) in enumerate(zip(sections, firsts, inner, self._by_words(firsts))):
            try:
                if rest and not follows and (not first or first[-1].isspace()):
                    raise TypeError
                out.append(ids + b"".join(map(look_up, rest)))
            except TypeError:  # white space beside a space
                out.append(b"")
                whole.append(i)
        texts = [" " + text if follows else text for text, follows in (sections[i] for i in whole)]
        for i, ids in zip(whole, self._by_words(texts)):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as packed little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[str, bool]] = []
        owners: list[int] = []
        size = 0

        def work_off() -> None:
            for owner, ids in zip(owners, self._encode_sections(waiting)):
                out[owner].append(ids)
            waiting.clear()
            owners.clear()

        for i, text in enumerate(texts):
            parts = self.added_pattern.split(text) if self.added_pattern else [text]
            for j, part in enumerate(parts):
                if j % 2:  # the string of an added token
                    work_off()
                    out[i].append(self.added[part])
                    continue
                for section in self._sections(part):
                    waiting.append(section)
                    owners.append(i)
                    size += len(section[0])
                    if size >= GROUP:
                        work_off()
                        size = 0
        work_off()
        return [b"".join(ids) for ids in out]


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the Python worker."""
    return RankEncoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    with open(path, encoding="utf-8") as f:
        return TokenBytes(json.load(f))


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for every row of ``docs``: the ids of its whole text, without special tokens around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            packed = rank_encoder(tokenizer_path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(packed)], [key, "ids"])

    kept = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, kept)


def decode(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, text`` for every row of ``encoded (key, ids)``: the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            texts = token_bytes(tokenizer_path).decode(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [key, "ids", "text"])

    kept = T.StructType([encoded.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    return encoded.select(F.col(key), F.col("ids").cast("array<int>")).mapInArrow(run, kept)
