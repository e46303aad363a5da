"""Token ids and token counts of whole texts inside Spark tasks.

Texts repeat their words far more often than their sentences. Both encoders
below split a text at single spaces, let the tokenizer library encode each
distinct word once, and put the text's result together from the words. That is
exact because no token of these two vocabularies spans the boundary before a
single space between two non-space characters:

* byte-level BPE: its pre-tokenizer starts a new word at such a space;
* sentencepiece BPE: no piece has a word mark after another character
  (checked when the model is loaded).

A text where the argument does not hold (runs of white space around a space,
special-token strings, a vocabulary with other rules) goes to the library whole.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 500_000  # words in each of the two generations that a Python worker remembers
GROUP_CHARS = 1 << 23  # texts split into words at a time
TEXTS = 8192  # texts given to an encoder at a time; a word that several of them have is looked up once
SLICE = 10_000  # words given to the library at a time
LINE = 200  # new words encoded as one text


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``GROUP_CHARS`` characters: a text's words take far more memory than the text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


MARKS = string.punctuation  # ASCII: never letters or digits to the pre-tokenizer


class _WordMemo:
    """What is known about words, in two generations: words in use pass on to the next, the others are forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.memo: dict = {}
        self.before: dict = {}

    def unknown(self, words: Iterable[str]) -> list[str]:
        """Those of the distinct ``words`` that are not known; all others are in ``memo`` afterwards."""
        if len(self.memo) > self.size:
            self.before, self.memo = self.memo, {}
        missing = [w for w in words if w not in self.memo]
        self.memo.update((w, self.before[w]) for w in missing if w in self.before)
        return [w for w in missing if w not in self.before]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is visible in Latin-1, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class ByteBpeEncoder(_WordMemo):
    """Ids of texts by a ``tokenizers`` file, as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        super().__init__(memo_words)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec.get("truncation") is None
            and spec.get("padding") is None
        )
        self.model = self.tokenizer.model
        self.visible = dict(enumerate(byte_alphabet()))
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        # Tokens that begin with a space, which the byte-level alphabet writes as U+0120.
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _pack(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), SLICE):
            encodings = self.tokenizer.encode_batch_fast(texts[i : i + SLICE], add_special_tokens=False)
            out += [_pack_ids(e.ids) for e in encodings]
        return out

    def _pack_letters(self, word: str) -> bytes:
        """Ids of letters that follow a space: one word to the pre-tokenizer, so the library's model takes it as it is."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        return _pack_ids([t.id for t in self.model.tokenize("\u0120" + word)])

    def _pack_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space, many words to a text: the library's cost is mostly per text.

        No word has a space in it, or white space at its ends, so exactly the
        first token of each begins with a space and shows where the word starts.
        """
        out: list[bytes] = []
        for start in range(0, len(words), SLICE):
            lines = [words[i : i + LINE] for i in range(start, min(start + SLICE, len(words)), LINE)]
            texts = [" " + " ".join(line) for line in lines]
            encodings = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for line, text, encoding in zip(lines, texts, encodings):
                ids = np.array(encoding.ids, dtype="<u4")
                starts = np.flatnonzero(self.opens[ids])
                if len(starts) != len(line) or any(s in text for s in self.specials):
                    out += self._pack([" " + w for w in line])
                    continue
                packed = ids.tobytes()
                bounds = [*(4 * starts).tolist(), len(packed)]
                out += [packed[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._pack(texts)
        return [ids for group in _groups(texts) for ids in self._encode_group(group)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words that follow a space, or None for words that may not be taken alone."""
        memo = self.memo
        # Letters and marks after them are two words to the pre-tokenizer; the letters serve all marks.
        stems = [w.rstrip(MARKS) for w in words]
        lettered = list(map(str.isalpha, stems))
        for stem in {s for s, letters in zip(stems, lettered) if letters}:
            if not memo.get(stem):
                memo[stem] = self._pack_letters(stem)
        marks = [w[len(s) :] for w, s in zip(words, stems)]
        runs = list({m for m, letters in zip(marks, lettered) if letters})
        ids_of = dict(zip(runs, self._pack(runs)))
        memo.update((w, memo[s] + ids_of[m]) for w, s, m, letters in zip(words, stems, marks, lettered) if letters)
        plain = [w for w, letters in zip(words, lettered) if not letters]
        memo.update(dict.fromkeys(plain))
        # A word with white space at its ends, or no characters, borders on a run of white space.
        fit = [w for w in plain if w and not w[0].isspace() and not w[-1].isspace()]
        memo.update(zip(fit, self._pack_words(fit)))

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        split = _Split(texts)
        words = split.words
        # The first word of a text does not follow a space: it has ids of its own, behind those of the words.
        starts = split.bounds[:-1]
        follows = np.ones(len(split.places), dtype=bool)
        follows[starts] = False
        used = np.zeros(len(words), dtype=bool)
        used[split.places[follows]] = True
        self._learn(self.unknown([w for w, u in zip(words, used.tolist()) if u]))
        firsts = [words[i] for i in split.places[starts].tolist()]
        known = [self.memo[w] if u else b"" for w, u in zip(words, used.tolist())]
        places = split.places.copy()
        places[starts] = len(words) + np.arange(len(texts))
        # Words that are not to be taken alone are null here, and null stays null when their places are filled.
        ids = pa.array(known + self._pack(firsts), pa.large_binary()).take(pa.array(places))
        alone = np.concatenate([[0], np.cumsum(np.asarray(ids.is_valid()))])[split.bounds]
        counts = np.diff(split.bounds)
        fails = (np.diff(alone) < counts).tolist()
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset :][split.bounds].tolist()
        content = memoryview(ids.buffers()[2] or b"")
        out: list[bytes] = []
        whole = []
        for i, (text, first, n, a, b) in enumerate(zip(texts, firsts, counts.tolist(), ends, ends[1:])):
            odd = n > 1 and (first == "" or first[-1].isspace() or any(s in text for s in self.specials))
            if odd or fails[i]:
                whole.append(i)
            out.append(b"" if odd or fails[i] else bytes(content[a:b]))
        for i, ids_of in zip(whole, self._pack([texts[i] for i in whole])):
            out[i] = ids_of
        return out


class _Split:
    """Texts cut at single spaces: the distinct ``words``, their ``places`` and where each text's places begin."""

    def __init__(self, texts: list[str]):
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        self.bounds = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.places = np.asarray(coded.indices).astype(np.int64)


def _pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise RuntimeError("array('I') is not 32 bits wide on this platform")
    return packed.tobytes()


class PieceCounter(_WordMemo):
    """Token counts of texts by a sentencepiece model."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        super().__init__(memo_words)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = self.model.encode("  a b  c　", out_type=str)  # neither trimmed, folded nor joined
        self.by_word = all("▁" not in p.lstrip("▁") for p in pieces) and "".join(plain) == "▁▁▁a▁b▁▁c　"

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._counts(texts)
        return [n for group in _groups(texts) for n in self._count_group(group)]

    def _count_group(self, texts: list[str]) -> list[int]:
        split = _Split(texts)
        new = self.unknown(split.words)
        self.memo.update(zip(new, self._counts(new)))
        known = np.fromiter(map(self.memo.__getitem__, split.words), dtype=np.int64, count=len(split.words))
        empty = np.fromiter((w == "" for w in split.words), dtype=bool, count=len(split.words))
        starts = split.bounds[:-1]
        out = np.add.reduceat(known[split.places], starts).tolist()
        # A space at an end, or two in a row.
        whole = np.flatnonzero(np.add.reduceat(empty[split.places].astype(np.int64), starts)).tolist()
        for i, n in zip(whole, self._counts([texts[i] for i in whole])):
            out[i] = n
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpeEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the Python worker."""
    return ByteBpeEncoder(path)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
