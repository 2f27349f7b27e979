"""Token ids of whole texts, word by word.

The vocabulary drops white space and never joins characters across it, so a text's ids are its words'
ids one after the other. Words repeat, so a worker keeps the ids of words and of their parts in
bounded tables; only parts not in them are merged, and odd words take the tokenizer as it is.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import regex

#: Words and parts of a generation, some 200 bytes each. A worker remembers two: a full one becomes the old one, from which what is met again is taken over. No result depends on it.
REMEMBERED = 300_000
#: Parts merged in one call, and words of the texts split at a time.
GROUP, GROUP_WORDS = 64, 75_000

#: Fixed values of the vocabulary: how a lower-cased word falls into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of printable ASCII and Latin-1 alone; in them lower-casing and composing are the plain ones.
PLAIN = re.compile(r"[\x21-\x7E\xA1-\xFF]+")
#: The markers that the vocabulary itself would find inside a word.
MARKER = "<|"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or the next free letter from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


def parts_of(text: str) -> list[str]:
    """The parts of a PLAIN word; the two commonest shapes, letters and letters with a mark after them, need no pattern."""
    low = text.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha() and not low[-1].isnumeric():
        return [low[:-1], low[-1]]
    return PARTS.findall(low)


class WordEncoder:
    """bytes of little-endian unsigned 32-bit ids for UTF-8 texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.merge = Tokenizer(self.full.model)
        self.merge.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.full.model.end_of_word_suffix
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        letters = _byte_letters()
        self.letters = str.maketrans({chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)})
        # ids of words and of parts, lower-cased, which as words of their own have the same
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn_parts(self, parts: list[bytes]) -> None:
        texts = [p.decode() if p.isascii() else p.decode().translate(self.letters) for p in parts]
        found = self.merge.encode_batch_fast([" ".join(texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)], add_special_tokens=False)
        ids = np.array([i for encoding in found for i in encoding.ids], "<u4")
        ends, raw = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
        self.words.update(zip(parts, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _learn(self, words: set[bytes]) -> None:
        known, old, plain, odd, new = self.words, self.old, [], [], set()
        for word in words:
            if (ids := old.get(word)) is not None:
                known[word] = ids
            elif word.isalpha():  # of bytes: ASCII letters
                plain.append((word, (word.lower(),)))
            elif word[:-1].isalpha() and 0x21 <= word[-1] <= 0x7E:
                low = word.lower()
                plain.append((word, (low[:-1], low[-1:])))
            elif PLAIN.fullmatch(text := word.decode()) and MARKER not in text:
                plain.append((word, [p.encode() for p in parts_of(text)]))
            else:
                odd.append((word, text))
        for _, parts in plain:
            for part in parts:
                if part not in known:
                    if (ids := old.get(part)) is not None:
                        known[part] = ids
                    else:
                        new.add(part)
        if new:
            self._learn_parts(list(new))
        for word, parts in plain:
            known[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        if odd:
            found = self.full.encode_batch_fast([t for _, t in odd], add_special_tokens=False)
            for (word, _), encoding in zip(odd, found, strict=True):
                known[word] = np.array(encoding.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        # a few texts at a time, so that memory follows them and not the batch
        start = 0
        while start < len(texts):
            split, size = [], 0
            while start < len(texts) and (not split or size <= GROUP_WORDS):
                split.append(texts[start].split())
                size += len(split[-1])
                start += 1
            if len(self.words) > REMEMBERED:
                self.old, self.words = self.words, {}
            known = self.words
            new = set().union(*split).difference(known)
            if new:
                self._learn(new)
            out += [b"".join(map(known.__getitem__, words)) for words in split]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker and vocabulary; tasks that share a worker share what it remembers."""
    return WordEncoder(path)
