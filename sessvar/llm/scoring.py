"""Language-model scores by online logistic context mixing.

A text is coded as a stream of bits. A frequent word is a path in a Huffman tree over the frequent words; any other
word is an escape and, if it is new, its bytes, each a path in a second tree. Three predictors guess every bit, each from
counts of zeros and ones in a table indexed by a hash of its context and the tree node: for words the
contexts are nothing, the previous word, and the previous two; for bytes the last two, three and four.
Their log odds are mixed by weights that a gate picks, from how much the longer contexts have seen. The
mix is then refined by how bits with that gate and mixed odds turned out.

Training is online in every task and reads the corpus once: a chunk of some words is predicted with the counts, weights and
refinement so far, and only then do these learn from it. The tasks' counts add up to those of the whole corpus, their weights
are averaged by how many bits they saw. Those tables are of bounded size and broadcast. Two more are Spark tables that
grow with the corpus and are joined, by 64-bit hashes:

- the counts of all words. An infrequent word that training knows costs its share of the infrequent words; any other is spelled.
  How likely a new word is follows from the share of words that occur once, and these are what spelling is learned from.
- passages. After some three-word contexts, picked by hash and so alike in every copy of a passage, one more bit says whether the
  words up to the next such context are those which mostly followed it; its chance depends on how many did, and is
  learned from the corpus. If so, they need no further bits.

A training document is scored as if the occurrence at hand had not been counted, so that its score and that of a held-out
document mean the same. A document's score depends on nothing but the model, the document and whether it was held out.

Beside the rules of :mod:`.common`: a very long text is coded by itself, in memory in proportion to it; repeated rows are
each scored, and are passages to one another; ties between passages go to the greater hash.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Production parameters: frequent words at most, slots of a predictor's table at most (powers of two), folds of which the first is held out.
HEAD = 1 << 17
TABLE_BITS = 21
#: Times that a frequent word is seen at least; one in how many contexts, of how many words, begins a passage.
LEAST_SEEN = 4
EVERY, CONTEXT = 24, 3
#: Most frequent words that are classes of their own, and those that make up the longest context.
OWN_CLASS, COMMON = 1024, 64
FOLDS = 10
#: Bytes of text whose words are looked up at a time; tokens, and bytes of spelled words, whose bits are predicted at a time and then learned; rate of the weights; additive constant of the counts.
LOOKED_UP = 3 << 19
CHUNK, SPELLED = 2048, 12_000
RATE = 0.6
DELTA = 0.4
#: Bytes of text whose words are counted at a time; these counts are summed by Spark.
COUNTED = 4 << 20
PREDICTORS = 3
#: The number that a mixer has where tables have theirs.
MIXER = PREDICTORS
GATES = 2 * 4 * 4 * 4
STEPS = 33
#: Mixed odds lie within plus and minus MOST, in so many LEVELS a unit.
MOST, LEVELS = 16, 16
#: Tasks that add up mixers before they are collected.
ADDERS = 64
BLOCK = 1 << 16

#: The end token, which no word can be, and the byte that ends a spelled word.
END, STOP = "\n", 32
#: Fixed value: the seed of hashes of words, as that of Spark's xxhash64.
SEED = 42


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all, A-Z lower-cased, as bytes."""
    # a copy of its own first: Arrow lower-cases wrong bytes of a slice that was cast
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string(), safe=False)
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    each, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    # white space at either end of a text leaves an empty piece
    full = pc.not_equal(each, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return np.diff(before[ends - ends[0]]), each.filter(full).view(pa.large_binary())


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    for batch in common.slices(batches):
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(sizes)]
        for low, high in itertools.pairwise(bounds):
            yield batch.slice(low, high - low)


def word_counts(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(word, c) over all documents that are not held out, with the end token of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, COUNTED):
            found = tokens(batch.column(batch.schema.get_field_index("text")))[1].value_counts()
            yield pa.record_batch([found.field("values").view(pa.large_string()).cast(pa.string()), found.field("counts")], names=["word", "c"])
            if batch.num_rows:
                yield pa.record_batch([pa.array([END]), pa.array([batch.num_rows], pa.int64())], names=["word", "c"])

    training = common.texts(docs).filter(common.id_crc(folds) != 0)
    return training.mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, length) of each symbol's path, and the nodes and bits of all paths, one after the other. Ties break by symbol."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    n = len(weights)
    while len(heap) > 1:
        (wa, oa, a), (wb, ob, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (wa + wb, min(oa, ob), n + len(children)))
        children.append((a, b))
    paths: dict[int, tuple[tuple[int, int], ...]] = {}
    stack = [(heap[0][2], ())] if heap else []
    while stack:
        node, path = stack.pop()
        if node < n:
            paths[node] = path
        else:
            for bit, child in enumerate(children[node - n]):
                stack.append((child, (*path, (node - n, bit))))
    length = np.array([len(paths[i]) for i in range(n)], np.int64)
    offset = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    nodes = np.array([step[0] for i in range(n) for step in paths[i]], np.int64)
    bits = np.array([step[1] for i in range(n) for step in paths[i]], np.int8)
    return offset, length, nodes, bits


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 32-bit hashes of whole numbers."""
    x = x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x >> np.uint64(32)).astype(np.uint32)


@dataclass
class Tree:
    """A Huffman tree. Each step of each path has its node and one byte: from the lowest bit its place in the subtree of the last three levels (three bits),
    the bit it stands for, and how deep it lies and in which tree (three bits).

    A group is a hash of the node at which the last three levels began.
    The slots of a group lie side by side, so that three bits take one line of a table from memory.
    ``packed``: from the highest bit the group (32 bits), the node (24) and the byte of each step, so that one access to memory brings all.
    """

    offset: np.ndarray
    length: np.ndarray
    packed: np.ndarray

    @property
    def step(self) -> np.ndarray:
        """Node, and in the low eight bits depth and tree, and the bit."""
        node, byte = (self.packed >> np.uint64(8)).astype(np.uint32) & np.uint32(0xFFFFFF), self.packed.astype(np.uint8)
        return node << np.uint32(8) | (byte >> np.uint8(4)).astype(np.uint32) << np.uint32(1) | (byte >> np.uint8(3) & np.uint8(1))

    @classmethod
    def of(cls, weights: list[int], kind: int) -> Tree:
        offset, length, nodes, bits = huffman(weights)
        at = np.arange(len(nodes)) - np.repeat(offset, length)
        deep = (at > 2).astype(np.uint8) + (at > 5) + (at > 9)
        place, root = np.ones(len(nodes), np.uint8), nodes.copy()
        for back in (1, 2):
            inside = np.flatnonzero(at % 3 >= back)
            root[inside] = nodes[inside - at[inside] % 3]
        for k in (1, 2):  # one and two levels below the root of the group
            inside = np.flatnonzero(at % 3 == k)
            place[inside] = 2 * place[inside - 1] + bits[inside - 1]
        byte = place | bits.astype(np.uint8) << np.uint8(3) | (deep + np.uint8(4 * kind)) << np.uint8(4)
        if len(weights) > 1 << 24:
            raise ValueError("a tree has 2**24 symbols at most")
        group = (root * 2 + kind).astype(np.uint32) * np.uint32(0x85EBCA6B)
        return cls(offset.astype(np.int32), length.astype(np.int32), group.astype(np.uint64) << np.uint64(32) | nodes.astype(np.uint64) << np.uint64(8) | byte)


@dataclass
class Stream:
    """Bits in one tree, in order of documents: the bit, its slot for each predictor, the depth's part of its gate, the first bit of each symbol."""

    bit: np.ndarray
    slots: list[np.ndarray]
    depth: np.ndarray
    starts: np.ndarray

    def by_symbol(self, value: np.ndarray) -> np.ndarray:
        """Sums over each symbol's bits."""
        return np.add.reduceat(value, self.starts, dtype=np.float64)


def bits_of(tree: Tree, symbol: np.ndarray, contexts: list[np.ndarray | None], table_bits: int) -> Stream:
    """A context of None is none at all: its slots are the nodes' numbers."""
    n = tree.length[symbol]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    at = np.repeat(tree.offset[symbol] - ends[:-1], n)
    at += np.arange(len(at))
    packed = tree.packed.take(at)
    byte, group, slots = packed.astype(np.uint8), (packed >> np.uint64(32)).astype(np.uint32), []
    place = (byte & np.uint8(7)).astype(np.uint32)
    for k, context in enumerate(contexts):
        if context is None:
            packed >>= np.uint64(8)
            packed &= np.uint64((1 << min(table_bits, 24)) - 1)
            slots.append(packed.view(np.intp))
            continue
        mixed = np.repeat(_mix(context * 4 + k + 1), n)
        mixed ^= group
        mixed *= np.uint32(0x9E3779B1)
        mixed >>= np.uint32(35 - table_bits)
        mixed <<= np.uint32(3)
        mixed |= place
        slots.append(mixed.astype(np.intp))
    return Stream((byte >> np.uint8(3) & np.uint8(1)).astype(np.intp), slots, byte & np.uint8(0x70), ends[:-1])


@dataclass
class Coded:
    """What a batch of texts is coded as: tokens of each text with its end, id of each token among the frequent words (-1: none; the last of each
    text is the end), places of the others, these words and their hashes, the text of each token, and the symbols and contexts that its bits are made of."""

    sizes: np.ndarray
    ids: np.ndarray
    rare_at: np.ndarray
    rare: list[bytes]
    hashes: np.ndarray
    doc: np.ndarray
    coder: Coder
    symbol: np.ndarray
    contexts: list[np.ndarray]

    def bits(self, at: slice | np.ndarray) -> Stream:
        """The bits of some tokens."""
        return bits_of(self.coder.words, self.symbol[at], [None, *(c[at] for c in self.contexts)], self.coder.table_bits)

    @property
    def stream(self) -> Stream:
        return self.bits(slice(None))


@dataclass
class Coder:
    """Texts to bits with the contexts of their predictors. ``head``: the frequent words and their training counts."""

    head: dict[bytes, int]
    head_counts: np.ndarray
    escapes: int
    ends: int
    table_bits: int
    words: Tree = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.head)
        self.escape, self.end = n, n + 1
        # the words in order of their numbers, to look them up many at a time
        self.known = pa.array(sorted(self.head, key=self.head.__getitem__), pa.large_binary())
        self.words = Tree.of([int(c) for c in self.head_counts] + [self.escapes + 1, self.ends + 1], 0)

    def __getstate__(self) -> dict:
        """Without the words as Python objects, which tasks don't need."""
        return self.__dict__ | {"head": None}

    def code(self, texts: pa.Array | list[bytes]) -> Coded:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        n_words, flat = tokens(texts)
        sizes = n_words + 1
        last = np.cumsum(sizes) - 1
        ids = np.full(int(sizes.sum()), -1, np.int64)
        inside = np.ones(len(ids), bool)
        inside[last] = False
        ids[inside] = pc.fill_null(pc.index_in(flat, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        unknown = (ids < 0) & inside
        at_unknown = np.flatnonzero(unknown)
        doc = np.repeat(np.arange(len(texts)), sizes)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = flat.buffers()[2] or b""
        last_letter = np.frombuffer(data, np.uint8).take(ends[1:] - 1).astype(np.int32)
        bounds, data = at_unknown - doc[at_unknown], memoryview(data)
        rare = [bytes(data[a:b]) for a, b in zip(ends[bounds].tolist(), ends[bounds + 1].tolist(), strict=True)]
        symbol = np.where(unknown, self.escape, ids).astype(np.int32)
        symbol[last] = self.end
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
        kind = np.zeros(len(ids), np.int32)
        kind[inside] = OWN_CLASS + last_letter
        own = (ids >= 0) & (ids < OWN_CLASS)
        kind[own] = ids[own]
        previous = np.zeros_like(kind)
        previous[1:] = kind[:-1] + 1
        previous[first] = 0
        # the last two very common words before each token of its document
        very = symbol < min(COMMON, self.escape)
        common_at, rank = np.flatnonzero(very), np.cumsum(very) - very
        padded = np.concatenate([[-1, -1], common_at])
        start_of = first[doc]
        recent = [np.where((at := padded[rank + 1 - k]) >= start_of, symbol[np.maximum(at, 0)] + 1, 0) for k in (0, 1)]
        ids[last] = self.end
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, SEED) for w in rare), np.uint64, len(rare))
        return Coded(sizes, ids, at_unknown, rare, hashes, doc, self, symbol, [previous, recent[0] * (COMMON + 1) + recent[1]])


@dataclass
class Speller:
    """Words to bits, byte by byte with a space at the end, under contexts of the last two, three and four bytes."""

    weights: list[int]
    table_bits: int
    letters: Tree = field(init=False)

    def __post_init__(self) -> None:
        self.letters = Tree.of(self.weights, 1)

    def code(self, words: list[bytes]) -> tuple[Stream, np.ndarray]:
        """The bits, and the first byte of each word. There is at least one word."""
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(raw)) - np.repeat(starts, lengths)
        back = [np.where(place >= k, np.concatenate([np.full(k, STOP), raw[:-k]])[: len(raw)], STOP) for k in (1, 2, 3, 4)]
        two = back[0] << 8 | back[1]
        three = two << 8 | back[2]
        return bits_of(self.letters, raw, [two, three, three << 8 | back[3]], self.table_bits), starts

    def spelled(self, words: list[bytes], odds: Odds, mixer: Mixer) -> np.ndarray:
        """The bits of each word."""
        if not words:
            return np.zeros(0)
        stream, starts = self.code(words)
        return np.add.reduceat(stream.by_symbol(mixer.code_length(stream.bit, *odds.look(stream))), starts)


def _seen(total: np.ndarray) -> np.ndarray:
    """None, few, some, many."""
    out = (total > 0).view(np.uint8)
    out += total > 2
    out += total > 12
    return out


def _step(mixed: np.ndarray) -> np.ndarray:
    step = mixed * 2
    step += STEPS // 2
    return np.clip(np.rint(step, out=step), 0, STEPS - 1, out=step).astype(np.intp)


#: The middle of each cell of the refinement.
MIDDLE = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(DELTA)) / (zeros + np.float32(DELTA)))


@dataclass
class Tables:
    """Counts of zeros and ones by predictor and slot, next to each other."""

    counts: np.ndarray

    @classmethod
    def empty(cls, table_bits: int) -> Tables:
        return cls(np.zeros((PREDICTORS, 2 << table_bits), np.uint32))

    def parts(self) -> Iterator[tuple[int, int, bytes]]:
        """(table, block, compressed counts) of blocks that are not empty."""
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, flat in enumerate(self.counts):
            for at in range(0, len(flat), BLOCK):
                if flat[at : at + BLOCK].any():
                    yield k, at // BLOCK, pack(flat[at : at + BLOCK].astype(np.uint64).tobytes())

    def learn(self, stream: Stream, mixer: Mixer) -> None:
        """Predicts each bit with what was learned before these, then learns from them.

        The predictors' log odds of each bit come from the counts so far; its gate is its depth and tree, and how often the longer two contexts were seen.
        A predictor's bits are counted right after its counts were read, while these are in the cache.
        """
        found, gate = [], stream.depth.copy()
        for k, slots in enumerate(stream.slots):
            seen = self.counts[k].view(np.uint64).take(slots).view(np.uint32)
            at = slots << 1
            at += stream.bit
            np.add.at(self.counts[k], at, np.uint32(1))
            zeros, odds = seen[::2].astype(np.float32), seen[1::2].astype(np.float32)
            if k:
                gate += _seen(zeros + odds) << np.uint8(2 if k == 1 else 0)
            zeros += np.float32(DELTA)
            odds += np.float32(DELTA)
            odds /= zeros
            found.append(np.log(odds, out=odds))
        mixer.learn(stream.bit, found, gate.astype(np.intp))


@dataclass
class Odds:
    """The predictors' log odds by slot, in 64ths; the lowest two bits of each number tell how often its slot was seen.

    ``without_own``: two numbers a slot, as if the bit at hand, zero or one, had not been counted.
    """

    odds: np.ndarray
    without_own: bool

    @classmethod
    def of(cls, table_bits: int, parts: list[tuple[int, int, bytes]], without_own: bool) -> Odds:
        each, unpack = 2 if without_own else 1, zstandard.ZstdDecompressor().decompress
        odds = np.zeros((PREDICTORS, each << table_bits), np.int16)
        for k, block, data in parts:
            counts = np.frombuffer(unpack(data), np.uint64).astype(np.float32).reshape(-1, 2)
            for own in range(each):
                zeros, ones = counts[:, 0], counts[:, 1]
                if without_own:
                    zeros, ones = (np.maximum(zeros - 1, 0), ones) if own == 0 else (zeros, np.maximum(ones - 1, 0))
                value = np.rint(_log_odds(zeros, ones) * 64).astype(np.int16) << 2 | _seen(zeros + ones)
                odds[k, block * (BLOCK // 2) * each + own :: each][: len(value)] = value
        return cls(odds, without_own)

    def look(self, stream: Stream) -> tuple[list[np.ndarray], np.ndarray]:
        """The predictors' log odds of each bit, and its gate, as :meth:`Tables.learn` has them, of the whole corpus."""
        found, gate = [], stream.depth.copy()
        for k, slots in enumerate(stream.slots):
            if self.without_own:
                slots = slots << 1  # noqa: PLW2901
                slots += stream.bit
            value = self.odds[k].take(slots)
            if k:
                gate += (value.astype(np.uint8) & np.uint8(3)) << np.uint8(2 if k == 1 else 0)
            value >>= 2
            found.append(value.astype(np.float32))
            found[-1] *= np.float32(1 / 64)
        return found, gate.astype(np.intp)


_HELD: dict[tuple[int, bool], tuple[object, Odds]] = {}


def held_odds(model: Model, without_own: bool) -> Odds:
    """The odds of a model that was broadcast, for texts outside its training or inside, made once for each worker that is used again."""
    place = (model.kind, without_own)
    if place not in _HELD or _HELD[place][0] is not model:
        _HELD[place] = (model, Odds.of(model.coder.table_bits, model.parts, without_own))
    return _HELD[place][1]


@dataclass
class Mixer:
    """Weights by gate, and how bits of a gate and a step of mixed odds turned out."""

    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, PREDICTORS), 0.4))
    turned: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS, 2)))
    used: np.ndarray = field(default_factory=lambda: np.zeros(GATES))
    costs: np.ndarray | None = None

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype(np.float32)
        out = weights[0].take(gate)
        out *= odds[0]
        for k in range(1, PREDICTORS):
            part = weights[k].take(gate)
            part *= odds[k]
            out += part
        return np.clip(out, -MOST, MOST, out=out)

    def learn(self, bit: np.ndarray, odds: list[np.ndarray], gate: np.ndarray) -> None:
        mixed = self.mixed(odds, gate)
        cell = gate * STEPS
        cell += _step(mixed)
        cell <<= 1
        cell += bit
        turned = np.bincount(cell, minlength=GATES * STEPS * 2).reshape(GATES, STEPS, 2)
        self.turned += turned
        self.used += turned.sum(axis=(1, 2))
        np.negative(mixed, out=mixed)
        np.exp(mixed, out=mixed)
        mixed += 1
        chance = np.reciprocal(mixed, out=mixed)
        error = bit.astype(np.float32)
        error -= chance
        slack = chance - chance * chance
        # a damped step for each gate, scaled by the curvature of its bits along each predictor
        step = np.empty((GATES, PREDICTORS))
        for k in range(PREDICTORS):
            pull = np.bincount(gate, error * odds[k], GATES)
            curve = odds[k] * odds[k]
            curve *= slack
            curve = np.bincount(gate, curve, GATES)
            step[:, k] = pull / (PREDICTORS * curve + 30)
        self.weights += RATE * np.clip(step, -1, 1)

    def packed(self) -> bytes:
        return np.concatenate([(self.weights * self.used[:, None]).ravel(), self.used, self.turned.ravel()]).tobytes()

    @classmethod
    def of(cls, packed: list[bytes]) -> Mixer:
        """The average of mixers by use, gate by gate; the refinements add up."""
        mixer = cls()
        if packed:
            total = np.sum([np.frombuffer(p) for p in packed], axis=0)
            summed, mixer.used, turned = np.split(total, [GATES * PREDICTORS, GATES * (PREDICTORS + 1)])
            seen = mixer.used > 0
            mixer.weights[seen] = summed.reshape(GATES, PREDICTORS)[seen] / mixer.used[seen, None]
            mixer.turned = turned.reshape(GATES, STEPS, 2)
        mixer.costs = mixer._costs()
        return mixer

    def _costs(self) -> np.ndarray:
        """Bits that a zero and a one take, by gate and level of mixed odds: half by the mix, half by its refinement, in which a cell of few bits leans to its middle."""
        level = np.arange(2 * MOST * LEVELS + 1) / LEVELS - MOST
        refined = (self.turned[:, :, 1] + 20 * MIDDLE) / (self.turned.sum(axis=2) + 20)
        chance = 0.5 / (1 + np.exp(-level)) + 0.5 * refined[:, _step(level)]
        return -np.log2(np.clip(np.stack([1 - chance, chance], axis=2), 1e-9, 1)).astype(np.float32).ravel()

    def code_length(self, bit: np.ndarray, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Bits that each bit takes. The mixed odds are rounded to levels alike for zero and one, whose chances still add up to one."""
        mixed = self.mixed(odds, gate)
        mixed += np.float32(MOST)
        mixed *= np.float32(LEVELS)
        level = np.rint(mixed, out=mixed).astype(np.intp)
        level += gate * (2 * MOST * LEVELS + 1)
        level <<= 1
        level += bit
        return self.costs.take(level)


@dataclass
class Model:
    """A coder (kind 0: of texts, 1: of words) with the summed parts of its tables and its mixer; of bounded size."""

    kind: int
    coder: Coder | Speller
    parts: list[tuple[int, int, bytes]]
    mixer: Mixer


def _summed(parts: DataFrame) -> DataFrame:
    """Adds up the parts of each (table, block); a task holds the blocks that hash to it and reads the parts one after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k, block, data = (c[i].as_py() for c in batch.columns)
                own = np.frombuffer(unpack(data), np.uint64)
                if (k, block) in total:
                    total[k, block] += own
                else:
                    total[k, block] = own.copy()
        rows = [(k, b, pack(v.tobytes())) for (k, b), v in total.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["t", "block", "data"])

    return parts.repartition("t", "block").mapInArrow(work, parts.schema)


def _learned(rows: DataFrame, kind: int, coder: Coder | Speller) -> Model:
    """The model of the texts (or words) of ``rows``, read once; the tasks' tables and mixers are summed in tasks, and their sums, of bounded size, collected."""
    coding = rows.sparkSession.sparkContext.broadcast(coder)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, mixer = None, Mixer()
        for batch in _slices(batches, SPELLED if kind else LOOKED_UP):
            tables = tables or Tables.empty(coding.value.table_bits)
            if kind:
                tables.learn(coding.value.code(common.encoded(batch))[0], mixer)
                continue
            coded = coding.value.code(batch.column(batch.schema.get_field_index("text")))
            for at in range(0, len(coded.symbol), CHUNK):
                tables.learn(coded.bits(slice(at, at + CHUNK)), mixer)
        if tables:
            for k, block, data in [*tables.parts(), (MIXER, 0, mixer.packed())]:
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["t", "block", "data"])

    # As many rows as ADDERS, of fixed size, are collected.
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = np.frombuffer(data) + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["data"])

    learned = common.saved(rows.mapInArrow(learn, "t int, block int, data binary"), "model-parts")
    found = _summed(learned.filter(F.col("t") != MIXER)).collect()
    mixers = learned.filter(F.col("t") == MIXER).select("data").repartition(ADDERS).mapInArrow(add, "data binary").collect()
    common.dropped(learned)
    return Model(kind, coder, sorted((r["t"], r["block"], bytes(r["data"])) for r in found), Mixer.of(sorted(bytes(r["data"]) for r in mixers)))


def _fitting(n: int, most: int) -> int:
    """Table bits for ``n`` symbols."""
    return min(most, max(15, math.ceil(math.log2(n + 1)) + 1))


def train(docs: DataFrame, counts: DataFrame, head: int = HEAD, table_bits: int = TABLE_BITS, folds: int = FOLDS) -> tuple[Model, Model]:
    """The models of texts and of the spelling of new words, of bounded size: at most ``head`` words and ``PREDICTORS * 2**table_bits`` slots each.

    The frequent words are those seen LEAST_SEEN times or more whose count is in the highest classes, sixteenths of a power of two, that hold no more than ``head`` words.
    Words that are seen once are what spelling is learned from.
    """
    classes = F.floor(F.log2("c") * 16).cast("int")
    held = sorted(((r["k"], r["n"]) for r in counts.filter(F.col("word") != END).groupBy(classes.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room = list(itertools.accumulate(n for _, n in held))
    least = max(int(math.log2(LEAST_SEEN) * 16), next((k + 1 for (k, _), n in zip(held, room, strict=True) if n > head), 0))
    frequent = counts.filter((F.col("word") != END) & (classes >= least)).orderBy(F.desc("c"), "word").collect()
    once, is_end = F.count_if(F.col("c") == 1), F.col("word") == END
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0)), once).first()
    words, known = {r["word"].encode(): i for i, r in enumerate(frequent)}, np.array([r["c"] for r in frequent], np.int64)
    coder = Coder(words, known, total[0] - total[1] - int(known.sum()), total[1], _fitting(total[0], table_bits))
    seen = np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256) + 1
    speller = Speller(seen.tolist(), _fitting(8 * total[2], table_bits))
    of_texts = _learned(common.texts(docs).filter(common.id_crc(folds) != 0), 0, coder)
    return of_texts, _learned(counts.filter((F.col("c") == 1) & ~is_end).select(F.col("word").alias("text")), 1, speller)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def passages(coded: Coded, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, hash of the context, hash of the words) of each passage: from a picked context to the next, or to the end of the text."""
    ids, n = coded.ids, len(coded.ids)
    with np.errstate(over="ignore"):
        own = _mix64(ids.astype(np.uint64) + np.uint64(1))
        own[coded.rare_at] = coded.hashes
        context = np.zeros(n, np.uint64)
        for k in range(1, CONTEXT + 1):
            context[k:] = context[k:] * np.uint64(0x9E3779B97F4A7C15) + own[: n - k]
        context = _mix64(context)
        place = np.arange(n) - np.repeat(np.cumsum(coded.sizes) - coded.sizes, coded.sizes)
        at = np.flatnonzero((context % np.uint64(every) == 0) & (place >= CONTEXT))
        if not len(at):
            return at, context[at], context[at]
        first = np.cumsum(coded.sizes) - coded.sizes
        # sums run from a passage's start to the next one's, or to the next text's
        bounds = np.union1d(at, first)
        since = np.arange(n) - np.repeat(bounds, np.diff(np.append(bounds, n)))
        sums = np.add.reduceat(_mix64(own + (since.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), bounds)
    return at, context[at], sums[np.searchsorted(bounds, at)]


#: What :func:`_first_scores` returns of each row: sums over its frequent words for the base score, bits before the first passage, its passages, and its infrequent words by
#: hash, with the passage each lies in (0: before the first) and, in held-out texts, the bits of its spelling.
FIRST = "row_key long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_head long, head_sum double, bits double, passages array<struct<context:long,words:long,bits:float>>, rare array<struct<h:long,passage:int,spelled:float>>"
FIRST_NAMES = ("row_key", "doc_id", "held_out", "n_bytes", "n_tokens", "n_head", "head_sum", "bits", "passages", "rare")


def _lists(sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _first_scores(docs: DataFrame, models: tuple[Model, Model], ends: int, folds: int) -> DataFrame:
    known = np.log10(np.concatenate([models[0].coder.head_counts, [0, ends]]) + 0.1)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def score(batch: pa.RecordBatch, key: int) -> pa.RecordBatch:
        model, spelling = sent.value
        texts, flags = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        coded, n = model.coder.code(texts), len(texts)
        bits, of_held = np.zeros(len(coded.ids)), flags[coded.doc]
        for held in (True, False):
            own = np.flatnonzero(of_held == held)
            for low in range(0, len(own), CHUNK):
                at = own[low : low + CHUNK]
                stream = coded.bits(at)
                bits[at] = stream.by_symbol(model.mixer.code_length(stream.bit, *held_odds(model, without_own=not held).look(stream)))
        spelt, new = np.zeros(len(coded.rare), np.float32), of_held[coded.rare_at]
        if new.any():
            spelt[new] = spelling.coder.spelled(list(itertools.compress(coded.rare, new)), held_odds(spelling, without_own=False), spelling.mixer)
        spelled = pa.array(spelt, mask=~new)
        at, context, words = passages(coded)
        # which passage of its text each token lies in
        starts = np.zeros(len(coded.ids), np.int64)
        starts[at] = 1
        number = np.cumsum(starts)
        first = np.cumsum(coded.sizes) - coded.sizes
        number -= np.repeat(number[first] - starts[first], coded.sizes)
        cost = np.zeros(0)
        if len(at):
            cost = np.bincount(np.cumsum(starts)[number > 0] - 1, bits[number > 0], len(at))
        in_head = (coded.ids >= 0) & (known[coded.ids] > -1)
        columns = [
            pa.array(np.arange(n) + key), batch.column(0), batch.column(2), pc.binary_length(texts).cast(pa.int64()), pa.array(coded.sizes),
            pa.array(np.bincount(coded.doc, in_head, n).astype(np.int64)), pa.array(np.bincount(coded.doc, np.where(coded.ids >= 0, known[coded.ids], 0), n)),
            pa.array(np.bincount(coded.doc, np.where(number == 0, bits, 0), n)),
            _lists(np.bincount(coded.doc[at], minlength=n), {"context": pa.array(context.view(np.int64)), "words": pa.array(words.view(np.int64)), "bits": pa.array(cost.astype(np.float32))}),
            _lists(np.bincount(coded.doc[coded.rare_at], minlength=n), {"h": pa.array(coded.hashes.view(np.int64)), "passage": pa.array(number[coded.rare_at].astype(np.int32)), "spelled": spelled}),
        ]
        return pa.record_batch(columns, names=FIRST_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40  # the same in a task that is run again
        for batch in _slices(batches, LOOKED_UP):
            if batch.num_rows:
                yield score(batch, key)
                key += batch.num_rows

    return common.texts(docs, (common.id_crc(folds) == 0).alias("held_out")).mapInArrow(work, FIRST)


def _known_words(counts: DataFrame, spelling: Model) -> DataFrame:
    """(h, c, once) of each word, by hash: its count and, if that is one, the bits of its spelling as if it had not been seen."""
    sent = counts.sparkSession.sparkContext.broadcast(spelling)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, SPELLED):
            model = sent.value
            bits = model.coder.spelled(common.encoded(batch), held_odds(model, without_own=True), model.mixer)
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(bits.astype(np.float32))], names=["h", "c", "once"])

    rows = counts.select(F.col("word").alias("text"), F.xxhash64("word").alias("h"), "c")
    seen = rows.filter("c > 1").select("h", "c", F.lit(None).cast("float").alias("once"))
    return rows.filter("c = 1").mapInArrow(work, "h long, c long, once float").unionByName(seen)


#: A context with at least so many times its even share of passages is joined from a broadcast, of at most this many rows.
HOT = 1000


def _followed(rows: DataFrame) -> DataFrame:
    """Each passage of each row, with what mostly followed its context in the training, the passage at hand left out:
    ``n`` times of ``total``, and whether the passage is it (``same``); n is null where the context was not seen."""
    each = rows.select("row_key", "held_out", F.posexplode("passages").alias("i", "p")).select("row_key", "held_out", (F.col("i") + 1).alias("passage"), "p.*")
    counted = each.filter("not held_out").groupBy("context", "words").agg(F.count("*").alias("n"))
    table = common.saved(counted.groupBy(F.col("context").alias("c")).agg(F.sum("n").alias("total"), F.max(F.struct("n", "words")).alias("top")), "passages")
    # fewer than HOT contexts can have over one in HOT of all passages
    share = F.lit((table.agg(F.sum("total")).first()[0] or 0) / HOT)
    hot = F.broadcast(table.filter(F.col("total") > share))
    found = each.join(hot, F.col("context") == F.col("c")).unionByName(each.join(hot.select("c"), F.col("context") == F.col("c"), "left_anti").join(table.hint("merge"), F.col("context") == F.col("c"), "left"))
    same = F.coalesce(F.col("top.words") == F.col("words"), F.lit(False))
    own = (~F.col("held_out")).cast("long")
    n, total = F.col("top.n") - F.when(same, own).otherwise(0), F.col("total") - own
    # where only the passage itself is the most frequent, another that followed once is expected, and is not it
    return found.select("row_key", "held_out", "passage", "bits", F.when(total > 0, F.greatest(n, F.lit(1))).alias("n"), total.alias("total"), (same & (n > 0)).alias("same"))


def _flags(followed: DataFrame) -> DataFrame:
    """Adds ``flag``, the bits of saying whether a passage is what was expected, by how often that followed and whether anything else did."""
    gate = F.when(F.col("n").isNotNull(), F.least(F.col("n"), F.lit(8)) * 2 + (F.col("n") == F.col("total")).cast("long"))
    followed = followed.withColumn("gate", gate)
    turned = followed.filter("gate is not null and not held_out").groupBy("gate").agg(F.count_if("same").alias("hits"), F.count("*").alias("all")).collect()  # at most 16 rows
    chance = {r["gate"]: (r["hits"] + 0.5) / (r["all"] + 1) for r in turned}
    flag = F.lit(1.0)  # a gate that training never met
    for g, p in sorted(chance.items()):
        flag = F.when(F.col("gate") == g, F.when(F.col("same"), -math.log2(p)).otherwise(-math.log2(1 - p))).otherwise(flag)
    return followed.withColumn("flag", F.when(F.col("gate").isNotNull(), flag).otherwise(0.0))


def scored(docs: DataFrame, head: int = HEAD, table_bits: int = TABLE_BITS, folds: int = FOLDS) -> DataFrame:
    """Scores every row with a model of all rows that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score as log10 probabilities, n_bytes, and
    bits_per_byte (null for an empty text). A null or empty text is its end token.
    """
    counts = common.saved(word_counts(docs, folds), "word-counts")
    seen = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"),
        F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    models = train(docs, counts, head, table_bits, folds)
    rows = common.saved(_first_scores(docs, models, seen["ends"], folds), "scores")
    # infrequent words: all that are not in the head
    infrequent = max(models[0].coder.escapes, 1)
    new = min(max(seen["once"] / infrequent, 0.001), 0.999)
    rare = rows.select("row_key", "held_out", F.explode("rare").alias("r")).select("row_key", "held_out", "r.*")
    table = _known_words(counts, models[1]).withColumnRenamed("h", "k").hint("merge")
    counted = rare.join(table, F.col("h") == F.col("k"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    others = F.col("c") - (~F.col("held_out")).cast("long")
    bits = F.when(others > 0, -F.log2(others * F.lit((1 - new) / infrequent))).otherwise(F.coalesce("spelled", "once") - math.log2(new))
    words = counted.select("row_key", "passage", bits.alias("bits"), F.lit(0.0).alias("flag"), F.lit(False).alias("same"), F.log10(F.col("c") + 0.1).alias("base"), (F.col("c") > 0).cast("long").alias("known"))
    coded = _flags(common.saved(_followed(rows), "passages-followed"))
    passages_ = coded.select("row_key", "passage", F.col("bits").cast("double").alias("bits"), "flag", "same", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
    # both groupings lie by row_key, so the rows move once
    moved = words.unionByName(passages_).repartition("row_key")
    of_passage = moved.groupBy("row_key", "passage").agg(F.sum("bits").alias("bits"), F.sum("flag").alias("flag"), F.max("same").alias("same"), F.sum("base").alias("base"), F.sum("known").alias("known"))
    of_row = of_passage.groupBy(F.col("row_key").alias("k")).agg(F.sum(F.col("flag") + F.when(F.col("same"), 0.0).otherwise(F.col("bits"))).alias("more"), F.sum("base").alias("rare_sum"), F.sum("known").alias("n_rare"))
    joined = rows.drop("rare", "passages").join(of_row.hint("merge"), F.col("row_key") == F.col("k"), "left")
    each = math.log10(seen["n"] + 0.1 * (seen["v"] + 1))
    bits = F.col("bits") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(seen["n"]).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (-bits * math.log10(2)).alias("score"),
        "n_bytes",
        F.try_divide(bits, "n_bytes").alias("bits_per_byte"),
    )


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(common.documents(spark, sf_dir))
