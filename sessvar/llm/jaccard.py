"""Similarity join on n-gram sets: which documents have a Jaccard similarity of NUM / DEN or more, and what they connect.

Equal sets are one class. A class's n-grams are ordered rare first: by the count of their rarest word over the whole corpus (an upper
bound of how often the n-gram occurs; words outside the commonest KNOWN count as rarest), then by hash. Two sets that link share an n-gram
among the first n - ceil(n * NUM / DEN) + 1 of each, so classes are joined on those prefix n-grams. Candidates pass three filters, each a
bound that no link breaks: sizes; places of the shared n-gram (what is left after it must be enough); and, for the rest of the sets, the
Hamming distance, at least the number of 1,024 hash ranges in which the two sets' counts differ in parity.

Many sets may share a prefix n-gram, so within its group pairs are told in rounds: a round tells a spanning forest of the candidate
links between members that the group's own verified links do not connect yet, at most one pair for each, and every pair told is verified
once, exactly, against both sets. The next round looks at groups that told something and leaves out pairs found wanting. After ROUNDS
all that is left is told.
A group over BLOCK is split into blocks that meet two by two, so that none is one task's work and no pair is lost.

N-grams are compared by 64-bit hashes; a set's identity is 128 bits. A document without words has an empty set and no links.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

#: Production parameters: words of an n-gram; the similarity NUM / DEN; members of a group that are compared at once; rounds of forests.
WORDS = 3
NUM, DEN = 90, 100
BLOCK = 2048
ROUNDS = 3
#: Words whose counts tasks hold, the commonest ones: a fixed size, for n-grams' order alone, which may be any.
KNOWN = 1 << 18
#: Words a worker remembers, and words it counts, before it starts anew; ranges of the parity filter; bits of the filter of texts to read again.
REMEMBERED = 1 << 18
COUNTED = 1 << 20
RANGES = 1024
TEXT_BITS = 1 << 23
SEED = 7


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word to its place in ``hashes`` and ``counts`` (of the known ones; others count 0)."""

    def __init__(self, known: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.known = dict(zip(known.tolist(), counts.tolist(), strict=True))
        self.hashes, self.counts = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place == len(self.hashes):
            self.hashes, self.counts = np.resize(self.hashes, 2 * place), np.resize(self.counts, 2 * place)
        self.hashes[place] = h = xxhash.xxh64_intdigest(word, SEED)
        self.counts[place] = self.known.get(h, 0)
        self[word] = place
        return place

    def grams(self, text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of a text's n-grams, and each one's count of its rarest word. Fewer words than ``words``: one n-gram of them all."""
        if len(self) > REMEMBERED:
            self.clear()
        found = text.lower().split()
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ids = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        own, counts = self.hashes[ids], self.counts[ids]
        width = min(words, len(found))
        n = len(found) - width + 1
        h, rare = np.full(n, width, np.uint64), counts[:n]
        for k in range(width):
            h = _mixed(h + own[k : k + n])
            rare = np.minimum(rare, counts[k : k + n])
        order = np.argsort(h)
        h = h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        return h[first], rare[order[first]]


def prefix(h: np.ndarray, rare: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` of the sorted hashes ``h`` in the order of (rare, hash)."""
    cut = np.partition(rare, length - 1)[length - 1]
    below = np.flatnonzero(rare < cut)
    below = below[np.argsort(rare[below], kind="stable")]
    return h[np.concatenate([below, np.flatnonzero(rare == cut)[: length - len(below)]])]


def linkable(n: int, num: int = NUM, den: int = DEN) -> bool:
    """Whether a set of n can link to a different one: at best one with a single member more."""
    return n * den >= num * (n + 1)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n + (-num * n // den) + 1


def parity(h: np.ndarray) -> bytes:
    """A bit for each range of hashes: whether an odd number of the set's lie in it. Sets that differ in d members differ in d bits at most."""
    odd = np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=RANGES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def word_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the commonest words, KNOWN at most. All words of all texts are counted; the cut is where enough are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in held), np.uint64, len(held))
            return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(list(held.values()), pa.int64())], names=["h", "n"])

        for batch in batches:
            for part in common.slices([batch.select([0])]):
                for text in common.encoded(part):
                    held.update(text.lower().split())
                    if len(held) > COUNTED:
                        yield told()
                        held.clear()
        yield told()
        held.clear()
        pa.default_memory_pool().release_unused()

    counted = common.saved(common.texts(docs).select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "jaccard-words")
    levels = counted.groupBy(F.floor(4 * F.log2("n")).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    total, cut = 0, None
    for level in levels:  # at most 4 * 64 of them
        total += level["words"]
        if total > KNOWN:
            break
        cut = level["least"]
    kept = counted.filter(F.col("n") >= cut) if cut is not None else counted.limit(0)
    table = kept.toArrow()
    common.dropped(counted)
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], table.column("n").to_numpy()[order]


_ROW = "doc_id long, text_hash long, n long, digest binary, prefix array<long>, parity binary"


def _hashed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def rows_of(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of every row the size and digest of its set, and of sets that can link the prefix, in order, and the parities."""
    known, counts = word_counts(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words(known, counts)
        for batch in batches:
            for part in common.slices([batch]):
                sizes, digests, prefixes, parities = [], [], [], []
                for text in common.encoded(part):
                    h, rare = seen.grams(text, words)
                    sizes.append(len(h))
                    digests.append(hashlib.md5(h.tobytes(), usedforsecurity=False).digest() if len(h) else None)
                    if linkable(len(h), num, den):
                        prefixes.append(prefix(h, rare, prefix_length(len(h), num, den)).view(np.int64))
                        parities.append(parity(h))
                    else:
                        prefixes.append(None)
                        parities.append(None)
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "text_hash", "n", "digest", "prefix", "parity"])
        pa.default_memory_pool().release_unused()

    return _hashed(docs).mapInArrow(work, _ROW)


def classes_of(rows: DataFrame) -> DataFrame:
    """A row a distinct set: ``id``, ``least`` (smallest doc_id), the digest, one text that has it, size, prefix, parities."""
    grouped = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")
    )
    return common.saved(grouped.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")


def shared(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each prefix n-gram of a class that another class has in its prefix too: token, key (the two blocks that meet), id, n, pos, parity."""
    laid = classes.filter("prefix IS NOT NULL").select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    often = laid.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    met = laid.join(often, "token").withColumn("blocks", F.expr(f"cast((m + {block - 1}) div {block} as int)")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    key = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.least("block", c) * F.col("blocks") + F.greatest("block", c)))
    keyed = met.select("token", key.alias("key"), "id", "n", "pos")
    return keyed.join(classes.select("id", "parity"), "id").select("token", "key", "id", "n", "pos", "parity")


def passing(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, x: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of ``others`` may link with x, as far as size, place and parities tell."""
    a, b = n[x], n[others]
    least = -(-num * (a + b) // (num + den))
    near = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(a - pos[x], b - pos[others]) >= least)
    at = np.flatnonzero(near)
    if len(at):
        apart = np.bitwise_count(bits[others[at]] ^ bits[x]).sum(axis=1, dtype=np.int64)
        near[at] = apart <= a + b[at] - 2 * least[at]
    return near


def _group_pairs(n: np.ndarray, pos: np.ndarray, label: np.ndarray, bits: np.ndarray, barred: dict[int, list[int]], every: bool, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of one group, by place: a spanning forest of the candidate links between labels, or every one of them."""
    m = len(n)
    if every:
        for x in range(m - 1):
            rest = np.arange(x + 1, m)
            hits = rest[passing(n, pos, bits, x, rest, num, den) & (label[rest] != label[x])]
            for y in hits[~np.isin(hits, barred.get(x, []))].tolist():
                yield x, y
        return
    of_label = {v: np.flatnonzero(label == v) for v in np.unique(label).tolist()}
    free = np.ones(m, bool)
    for start in range(m):
        if not free[start]:
            continue
        queue = of_label[int(label[start])].tolist()
        free[queue] = False
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                return
            hits = rest[passing(n, pos, bits, x, rest, num, den)]
            hits = hits[~np.isin(hits, barred.get(x, []))]
            for y in hits.tolist():
                if free[y]:
                    yield min(x, y), max(x, y)
                    own = of_label[int(label[y])]
                    free[own] = False
                    queue += own.tolist()


def _stars(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, own: np.ndarray, starts: np.ndarray, every: bool, num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which groups (rows starts[g] to starts[g + 1]) are told at once, all rows of all groups together, and their pairs: those of one member, of two, and,
    unless every pair is asked for, those whose every member may link with the first. Groups that have told pairs before are left to :func:`_group_pairs`."""
    sizes = np.diff(starts)
    first = np.repeat(starts[:-1], sizes)
    at = np.arange(len(first))
    a, b = n[first], n[at]
    least = -(-num * (a + b) // (num + den))
    near = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(a - pos[first], b - pos[at]) >= least) & (at > first)
    close = np.flatnonzero(near)
    near[close] = np.bitwise_count(bits[first[close]] ^ bits[close]).sum(axis=1, dtype=np.int64) <= (a + b - 2 * least)[close]
    hits = np.add.reduceat(near.astype(np.int64), starts[:-1])
    simple = np.logical_and.reduceat(own, starts[:-1]) & ((sizes <= 2) | (not every) & (hits == sizes - 1))
    told = np.flatnonzero(near & np.repeat(simple, sizes))
    return simple, list(zip(first[told].tolist(), told.tolist(), strict=True))


_TOLD = "token long, key long, a long, b long"


def _labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Of one group's members the component that its verified links make, and of each place those that it is known not to link with."""
    place = {v: i for i, v in enumerate(ids.tolist())}
    root, barred = list(range(len(ids))), {}
    for x, y, yes in zip(a.tolist(), b.tolist(), linked.tolist(), strict=True):
        x, y = place[x], place[y]
        if not yes:
            barred.setdefault(x, []).append(y)
            barred.setdefault(y, []).append(x)
            continue
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    for i in range(len(root)):  # a root comes before what it stands for
        root[i] = root[root[i]]
    return np.array(root), barred


def told_pairs(members: DataFrame, results: DataFrame | None, every: bool, num: int = NUM, den: int = DEN) -> DataFrame:
    """(token, key, a, b), a < b, of the groups of ``members`` (token, key, id, n, pos, parity). ``results``: pairs told by a group before, and whether they link."""
    rows = members.select("token", "key", "id", "n", "pos", "parity", F.lit(None).cast("long").alias("other"), F.lit(False).alias("linked"))
    if results is not None:
        rows = rows.unionByName(results.select("token", "key", F.col("a").alias("id"), F.col("b").alias("other"), "linked"), allowMissingColumns=True)
    # by id too: groups of the same members then tell the same pairs
    sorted_ = rows.repartition("token", "key").sortWithinPartitions("token", "key", "id")
    none = bytes(RANGES // 8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["token", "key", "a", "b"])

        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            tables = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None and len(t)]
            if not tables:
                continue
            table = pa.concat_tables(tables)
            token, key = table.column("token").to_numpy(), table.column("key").to_numpy()
            starts = [0, *(np.flatnonzero((token[1:] != token[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(table)]
            # the last group may go on in the next batch
            whole = len(starts) - 1 if batch is None else len(starts) - 2
            held = None if batch is None else table.slice(starts[whole])
            if not whole:
                continue
            done = table.slice(0, starts[whole])
            own, linked = done.column("other").is_null().to_numpy(), done.column("linked").to_numpy()
            ids, n, pos, other = (done.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("id", "n", "pos", "other"))
            parities = done.column("parity").fill_null(none).combine_chunks()
            bounds = np.frombuffer(parities.buffers()[1], np.int32)[parities.offset :]
            bits = np.frombuffer(parities.buffers()[2], np.uint8)[bounds[0] : bounds[len(own)]].view(np.uint64).reshape(len(own), -1)
            edges = np.array(starts[: whole + 1])
            simple, stars = _stars(n, pos, bits, own, edges, every, num, den)
            out += [(int(token[x]), int(key[x]), int(ids[x]), int(ids[y])) for x, y in stars]
            for g in np.flatnonzero(~simple).tolist():
                rows_ = np.arange(starts[g], starts[g + 1])
                mine, old = rows_[own[rows_]], rows_[~own[rows_]]
                label, barred = _labels(ids[mine], ids[old], other[old], linked[old])
                if label.any():
                    out += [(int(token[mine[0]]), int(key[mine[0]]), int(ids[mine[x]]), int(ids[mine[y]])) for x, y in _group_pairs(n[mine], pos[mine], label, bits[mine], barred, every, num, den)]
                if len(out) > 50_000:
                    yield told()
                    out.clear()
        yield told()
        pa.default_memory_pool().release_unused()

    return sorted_.mapInArrow(work, _TOLD)


def sets_of(docs: DataFrame, needed: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, items) of the classes of ``needed`` (id, digest, text_hash): texts are read again, and those that may be needed are made sets.

    A filter of TEXT_BITS bits over their hashes, put together by the executors, keeps other ones from being shuffled; the join is what decides.
    """
    words_of_bits = needed.select((F.pmod("text_hash", F.lit(TEXT_BITS)).cast("int")).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits")).collect()
    flags = np.zeros(TEXT_BITS // 64, np.int64)
    for r in words_of_bits:
        flags[r["word"]] = r["bits"]
    set_bits = np.unpackbits(flags.view(np.uint8), bitorder="little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = np.zeros(0, np.uint64)
        seen = Words(set_, set_.view(np.int64))
        for batch in batches:
            wanted = set_bits[np.mod(batch.column(1).to_numpy(), TEXT_BITS)].astype(bool)
            for part in common.slices([batch.filter(pa.array(wanted))]):
                found = [seen.grams(text, words)[0] for text in common.encoded(part)]
                digests = [hashlib.md5(f.tobytes(), usedforsecurity=False).digest() for f in found]
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["digest", "items"])
        pa.default_memory_pool().release_unused()

    read = _hashed(docs).mapInArrow(work, "digest binary, items array<long>").groupBy("digest").agg(F.first("items").alias("items"))
    return common.saved(read.join(needed.select("id", "digest"), "digest").select("id", "items"), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, linked): whether the two sets link, by their exact intersection, which built-in functions count."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items"))
    both = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    counted = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("a_items") + F.size("b_items")).cast("long").alias("sizes"))
    return counted.select("a", "b", (den * F.col("both") >= num * (F.col("sizes") - F.col("both"))).alias("linked"))


def links(docs: DataFrame, classes: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame | None:
    """(a, b): verified links between classes that connect what all links connect; None if no two classes are candidates."""
    open_ = common.saved(shared(classes, block), "jaccard-open")
    members, results, told, sets, known = open_, None, None, None, None
    for turn in range(rounds + 1):
        now = common.saved(told_pairs(members, results, turn == rounds, num, den), "jaccard-pairs")
        if not now.limit(1).count():
            break
        pairs = now.select("a", "b").distinct()
        if sets is None:
            # a class that has any candidate is in the first round's forest, so no other set is ever needed
            needed = now.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "digest", "text_hash"), "id")
            sets = sets_of(docs, needed, words)
        fresh = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        checked = common.saved(verified(fresh, sets, num, den), "jaccard-verified")
        known = checked if known is None else known.unionByName(checked)
        groups = now.select("token", "key").distinct()
        told = now if told is None else told.join(groups, ["token", "key"], "left_semi").unionByName(now)
        members, results = open_.join(groups, ["token", "key"], "left_semi"), told.join(known, ["a", "b"])
    common.dropped(open_)
    return known.filter("linked").select("a", "b") if known is not None else None


def linked_classes(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`rows_of` and :func:`classes_of`, saved, and the :func:`links` between classes."""
    rows = common.saved(rows_of(docs, words, num, den), "jaccard-rows")
    classes = classes_of(rows)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    # the links alone stay of what their search writes
    found = common.only(docs.sparkSession, lambda: links(docs, classes, words, num, den, block, rounds) or none, "jaccard-links")
    return rows, classes, found


def near_sets(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable over links, of every row.

    Rows of one doc_id may lie in different components. A component of null ids alone has a null id.
    """
    rows, classes, found = linked_classes(docs, words, num, den, block, rounds)
    rooted = classes.join(graph.components(found), F.col("id") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "id").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").select(F.col("digest").alias("d"), "component_id")
    with_words = rows.filter("digest IS NOT NULL").join(of_class.hint("merge"), F.col("digest") == F.col("d")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(rows.filter("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the 3-gram set and component of every document at a similarity of 0.9."""
    return near_sets(common.documents(spark, sf_dir).select("doc_id", "text"))
