"""Statistics of whole texts, many documents at a time.

A slice of texts is one byte buffer; bytes are classed by lookup tables and counted per document, words
are hashed once, and repeated eight-word windows are found by sorting rolling hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Bytes of text counted at a time: about ten times as much is held meanwhile.
SLICE = 1 << 20

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = _table(b" \t\n\x0b\x0c\r")
FOLLOWS = np.arange(256) & 0xC0 == 0x80  # continuation bytes: not a code point of their own
CLASSES = {
    "symbols": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digits": _table(b"0123456789"),
    "exclaims": _table(b"!?"),
    "stops": _table(b".,;:"),
    "others": _table(b"()[]{}\"'=+-_/\\@~^`"),
    "newlines": _table(b"\n"),
    "wide": ~(np.arange(256) < 128) & ~FOLLOWS,
}

#: What :func:`count` returns of each document, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_doubled_words", "n_chars", *(c for c in CLASSES if c != "symbols"), "n_lines", "n_word_forms", "n_short_words", "n_long_words", "n_capital_words", "square_word_chars")


def _repeated(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document in windows that occur twice or more in it."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            rolled ^= rolled >> np.uint64(29)
        rolled = (rolled ^ (doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = whole[np.argsort(rolled[whole])]
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = order[twice]
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=n_docs)


def count(texts: list[bytes]) -> np.ndarray:
    """One row per text, columns COUNTS, whole numbers."""
    n_docs = len(texts)
    out = np.zeros((n_docs, len(COUNTS)), np.int64)
    at = {c: i for i, c in enumerate(COUNTS)}
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    out[:, at["n_words"]] = n_words
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64)

    space = SPACE[buffer]
    points = ~FOLLOWS[buffer]
    out[:, at["n_chars"]] = per_doc(points) - 1
    out[:, at["word_chars"]] = per_doc(points & ~space)
    for name, table in CLASSES.items():
        out[:, at["n_symbols" if name == "symbols" else name]] = per_doc(table[buffer])
    out[:, at["newlines"]] -= 1
    # words in the buffer, in order
    before = np.concatenate([[True], space[:-1]])
    word_at = np.flatnonzero(before & ~space)
    word_end = np.flatnonzero(~before & space)
    doc = np.repeat(np.arange(n_docs), n_words)
    point_sum = np.concatenate([np.zeros(1, np.int32), np.cumsum(points, dtype=np.int32)])
    length = (point_sum[word_end] - point_sum[word_at]).astype(np.int64)
    first = buffer[word_at]
    for name, value in (("n_short_words", length <= 3), ("n_long_words", length > 12), ("n_capital_words", CLASSES["upper"][first]), ("square_word_chars", length * length)):
        out[:, at[name]] = np.bincount(doc, value, n_docs).astype(np.int64)
    hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(n_words.sum())).view(np.uint64)
    doubled = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, at["n_doubled_words"]] = np.bincount(doc[1:][doubled], minlength=n_docs)
    out[:, at["n_repeat_words"]] = _repeated(hashes, doc, n_docs)
    for i, (text, ws) in enumerate(zip(texts, words, strict=True)):
        out[i, at["n_word_forms"]] = len(set(ws))
        lines = [line for line in text.split(b"\n") if line.strip()]
        out[i, at["n_lines"]] = len(lines)
        out[i, at["n_dup_lines"]] = len(lines) - len(set(lines))
    return out


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the columns COUNTS of every row; a text without words has zeros."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most=SLICE):
            rows = count(common.encoded(batch))
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *COUNTS])

    return common.texts(docs).mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def counted(text: Column) -> Column:
    """The columns COUNTS of a column of texts without nulls, as a struct."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            batch = pa.record_batch([array], names=["text"])
            rows = np.concatenate([count(common.encoded(part)) for part in common.slices(iter([batch]), most=SLICE)]) if len(array) else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(COUNTS))

    return work(text)


#: Share features: the count and what it is a share of.
SHARES = {
    "symbol_share": ("n_symbols", "n_chars"), "upper_share": ("upper", "n_chars"), "digit_share": ("digits", "n_chars"), "exclaim_share": ("exclaims", "n_chars"),
    "stop_share": ("stops", "n_chars"), "other_share": ("others", "n_chars"), "wide_share": ("wide", "n_chars"), "word_char_share": ("word_chars", "n_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "doubled_share": ("n_doubled_words", "n_words"), "form_share": ("n_word_forms", "n_words"),
    "short_share": ("n_short_words", "n_words"), "long_share": ("n_long_words", "n_words"), "capital_share": ("n_capital_words", "n_words"),
    "mean_word": ("word_chars", "n_words"), "square_word": ("square_word_chars", "n_words"), "line_words": ("n_words", "n_lines"),
}
FEATURES = ("log_words", "log_chars", *SHARES)
#: How many more characters, words or lines of usual text are added before shares are taken, so that a short text is not judged by a few of them.
PSEUDO = {"n_chars": 200, "n_words": 40, "n_lines": 2}
#: These are not shares of one: their logarithm is taken, not the square root.
MEANS = ("mean_word", "square_word", "line_words")


def usual(totals: np.ndarray) -> np.ndarray:
    """The share of each feature in usual text, from the column sums of COUNTS over many documents."""
    total = dict(zip(COUNTS, map(float, totals), strict=True))
    return np.array([total[part] / max(total[whole], 1.0) for part, whole in SHARES.values()])


def features(rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """FEATURES from rows of COUNTS and the :func:`usual` shares: logarithms of sizes and means, square roots of shares; finite for empty texts."""
    c = {name: rows[:, i].astype(float) for i, name in enumerate(COUNTS)}
    columns = [np.log1p(c["n_words"]), np.log1p(c["n_chars"])]
    for (name, (part, whole)), prior in zip(SHARES.items(), shares, strict=True):
        value = (c[part] + PSEUDO[whole] * prior) / (c[whole] + PSEUDO[whole])
        columns.append(np.log1p(value) if name in MEANS else np.sqrt(value))
    return np.column_stack(columns)


def labelled(rows: DataFrame, labels: DataFrame, label: str, folds: int) -> DataFrame:
    """The rows of ``rows`` (with doc_id) that ``labels`` marks 0 or 1 as ``y``, but for those whose crc32(doc_id) mod ``folds`` is 0.

    A label that is null, or not the same in all rows of its doc_id, is none.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y"))
    marks = marks.filter(F.col("label_id").isNotNull() & (common.id_crc(folds, "label_id") != 0))
    marks = marks.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1 and y in (0, 1)").drop("y1")
    return rows.join(marks, F.col("doc_id") == F.col("label_id")).drop("label_id")
