"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised in Arrow batches and cut into pieces of at most the capacity. What a bin is filled with
depends on lengths alone, so the packing is planned over the histogram of piece lengths: at most ``capacity`` numbers,
whatever the size of the corpus. Per bin the longest length left is taken, and a bitset subset-sum over the lengths
left finds the fullest combination that fits beside it (Gupta and Ho's minimum bin slack); that combination is then
removed, as many times at once as the counts allow.

Pieces find their places with joins: their rank among pieces of one length (counted per salt, then shifted, so that a
common length is no hot key) falls into a row of the plan, which has at most a few rows per length and pattern.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import pin, shuffle_partitions, small_batches

CAPACITY = 2048
#: Words whose ids a Python worker remembers; further words are encoded each time they occur.
CACHE_WORDS = 300_000
#: Characters whose words can be cut here as the vocabulary's own rules cut them: printable Latin-1 and white space.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*\Z")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's pre-tokenisation rule over lower-cased Latin-1 text.
_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_NUMBERS}]+")
#: The printable characters that stand for bytes in a byte-level vocabulary: a byte that prints as itself, else the next
#: free character from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b if b in _SELF else 256 + sum(x not in _SELF for x in range(b))) for b in range(256)}


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of twice the length needed."""
    return array if n <= len(array) else np.concatenate((array, np.zeros(2 * n - len(array), array.dtype)))


class WordTokenizer:
    """Ids of whole texts. The vocabulary encodes each pre-token by itself, so a pre-token is encoded once and reused.

    A text with any other character than printable Latin-1, or with the brackets of special tokens, goes to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        #: Ids of all known words one after the other; of each word its first place there and its number of ids.
        self.ids, self.first, self.size = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        split = self.library.model.tokenize
        found = [[x.id for x in split(w.encode().decode("latin-1").translate(_BYTES))] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.known), int(size.sum())
        self.first, self.size = _room(self.first, n + len(words)), _room(self.size, n + len(words))
        self.ids = _room(self.ids, self.used + total)
        self.first[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.ids[self.used : self.used + total] = np.fromiter((x for f in found for x in f), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _unlearn(self, words: list[str]) -> None:
        """Take back what was learnt last."""
        for w in words:
            del self.known[w]
        self.used = int(self.first[len(self.known)])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; words are looked up for some texts at a time."""
        for a in range(0, len(texts), 64):
            part = texts[a : a + 64]
            words = [_WORD.findall(t.lower()) if _PLAIN.match(t) and "<|" not in t else None for t in part]
            at = [None if w is None else list(map(self.known.get, w)) for w in words]
            new = list(dict.fromkeys(x for w, k in zip(words, at, strict=True) if k and None in k for x, y in zip(w, k, strict=True) if y is None))
            if new:
                self._learn(new)
                at = [list(map(self.known.get, w)) if k and None in k else k for w, k in zip(words, at, strict=True)]
            for text, k in zip(part, at, strict=True):
                if k is None:
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                    continue
                k = np.array(k, np.int64)
                size, first = self.size[k], self.first[k]
                stop = np.cumsum(size)
                yield self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)]
            if new and len(self.known) > CACHE_WORDS:
                self._unlearn(new)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, with what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids, then id 0, cut where longer than the capacity.

    Written to shared storage. ``ids`` is a little-endian unsigned 32-bit array. A null text counts as empty and makes
    one piece of length 1.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        for b in batches:
            rows, blobs = [], []
            for i, ids in enumerate(encode([t or "" for t in b.column("_text").to_pylist()])):
                raw = np.append(ids, 0).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    blobs.append(part if keep_ids else None)
            take, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            arrays = [b.column("_id").take(pa.array(take)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    with small_batches(docs.sparkSession, 256):
        return pin(source.mapInArrow(lambda it: run(x for x in it if x.num_rows), schema))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) with the largest sum up to ``room``: subset sums as bits."""
    inside, bits, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k in counts if k <= room and counts[k]), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            take = min(batch, left)
            stages.append((length, take, bits))
            bits |= bits << (length * take) & inside
            left -= take
            batch *= 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows (length, low, high, per_bin, first_bin, offset) for ranks low <= r < high of a length, and the bins used."""
    left = {k: v for k, v in histogram.items() if v}
    used, rows, bins = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, bins, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows, bins


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` from 0 among pieces of one length; a common length is ranked in many salted parts."""
    salt = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(max(8, shuffle_partitions(pieces.sparkSession))))
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    local = salted.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(shifts, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("shift")).drop("salt", "local", "shift")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. The histogram and the plan have at most ``capacity`` lengths."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(rows, "p_length long, low long, high long, per_bin long, first_bin long, p_offset long")
    at = F.col("rank") - F.col("low")
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked(pieces).join(F.broadcast(plan), fits)
    return placed.select(
        *pieces.columns, (F.col("first_bin") + F.expr("(rank - low) div per_bin")).alias("sequence_id"),
        (F.col("p_offset") + at % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Every token of every document is placed once; a sequence is filled without gaps from offset 0 up to at most the
    capacity. Null and empty texts are pieces of length 1. Rows that repeat an identifier are packed each. A null
    identifier stays null. Other columns are not read. An empty table gives an empty table.
    """
    pieces = cut_pieces(docs, vocabulary, id_col, text_col, capacity, keep_ids)
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of the packed rows that kept their ids: pieces concatenated by offset.

    A sequence has at most as many pieces as its capacity, so a group stays small.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate(F.col("parts.ids"), F.expr("X''"), lambda a, b: F.concat(a, b)).alias("ids"))
