"""Helpers shared by the training-data operators: shared storage, size-checked joins, byte-level hashing."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.settle import session_conf

#: Rows of a key table that may be broadcast; above it the join shuffles both sides.
BROADCAST_ROWS = 100_000

#: Bytes of text that one numpy pass takes at once.
BLOCK_BYTES = 1 << 20


#: The open ``scratch`` folder of the thread that asks: queries in other threads have their own.
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors both see, inside the open ``scratch`` folder if there is one.

    The place comes from ``spark.checkpoint.dir``. A local session without it, as in tests, gets a temporary folder; on a
    cluster, where such a folder is not shared, the setting must be there.
    """
    if _scratch.get():
        return f"{_scratch.get()}/{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cuemill-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is pinned in the block is deleted at its end; gives a folder beside it for the result, which stays."""
    kept, folder = shared_dir(spark), shared_dir(spark)
    outer = _scratch.set(folder)
    try:
        yield kept
    finally:
        _scratch.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back, which cuts its lineage.

    The shuffle files behind it are then no longer needed, and go when the write has ended.
    """
    path = path or shared_dir(df.sparkSession)
    with session_conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512):
    """Arrow batches of few documents, so that a Python worker holds little text at once; for what is written inside the block."""
    return session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def join_small(left: DataFrame, keys: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with a written key table: broadcast up to ``BROADCAST_ROWS`` rows, else a shuffled join."""
    rows = keys.count() if rows is None else rows
    return left.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, how)


def row_key(df: DataFrame, column: str):
    """A non-null text form of an identifier column, for joins on it."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00null"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- bytes and words -------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
IS_WORD = np.zeros(256, dtype=np.int8)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: The same with 2 for all other bytes but ASCII white space.
KIND = np.where(IS_WORD == 1, 1, 2).astype(np.int8)
KIND[[*range(9, 14), 32]] = 0
_RNG = np.random.Generator(np.random.PCG64(20240917))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, step in enumerate((_STEP, _STEP_INVERSE)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def utf8(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts as byte blocks: (bytes, start of each piece, document of each piece).

    Pieces end with a line feed. A text over ``limit`` is cut after its last non-word byte, or within a word only
    where one word fills the whole block.
    """
    parts: list[bytes] = []
    docs: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            piece = text[at : at + limit] if len(text) - at > limit else text[at:] if at else text
            if len(text) - at > limit:
                stops = np.flatnonzero(IS_WORD[np.frombuffer(piece, np.uint8)] == 0)
                piece = piece[: stops[-1] + 1] if len(stops) else piece
            parts.append(piece)
            docs.append(i)
            size += len(piece) + 1
            at += len(piece)
            if size >= limit:
                yield _joined(parts, docs)
                parts, docs, size = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield _joined(parts, docs)


def _joined(parts: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts, np.asarray(docs, np.int64)


def words_of(buf: np.ndarray, starts: np.ndarray, docs: np.ndarray, prefixes: tuple[int, ...] = (), marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a block, in order, and the document of each; with ``marks`` runs of marks too.

    With ``prefixes`` one row of hashes for each word: the word, then its first bytes by those counts (the word again
    where it is shorter).
    """
    inside = (KIND if marks else IS_WORD)[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    if marks:  # a run ends where the next one begins
        kind = inside[edges[:-1]]
        first, last = edges[:-1][kind > 0], edges[1:][kind > 0]
    else:
        first, last = edges[::2], edges[1::2]
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[LOWER[buf]] * up[:-1], out=total[1:])

    def hashed(end: np.ndarray, kind: int) -> np.ndarray:
        return mix((total[end] - total[first]) * down[first] + np.uint64(kind << 32) + (end - first).astype(np.uint64))

    doc = docs[np.searchsorted(starts, first, "right") - 1]
    if not prefixes:
        return hashed(last, 0), doc
    return np.stack([hashed(last, 0), *(hashed(np.minimum(first + n, last), 1) for n in prefixes)], axis=1), doc


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
