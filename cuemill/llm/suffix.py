"""Repeated passages across documents, by a depth-limited most-significant-digit radix sort of suffixes.

A repeated window of ``threshold`` bytes is a group of suffixes that are equal through ``threshold`` bytes. The sort
runs over the cluster in two passes over digits of falling significance, and a group goes deeper only while suffixes
of two or more documents are in it.

*First digit.* Each window is filed under the gram inside it with the smallest hash. The choice depends on the
window's bytes alone, so equal windows have the same gram at the same place, and neighbouring windows mostly share
theirs: about one suffix in fourteen carries all windows. Chunks of documents send the grams they hold, once each,
to buckets; a bucket answers which grams have two documents.

*Deeper digits.* Chunks send the surviving suffixes with the bytes that their windows can reach on either side. In a
bucket the suffixes are radix sorted eight bytes a pass, rightwards and leftwards from the gram, and only groups with
two members go into the next pass. Lengths of common prefixes between neighbours then give, for each placing of a
window around the gram, the groups equal through the full threshold: exactly the repeated windows. In each, windows
of documents other than the smallest identifier are repeats.

Equal suffixes of one chunk travel once, for their smallest identifier, so a passage that a third of all documents
share costs one row per chunk. The number of buckets follows the text, so a bucket stays as large as it is.

A gram that occurs more often than ``CROWDED``, such as a run of blanks between differing neighbours, would bring all its
contexts to one bucket. Its suffixes are keyed by the whole window instead, one digit of the full depth for each placing:
a chunk settles what repeats inside it, sends each distinct window once, and Spark aggregates the smallest identifier.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import BYTE_CODES, join_small, mix, pin, scratch, shuffle_partitions, small_batches, utf8

THRESHOLD = 50
#: Text bytes of one chunk, unless a single document is longer, and of one bucket.
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 4096
BUCKET_BYTES = 1 << 23
#: Occurrences of a gram beyond which its suffixes are keyed by their whole windows.
CROWDED = 1 << 16
NULL_ID = np.iinfo(np.int64).max
_STEP = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
CHUNK_SCHEMA = "chunk long, n_bytes long, ids array<long>, sizes array<long>, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed value, led by the length of the first."""
    raw = np.array([len(arrays[0])], "<u4").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(value: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Depth:
    """The sizes that follow from the threshold: gram length, and how far a window reaches beside the gram."""

    def __init__(self, threshold: int):
        if threshold < 2:
            raise ValueError("the threshold is at least two bytes")
        self.threshold = threshold
        self.gram = max(1, threshold // 2 - 1)
        self.reach = threshold - self.gram
        self.placings = self.reach + 1
        if self.placings > 64:
            raise ValueError("the threshold is at most 126 bytes")
        self.span = self.gram + 2 * self.reach


def gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` codes, built from runs of 1, 2, 4, ... codes."""
    power, size, done, have = codes, 1, None, 0
    while length:
        if length & 1:
            if done is None:
                done, have = power, size
            else:
                n = len(power) - have
                done = done[:n] * np.uint64(pow(_STEP, size, 2**64)) + power[have : have + n]
                have += size
        length >>= 1
        if length:
            power = power[:-size] * np.uint64(pow(_STEP, size, 2**64)) + power[size:] if len(power) > size else power[:0]
            size *= 2
    return mix(done)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    out = values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(values) - width + 1], out[width - size :][: len(values) - width + 1])


def anchors(buf: np.ndarray, ends: np.ndarray, depth: Depth) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that windows inside documents are filed under, ascending, and the grams' hashes."""
    t, block = depth.threshold, 1 << 20
    places, hashes = [], []
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    for at in range(0, max(0, len(buf) - t + 1), block):
        piece = buf[at : at + block + t - 1]
        valid = np.ones(len(piece) - t + 1, bool)
        near = (ends > at) & (starts < at + len(piece))
        for a, b in zip((starts[near] - at).tolist(), (ends[near] - at).tolist(), strict=True):
            valid[max(0, a, b - t + 1) : b] = False  # a window from here would leave its document
        h = gram_hashes(BYTE_CODES[piece], depth.gram)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_min(packed, depth.placings)[: len(valid)] & _PLACE)[valid].astype(np.int64)
        if len(least):
            least = least[np.concatenate(([True], least[1:] != least[:-1]))]
            places.append(least + at)
            hashes.append(h[least])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)  # a gram may end one block and begin the next
    return p, h[first]


def filed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram, and a name that no other gram of the bucket has but by a clash in 40 bits."""
    bucket = (h & _PLACE) % np.uint64(buckets)
    return bucket.astype(np.int64), (h >> np.uint64(24)) * np.uint64(1 << 24) + bucket


def chunked(docs: DataFrame, id_col: str, text_col: str, extra: list[str], chunk_bytes: int) -> DataFrame:
    """Documents in chunks of about a megabyte, written once so that a chunk stays as it is."""
    rest = F.struct(*extra) if extra else F.lit(None).cast("struct<none: int>")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    kind = source.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, others, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            values = [[int.from_bytes(os.urandom(8)) >> 1], [size], [ids], [[len(b) for b in bodies]], [body]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(values, types, strict=True)]
            all_rest = pa.concat_arrays(others)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(all_rest)], pa.int32()), all_rest))
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "n_bytes", "ids", "sizes", "body", "rest"])

        for b in batches:
            column = b.column("rest")
            for i, (doc, text) in enumerate(zip(b.column("id").to_pylist(), utf8(b.column("text").to_pylist()), strict=True)):
                ids.append(doc)
                bodies.append(text)
                others.append(column.slice(i, 1))
                size += len(text)
                if size >= chunk_bytes or len(ids) >= CHUNK_DOCS:
                    yield out()
                    ids, bodies, others, size = [], [], [], 0
        if ids:
            yield out()

    with small_batches(docs.sparkSession):
        return pin(source.mapInArrow(run, f"{CHUNK_SCHEMA}, rest array<{kind}>"))


class Chunk:
    """One chunk with its anchors, if they are asked for."""

    def __init__(self, row: dict, depth: Depth, anchored: bool = True):
        self.chunk, self.ids, self.sizes = row["chunk"], row["ids"], np.asarray(row["sizes"], np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.order = np.asarray([NULL_ID if i is None else i for i in self.ids], np.int64)
        if anchored:
            self.places, self.hashes = anchors(self.buf, self.ends, depth)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def first_digit(chunks: DataFrame, depth: Depth, buckets: int) -> DataFrame:
    """(chunk, blob, crowd) of the gram names in each chunk that two documents or more have somewhere, and whether they are crowded."""
    crowded = CROWDED

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            c = Chunk(row, depth)
            bucket, name = filed(c.hashes, buckets)
            doc = c.order[c.doc_of(c.places)]
            by_name = np.lexsort((doc, name))
            name, doc, bucket = name[by_name], doc[by_name], bucket[by_name]
            new = np.concatenate(([True], name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            shared = (np.maximum.reduceat(doc, heads) != doc[heads]) if len(heads) else np.zeros(0, bool)
            count = np.diff(np.append(heads, len(name))).astype("<u4")
            name, bucket = name[heads], bucket[heads]
            got = [(k, pack((name[i] >> np.uint64(24)).view(np.int64).astype("<u8").view("V8"), shared[i], count[i])) for k, i in by_bucket(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in got], pa.int64()), pa.array([c.chunk] * len(got), pa.int64()), pa.array([v for _, v in got], pa.binary())],
                names=["bucket", "chunk", "blob"],
            )

    def answer(table: pa.Table) -> pa.Table:
        bucket, chunks_, parts = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        got = [unpack(p, "<u8", bool, "<u4") for p in parts]
        name, shared, count = (np.concatenate([g[i] for g in got]) for i in range(3))
        at = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        order = np.argsort(name, kind="stable")
        name, shared, at = name[order], shared[order], at[order]
        heads = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(heads, len(name)))
        alive = np.repeat((size > 1) | np.logical_or.reduceat(shared, heads), size)
        crowd = np.repeat(np.add.reduceat(count[order].astype(np.int64), heads) > crowded, size)[alive]
        name, at = name[alive] * np.uint64(1 << 24) + np.uint64(bucket), at[alive]
        out = [(chunks_[k], pack(name[i], crowd[i]), bool(crowd[i].any())) for k, i in by_bucket(at)]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary()), "crowd": pa.array([x[2] for x in out], pa.bool_())})

    sent = chunks.select("chunk", "ids", "sizes", "body").mapInArrow(send, "bucket long, chunk long, blob binary")
    return pin(sent.groupBy("bucket").applyInArrow(answer, "chunk long, blob binary, crowd boolean"))


def contexts(c: Chunk, alive: np.ndarray, depth: Depth, buckets: int):
    """The surviving suffixes of a chunk and the distinct ones among them.

    Per suffix: place, number of its distinct form, whether it belongs to that form's smallest identifier. Per form:
    bucket, gram name, identifier, bytes to the left and right that its document has, and the bytes.
    """
    bucket, name = filed(c.hashes, buckets)
    keep = np.flatnonzero(np.isin(name, alive))
    place, name, bucket = c.places[keep], name[keep], bucket[keep]
    doc = c.doc_of(place)
    left = np.minimum(place - (c.ends[doc] - c.sizes[doc]), depth.reach).astype(np.uint8)
    right = np.minimum(c.ends[doc] - place - depth.gram, depth.reach).astype(np.uint8)
    padded = np.concatenate((np.zeros(depth.reach, np.uint8), c.buf, np.zeros(depth.reach, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, depth.span)
    form = np.empty((len(place), depth.span + 2), np.uint8)
    for at in range(0, len(place), 1 << 16):
        part = slice(at, at + (1 << 16))
        x = view[place[part]]
        column = np.arange(depth.span)
        outside = (column < depth.reach - left[part, None].astype(int)) | (column >= depth.reach + depth.gram + right[part, None].astype(int))
        form[part, :-2] = np.where(outside, 0, x)
    form[:, -2], form[:, -1] = left, right
    key = np.ascontiguousarray(form).view(f"V{depth.span + 2}").ravel()
    order = np.lexsort((c.order[doc], _words_hash(form))) if len(key) else np.zeros(0, np.int64)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = order[new]
    least = c.order[doc[heads]]
    return place, number, c.order[doc] == least[number] if len(heads) else np.zeros(0, bool), left, right, (bucket[heads], name[heads], least, left[heads], right[heads], form[heads, :-2])


def _words_hash(form: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit value per row of bytes; rows that are not equal may, very rarely, share it and are told apart later."""
    pad = -form.shape[1] % 8
    words = np.pad(form, ((0, 0), (0, pad))).view("<u8")
    h = np.full(len(form), seed, np.uint64)
    for i in range(words.shape[1]):
        h = mix(h * np.uint64(_STEP) + words[:, i])
    return h


def radix_order(group: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Row order by group, then by the digits, most significant first; rows alone in their group sink no further."""
    order = np.argsort(group, kind="stable")
    rank = np.cumsum(np.concatenate(([0], group[order][1:] != group[order][:-1]))) if len(order) else order
    for d in range(digits.shape[1]):
        same = np.concatenate((rank[1:] == rank[:-1], [False]))
        active = np.flatnonzero(same | np.concatenate(([False], same[:-1])))
        if not len(active):
            break
        digit = digits[order[active], d]
        sub = np.lexsort((digit, rank[active]))
        order[active] = order[active][sub]
        digit = digit[sub]
        cut = np.zeros(len(order), np.int64)
        cut[active[1:]] = (digit[1:] != digit[:-1]) & (rank[active][1:] == rank[active][:-1]) & (np.diff(active) == 1)
        rank = np.cumsum(cut + np.concatenate(([0], rank[1:] != rank[:-1])))
    return order


def common(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, in order, with the row before it; 0 across groups."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        length = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.where(group[order[1:]] == group[order[:-1]], length, -1)
        out[0] = -1
    return out


def _digits(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)


def repeated_placings(name: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, ctx: np.ndarray, depth: Depth) -> np.ndarray:
    """For each suffix a bit set: bit a says that its window with a bytes before the gram is in a smaller document."""
    n = len(name)
    mask = np.zeros(n, np.uint64)
    if n < 2:
        return mask
    _, group = np.unique(name, return_inverse=True)
    ahead, behind = ctx[:, depth.reach :], np.ascontiguousarray(ctx[:, : depth.reach][:, ::-1])
    by_right, by_left = radix_order(group, _digits(ahead)), radix_order(group, _digits(behind))
    lcp_right, lcp_left = common(ahead, group, by_right) - depth.gram, common(behind, group, by_left)
    most = []
    for order, lcp in ((by_right, lcp_right), (by_left, lcp_left)):
        best = np.empty(n, np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], -depth.threshold))
        most.append(best)
    for a in range(depth.placings):
        b = depth.reach - a
        able = np.flatnonzero((left >= a) & (right >= b) & (most[0] >= b) & (most[1] >= a))
        if len(able) < 2:
            continue
        rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
        rank_right[by_right] = np.cumsum(lcp_right < b)
        rank_left[by_left] = np.cumsum(lcp_left < a)
        both = rank_right[able] * (n + 1) + rank_left[able]
        order = np.argsort(both, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) != 0)))
        doc = ids[able][order]
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))
        mask[able[order]] |= (doc > least).astype(np.uint64) << np.uint64(a)
    return mask


def deeper_digits(chunks: DataFrame, alive: DataFrame, depth: Depth, buckets: int) -> DataFrame:
    """(chunk, answers blob) for the chunks with repeated windows: numbers of distinct suffixes and their placings."""
    joined = chunks.select("chunk", "ids", "sizes", "body").join(alive.drop("crowd"), "chunk")
    span = f"V{depth.span}"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            c = Chunk(row, depth)
            names, crowd = _names(row["alive"])
            *_, forms = contexts(c, names, depth, buckets)
            at = np.flatnonzero(~np.isin(forms[1], crowd)).astype("<i4")
            bucket, name, doc, left, right, ctx = (x[at] for x in forms)
            ctx = np.ascontiguousarray(ctx).view(span).ravel()
            out = [(k, pack(name[i], doc[i], at[i], left[i], right[i], ctx[i])) for k, i in by_bucket(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([c.chunk] * len(out), pa.int64()), pa.array([v for _, v in out], pa.binary())],
                names=["bucket", "chunk", "blob"],
            )

    def answer(table: pa.Table) -> pa.Table:
        chunks_ = table.column("chunk").to_pylist()
        got = [unpack(p, "<u8", "<i8", "<i4", "u1", "u1", span) for p in table.column("blob").to_pylist()]
        size = [len(g[0]) for g in got]
        name, doc, at, left, right, ctx = (np.concatenate(x) for x in zip(*got, strict=True))
        ctx = ctx.view(np.uint8).reshape(len(name), depth.span)
        mask = repeated_placings(name, doc, left, right, ctx, depth)
        stop = np.cumsum(size)
        out = []
        for k, (a, b) in enumerate(zip(stop - size, stop, strict=True)):
            some = np.flatnonzero(mask[a:b]) + a
            if len(some):
                out.append((chunks_[k], pack(at[some], mask[some])))
        return pa.table({"chunk": pa.array([k for k, _ in out], pa.int64()), "blob": pa.array([v for _, v in out], pa.binary())})

    sent = joined.mapInArrow(send, "bucket long, chunk long, blob binary")
    return pin(sent.groupBy("bucket").applyInArrow(answer, "chunk long, blob binary"))


def _names(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The surviving gram names of a chunk, and the crowded ones among them."""
    got = [unpack(x, "<u8", bool) for x in blobs]
    name, crowd = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    return name, name[crowd]


def _windows(forms: tuple, crowd: np.ndarray, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of crowded grams: distinct keys of 128 bits and the smallest identifier of each in the chunk; then for
    each window its form, its placing as a bit, and the number of its key, as one array of three rows; and which windows
    the chunk itself shows to be repeats."""
    _, name, doc, left, right, ctx = forms
    mine = np.flatnonzero(np.isin(name, crowd))
    form, bit, key = [], [], []
    for a in range(depth.placings):
        able = mine[(left[mine] >= a) & (right[mine] >= depth.reach - a)]
        window = np.ascontiguousarray(ctx[able, depth.reach - a : depth.reach - a + depth.threshold])
        form.append(able)
        bit.append(np.full(len(able), np.uint64(1) << np.uint64(a)))
        key.append(np.stack([_words_hash(window, 1), _words_hash(window, 2)], axis=1))
    form, bit, key = np.concatenate(form), np.concatenate(bit), np.ascontiguousarray(np.concatenate(key)).view("V16").ravel()
    order = np.lexsort((doc[form], *key.view(np.uint64).reshape(-1, 2).T))
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1]))
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    least = doc[form[order[new]]]
    return key[order[new]], least, np.stack([form, number]), bit, doc[form] > least[number] if len(form) else np.zeros(0, bool)


def crowded_windows(chunks: DataFrame, alive: DataFrame, depth: Depth, buckets: int) -> DataFrame:
    """(chunk, beaten array<binary>): the window keys of crowded grams that a smaller identifier has in another chunk."""
    joined = chunks.select("chunk", "ids", "sizes", "body").join(alive.where("crowd").select("chunk", "alive"), "chunk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            names, crowd = _names(row["alive"])
            c = Chunk(row, depth)
            *_, forms = contexts(c, names, depth, buckets)
            key, least, *_ = _windows(forms, crowd, depth)
            for at in range(0, len(key), 1 << 16):
                some = slice(at, at + (1 << 16))
                columns = [pa.array([c.chunk] * len(key[some]), pa.int64()), pa.array([x.tobytes() for x in key[some]], pa.binary()), pa.array(least[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "key", "doc"])

    rows = pin(joined.mapInArrow(send, "chunk long, key binary, doc long"))
    beaten = rows.join(rows.groupBy("key").agg(F.min("doc").alias("least")), "key").where("doc > least")
    return pin(beaten.groupBy("chunk").agg(F.collect_list("key").alias("beaten")))


def _covered(row: dict, depth: Depth, buckets: int) -> tuple[Chunk, np.ndarray]:
    """The chunk, and True for each of its bytes that a repeated window covers."""
    c = Chunk(row, depth, bool(row["alive"]))
    edge = np.zeros(len(c.buf) + depth.threshold + 1, np.int32)
    if row["alive"]:
        names, crowd = _names(row["alive"])
        place, number, least, left, right, forms = contexts(c, names, depth, buckets)
        mask = np.zeros(int(number.max()) + 1 if len(number) else 0, np.uint64)
        for x in row["answers"] or []:
            at, bits = unpack(x, "<i4", "<u8")
            mask[at] = bits
        if len(crowd):
            key, _, (form, of_key), bit, repeat = _windows(forms, crowd, depth)
            beaten = np.isin(key, np.frombuffer(b"".join(row["beaten"] or []), "V16"))
            hit = repeat | beaten[of_key]
            np.bitwise_or.at(mask, form[hit], bit[hit])
        for a in range(depth.placings):
            hit = np.where(least, mask[number] >> np.uint64(a) & np.uint64(1) > 0, (left >= a) & (right >= depth.reach - a))
            start = place[hit] - a
            np.add.at(edge, start, 1)
            np.add.at(edge, start + depth.threshold, -1)
    return c, np.cumsum(edge)[: len(c.buf)] > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """Remove from every text the bytes of windows that also start in a document with a smaller identifier.

    One row per document: (id, n_bytes, n_removed, spans array<struct<start, length>> of the maximal removed runs,
    kept binary), and with ``keep_columns`` a struct ``rest`` of the other columns; ``kept`` is then valid UTF-8, without
    the characters that a cut took some bytes of. Texts are UTF-8 bytes; windows never
    cross documents; overlaps count; windows are judged on the input. A null text counts as empty; a null identifier
    counts as larger than all others; documents with equal identifiers do not remove from each other. Texts shorter
    than the threshold stay whole. Identifiers of any type with an order will do; what is no whole number is put in order
    first. An empty table gives an empty table. Grams with over ``CROWDED`` occurrences are compared by 128-bit hashes of
    their windows, all others byte by byte.
    """
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    with scratch(docs.sparkSession) as kept:
        given = docs if whole else _numbered(docs, id_col)
        out = _without_repeats(given, id_col if whole else _NUMBER, text_col, Depth(threshold), keep_columns, kept, [] if whole else [id_col])
    own = F.col("id") if whole else F.col("rest")[id_col]
    return out.select(own.alias(id_col), "n_bytes", "n_removed", "spans", "kept", *(["rest"] if keep_columns else []))


_NUMBER = "__cuemill_number"


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the place of each identifier among the different ones, null for null: ranges and counts, no sorted task."""
    parts = shuffle_partitions(docs.sparkSession)
    ids = pin(docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct())
    row = F.col("_row")
    ranged = ids.repartitionByRange(parts, "_id").sortWithinPartitions("_id").withColumn("_row", F.monotonically_increasing_id())
    ranged = pin(ranged.select("_id", F.shiftright(row, 33).alias("_part"), row.bitwiseAND((1 << 33) - 1).alias("_in")))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = pin(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before")))  # a row a range
    places = join_small(ranged, counts, ["_part"], "inner").select(F.col("_id").alias("__cuemill_id"), (F.col("_in") + F.col("_before")).alias(_NUMBER))
    return docs.join(places, F.col(id_col) == F.col("__cuemill_id"), "left").drop("__cuemill_id")


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, depth: Depth, keep_columns: bool, path: str, carried: list[str]) -> DataFrame:
    """The rows of ``repeated_passages``, written to ``path``; ``rest`` has the ``carried`` columns in any case."""
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if keep_columns else carried
    chunks = chunked(docs, id_col, text_col, extra, CHUNK_BYTES)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = min(1 << 24, max(4 * shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES))
    with small_batches(docs.sparkSession, 8):
        alive = first_digit(chunks, depth, buckets).groupBy("chunk").agg(F.collect_list("blob").alias("alive"), F.max("crowd").alias("crowd"))
        beaten = crowded_windows(chunks, alive, depth, buckets)
        answers = deeper_digits(chunks, alive, depth, buckets).groupBy("chunk").agg(F.collect_list("blob").alias("answers"))
    rest = chunks.schema["rest"].dataType.elementType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                row = {k: one.column(k)[0].as_py() for k in ("chunk", "ids", "sizes", "body", "alive", "answers", "beaten")}
                c, gone = _covered(row, depth, buckets)
                spans, kept, removed = [], [], []
                for a, z in zip((c.ends - c.sizes).tolist(), c.ends.tolist(), strict=True):
                    edges = np.flatnonzero(np.diff(gone[a:z].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                    left = (c.buf[a:z][~gone[a:z]] if len(edges) else c.buf[a:z]).tobytes()
                    kept.append(left.decode("utf-8", "ignore").encode() if keep_columns else left)
                    removed.append(int((edges[1::2] - edges[::2]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(c.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()), one.column("rest").flatten()],
                    names=["id", "n_bytes", "n_removed", "spans", "kept", "rest"],
                )

    with small_batches(docs.sparkSession, 8):
        schema = f"id long, n_bytes long, n_removed long, spans array<struct<start: bigint, length: bigint>>, kept binary, rest {rest}"
        found = chunks.join(alive, "chunk", "left").join(answers, "chunk", "left").join(beaten, "chunk", "left")
        out = pin(found.select("chunk", "ids", "sizes", "body", "alive", "answers", "beaten", "rest").mapInArrow(apply, schema), path)
    return out


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; all rows stay, other columns as they were.

    A null text becomes the empty text.
    """
    found = repeated_passages(docs, id_col, text_col, threshold, keep_columns=True)
    kind = docs.schema[id_col].dataType
    own = {id_col: F.col(id_col).cast(kind), text_col: F.col("kept").cast("string")}
    return found.select(*((own[c] if c in own else F.col("rest")[c]).alias(c) for c in docs.columns))
