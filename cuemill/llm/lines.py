"""Fuzzy line deduplication by MinHash.

1. Equal lines (lower-cased, white space collapsed) become one row before anything else, so a line that a third of all
   documents hold is one line.
2. Signatures: all five-character shingles of a line, the very ones that are verified, give 80 minima, and a sketch:
   one parity bit for each of 512 hash values. Sets of up to 160 shingles take minima of independent hashes. Sets of
   more than 128 take the rotations of one hash, h - p for 80 points p, whose minima are found by binary search; a pair at
   0.8 has both sizes on one side, so it has one kind of minima in common.
3. High-recall banding: sixteen bands of five minima; a pair at 0.8 shares one in 99.8 % of the cases. The lines of a
   band are first held against its smallest member, of a larger band against three members more: stars, not all pairs.
4. The sketch rules pairs out before their texts are fetched. Two sets at 0.8 differ in at most a ninth of their summed
   sizes, and each parity that differs needs an element that only one of the two has, so no near pair is lost.
5. Exact verification: Jaccard similarity of the two lines' sets of five-character shingles, 0.8 or more.
6. Distributed union-find by star contraction. In the bands that still hold several components, the lines outside the
   largest one meet all lines of other components, in blocks, again behind sizes and sketches; then components are
   joined once more. A group of near copies is one component by then and makes no pairs. A pair that shares several
   bands is made in the least of them only, and one that was verified before is not verified again.
7. Of each component the first line by document and place stays.

Signing and verifying run in numpy and Python over Arrow batches; the README says why not as DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import join_small, mix, pin, scratch, small_batches
from cuemill.llm.components import connected_components

BANDS, ROWS = 16, 5
SIMILARITY = 0.8
SHINGLE = 5
#: Parity bits of a sketch, held in columns of 64.
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Sets of up to so many shingles have minima of independent hashes; larger ones than four fifths of it, rotations.
SMALL = 160
#: Members of a band from which on it has four pivots.
LARGE_BAND = 8
#: Rows of a band that meet in one block.
BLOCK_ROWS = 4096
#: Characters that one numpy pass takes at once; a longer line is a pass of its own.
PASS_CHARS = 1 << 15
_MINIMA = BANDS * ROWS
#: Minimum i is over (shingle hash ^ mask i) * factor i, or over shingle hash - point i.
MASKS = mix(np.arange(1, _MINIMA + 1, dtype=np.uint64))
FACTORS = mix(MASKS) | np.uint64(1)
POINTS = np.arange(_MINIMA, dtype=np.uint64) * np.uint64(2**48 // _MINIMA) + np.uint64(12345)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_SQUARED = np.uint64(0x9E3779B97F4A7C15**2 % 2**64)
_LOW = np.uint64((1 << 48) - 1)
SIGNED = "lid long, n int, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    plain = ~line.contains("  ")
    for mark in "\t\x0b\f\r":
        plain = plain & ~line.contains(mark)
    return F.lower(F.trim(F.when(plain, line).otherwise(F.regexp_replace(line, r"\s+", " "))))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): every line; a null text is one blank line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_no", "line"))


def _key(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def shingle_set(line: str) -> set[str]:
    """Distinct shingles of five characters; a shorter line is one shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, 64-bit hash) of every shingle of every line."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\U0010ffff") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    two = code[:-1] * _STEP + code[1:]
    four = two[:-2] * _STEP_SQUARED + two[2:]
    five = mix(four[:-1] * _STEP + code[4:])
    inside = np.ones(len(code), bool)
    stop = np.cumsum(size)
    for k in range(1, SHINGLE):
        inside[stop - k] = False
    return np.repeat(np.arange(len(padded)), size - SHINGLE + 1), five[inside[: len(five)]]


def _minima(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of independent hashes for the sets that begin at ``first``."""
    value = ((key & _LOW) >> np.uint64(16)).astype(np.uint32)
    masks, factors = MASKS.astype(np.uint32), FACTORS.astype(np.uint32)
    return np.stack([np.minimum.reduceat((value ^ m) * f, first) for m, f in zip(masks, factors, strict=True)], axis=1).astype(np.uint64)


def _rotations(key: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first hash at or after each point, or else the smallest: the minimum over h - point, for the sorted sets of ``row``."""
    asked = (row.astype(np.uint64)[:, None] << np.uint64(48)) | POINTS
    at = np.searchsorted(key, asked.ravel()).reshape(asked.shape)
    return key[np.where(at == stop[:, None], first[:, None], at)] & _LOW


def _banded(minima: np.ndarray, kind: int) -> np.ndarray:
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(kind * BANDS), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        band = mix((band + np.uint64(1)) * _STEP ^ minima[:, r::ROWS])
    return band.view(np.int64)


def signed(lid: pa.Array, row: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Signatures of the sets of hashes ``h``, each of the row (a place in ``lid``) beside it. A set is of 48-bit hashes."""
    rows = len(lid)
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
    row = (key >> np.uint64(48)).astype(np.int64)
    n = np.bincount(row, minlength=rows)
    stop = np.cumsum(n)
    small, large = np.flatnonzero((n > 0) & (n <= SMALL)), np.flatnonzero(n * 5 > SMALL * 4)
    owner, made = [small, large], [np.zeros((0, BANDS), np.int64)] * 2
    if len(small):
        mine = (n[row] <= SMALL) if len(small) < np.count_nonzero(n) else slice(None)
        made[0] = _banded(_minima(key[mine], np.concatenate(([0], np.cumsum(n[small])[:-1]))), 0)
    if len(large):
        made[1] = _banded(_rotations(key, large, stop[large] - n[large], stop[large]), 1)
    order = np.argsort(np.concatenate(owner), kind="stable")
    count = np.bincount(np.concatenate(owner), minlength=rows) * BANDS
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(np.concatenate(made)[order].ravel()))
    odd = np.bincount(row * SKETCH_BITS + (key & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=rows * SKETCH_BITS).astype(np.uint8) & 1
    sketch = np.packbits(odd.reshape(rows, SKETCH_BITS), axis=1, bitorder="little").view("<i8")
    columns = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]
    return pa.RecordBatch.from_arrays([lid, pa.array(n.astype(np.int32)), listed, *columns], names=["lid", "n", "bands", *SKETCH])


def sign_lines(distinct: DataFrame) -> DataFrame:
    """(lid, n shingles, bands array<long>, sketch) of distinct lines (lid, norm), written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, lid, at, held = b.column("norm").to_pylist(), b.column("lid"), 0, 0
            for stop, line in enumerate(lines, 1):
                held += len(line)
                if held >= PASS_CHARS or stop == len(lines):
                    yield signed(lid.slice(at, stop - at), *line_hashes(lines[at:stop]))
                    at, held = stop, 0

    with small_batches(distinct.sparkSession, 4096):
        return pin(distinct.select("lid", "norm").mapInArrow(run, SIGNED))


def _sizes_allow(a: str, b: str) -> Column:
    """Whether sets of so many shingles can reach a Jaccard similarity of 0.8."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _sketches_allow(a: str, b: str) -> Column:
    """Whether two sets, with sketches in columns that begin with ``a`` and ``b``, can; each odd bit is a difference."""
    differing = sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}_{SKETCH[0]}").bitwiseXOR(F.col(f"{b}_{SKETCH[0]}"))))
    return differing * 9 <= F.col(f"{a}_n") + F.col(f"{b}_n")


def _side(rows: DataFrame, k: str, *columns: str) -> DataFrame:
    return rows.select(F.col("lid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns))


def possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those that sizes and sketches do not rule out."""
    both = pairs.join(_side(signatures, "b", "n", *SKETCH), "b").join(_side(signatures, "a", "n", *SKETCH), "a")
    return both.where(_sizes_allow("a_n", "b_n") & _sketches_allow("a", "b")).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, set_of: Callable) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts (lid, norm) have sets with a Jaccard similarity of 0.8 or more.

    The texts that pairs name are put aside first; the side that many pairs share, ``b``, is joined while rows are short.
    """
    pairs = pin(pairs)
    named = pin(pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct())
    texts = pin(join_small(texts, named, ["lid"], "left_semi"))
    both = pairs.join(_side(texts, "b", "norm"), "b").join(_side(texts, "a", "norm"), "a").select("a", "b", "a_norm", "b_norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, one = None, set()
        for batch in batches:
            near = []
            for x, y in zip(batch.column("a_norm").to_pylist(), batch.column("b_norm").to_pylist(), strict=True):
                if x != known:  # pairs come by their first line
                    known, one = x, set_of(x)
                other = set_of(y)
                near.append(len(one & other) * 9 >= (len(one) + len(other)) * 4)  # both / (a + b - both) >= 4 / 5
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    with small_batches(pairs.sparkSession, 256):
        return pin(both.mapInArrow(run, "a long, b long"))


def near_components(signatures: DataFrame, texts: DataFrame, set_of: Callable, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the ids that have a near copy. ``signatures`` is of ``signed``, ``texts`` (lid, norm); ids are unique.

    ``known`` are verified links (a, b); what they join is not compared again.
    """
    bands = signatures.select("lid", F.explode("bands").alias("band"))
    # both sides of the join name the same rows, so that the bands of all lines are shuffled once
    bands = bands.repartition("band")
    member = pin(bands.join(bands.groupBy("band").agg(F.count("lid").alias("members")).where("members > 1"), "band"))
    least = [F.min(F.struct(F.xxhash64("lid", F.lit(i)), "lid"))["lid"] for i in range(3)]
    pivots = F.when(F.first("members") >= LARGE_BAND, F.array(F.min("lid"), *least)).otherwise(F.array(F.min("lid")))
    tried = member.join(member.groupBy("band").agg(pivots.alias("pivots")), "band").select(F.col("lid").alias("a"), F.explode("pivots").alias("b"))
    tried = tried.where("a <> b").distinct()
    if known is not None:
        joined = connected_components(known)
        tried = tried.join(joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        tried = tried.join(joined.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        tried = tried.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    tried = pin(possible(tried, signatures))
    links = verified(tried, texts, set_of)
    found = connected_components(links if known is None else known.unionByName(links))
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    new = possible_between(member, found, signatures).select(*ends).join(tried.select(*ends), ["a", "b"], "left_anti")
    more = verified(new, texts, set_of)
    if more.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def possible_between(member: DataFrame, found: DataFrame, signatures: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of lines that share a band, lie in different components and pass sizes and sketches.

    Each comes from the least band that its lines share, so a pair is made once, not once a band.
    """
    placed = member.select("band", "lid").join(found.withColumnRenamed("node", "lid"), "lid", "left").select("band", "lid", F.coalesce("component", "lid").alias("component"))
    placed = pin(placed)
    sizes = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all")).where("main.size < all")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS)
    bands = bands.select("band", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.size")).alias("here"), blocks(F.col("all")).alias("there"))
    held = pin(placed.join(bands, "band"))
    mine = held.groupBy("lid").agg(F.collect_list("band").alias("bands"))  # two lines of different components share no other bands
    rows = pin(held.join(mine, "lid").join(signatures.drop("bands"), "lid"))

    def dealt(k: str, own: str, other: str) -> DataFrame:
        """Rows with the number of their block, once for each block of the other side."""
        salt = F.pmod(F.xxhash64("lid"), own)
        columns = ["n", *SKETCH, "component", "bands"]
        place = rows if k == "b" else rows.where("component <> main")
        return place.select(
            "band", salt.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), (F.col("component") == F.col("main")).alias(f"{k}_main"),
            F.col("lid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns),
        )

    both = dealt("a", "here", "there").join(dealt("b", "there", "here"), ["band", "here", "there"])
    apart = (F.col("a_component") != F.col("b_component")) & (F.col("b_main") | (F.col("a") < F.col("b")))
    here = F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("band")
    return both.where(apart & _sizes_allow("a_n", "b_n") & _sketches_allow("a", "b") & here).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: (id, line_no, class_doc_id, class_line_no, class_size, kept).

    The class of a line is its component of equal and near lines, named by the first line in it by identifier (null
    last) and place, which is the one that stays. Blank lines stay and have no class. A null text is one blank line. Rows
    that repeat an identifier share names of lines; equal lines among them keep one name. An empty table gives an
    empty table; other columns are not read.
    """
    lines = split_lines(docs, id_col, text_col)
    spot = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("line_no").alias("line_no"))
    norm = normal_line(F.col("line"))
    full = lines.where(F.col("line").rlike(r"\S"))
    keyed = full.select(_key(norm).alias("key"), norm.alias("norm"), spot.alias("spot"))
    grouped = keyed.groupBy("key").agg(F.first("norm").alias("norm"), F.min("spot").alias("spot"), F.count(F.lit(1)).alias("n"))
    with scratch(docs.sparkSession) as kept:
        distinct = pin(grouped.withColumn("lid", F.monotonically_increasing_id()))
        texts = distinct.select("lid", "norm")
        found = near_components(sign_lines(texts), texts, shingle_set)
        named = distinct.select("lid", "key", "spot", "n").join(found.withColumnRenamed("node", "lid"), "lid", "left")
        named = pin(named.select("key", "spot", "n", F.coalesce("component", "lid").alias("component")))
        first = named.groupBy("component").agg(F.min("spot").alias("class"), F.sum("n").alias("class_size"))
        classes = pin(named.select("key", "component").join(first, "component").select("key", "class", "class_size"), kept)
    blank = ~F.col("line").rlike(r"\S")
    # blank lines find no class; a key from their place keeps them from meeting in one task
    key = F.when(blank, F.unhex(F.sha1(F.concat_ws(" ", F.col("id").cast("string"), "line_no").cast("binary")))).otherwise(_key(norm))
    out = lines.select("id", "line_no", blank.alias("blank"), key.alias("key")).join(classes, "key", "left")
    mine = F.col("blank") | (F.col("id").eqNullSafe(F.col("class.id")) & (F.col("line_no") == F.col("class.line_no")))
    return out.select(
        F.col("id").alias(id_col), "line_no", F.col("class.id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), mine.alias("kept"),
    )


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts keep the lines that stay, joined by line feeds; other columns as they were, whatever their names.

    Identifiers must not repeat. A null text stays null; a text all of whose lines go becomes empty.
    """
    lines = split_lines(docs, id_col, text_col).select("id", "line_no", "line")
    kept = line_classes(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), "line_no")
    both = lines.join(kept, lines["id"].eqNullSafe(kept["id"]) & (lines["line_no"] == kept["line_no"]), "left_semi")
    parts = both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    texts = parts.select(F.col("id").alias("of"), F.array_join("parts.line", "\n").alias("new"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("mine"))
    out = rows.join(texts, F.col("mine").eqNullSafe(F.col("of")), "left")
    new = F.when(F.col("row")[text_col].isNotNull(), F.coalesce("new", F.lit("")))
    return out.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
