"""Language identification by compression.

Every learned language has a raw-content Zstandard dictionary made of passages of its documents. A text is folded to
lower-case letters, cut into pieces, and each piece is encoded once per language with that language's dictionary; the
language whose pieces take the fewest bytes in all is chosen. Pieces keep the dictionary in reach of the whole of a
long text. The margin to the runner-up is the score, and a narrow one rejects the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import join_small, pin, scratch, small_batches, utf8

#: Bounds of the learning sample: languages (the most frequent ones), different texts of each, characters of each text.
LANGUAGES = 512
SAMPLE_TEXTS = 128
PASSAGE_CHARS = 1024
#: Bytes of a dictionary and of the pieces that are encoded with it.
DICTIONARY_BYTES = 1 << 16
PIECE_BYTES = 2048
LEVEL = 6
#: A choice that saves less than this share of the runner-up's bytes is rejected.
NARROW = 0.02
UNKNOWN = "und"

_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")


def folded(text: str) -> bytes:
    """Lower-case letters and their marks, other stretches as one blank."""
    return utf8([_BETWEEN.sub(" ", text.lower())])[0]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def in_training(id_col: str = "doc_id") -> Column:
    """Rows whose language may be learnt from: crc32 of the identifier as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


@dataclass
class Model:
    """Dictionaries by language, the more frequent language first."""

    languages: list[str]
    dictionaries: list[bytes]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE_BYTES, dict_size=DICTIONARY_BYTES, **plain)
        made = []
        for content in self.dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings))
        return made


def encoded_sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the whole text takes with each dictionary."""
    pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], np.int64)


def decide(sizes: np.ndarray) -> tuple[int, float]:
    """(the language with the fewest bytes, share of the runner-up's bytes that it saves); ties go to the more frequent language."""
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return best, 1.0
    second = np.delete(sizes, best).min()
    return best, float(1 - sizes[best] / second) if second else 0.0


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n, rank, passage): of each of the most frequent languages the texts with the smallest hashes, a passage of each.

    Copies of a text count once. A share of each language's hashes that surely holds enough texts is cut out before they
    are ranked, so no language is sorted whole.
    """
    mine = docs.where(in_training(id_col) & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    mine = mine.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    keyed = pin(mine.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")))
    totals = keyed.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    totals = pin(totals.orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    low = F.pmod("h", F.lit(1 << 32)) * F.col("texts").cast("double") < F.lit(float(4 * SAMPLE_TEXTS << 32))
    few = keyed.select("lang", "h").join(F.broadcast(totals), "lang").where(low)  # at most LANGUAGES rows
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "h"))
    chosen = pin(few.select("lang", "h", "n", order.alias("rank")).where(F.col("rank") <= SAMPLE_TEXTS))
    text = F.col("text")
    rows = join_small(mine, chosen, ["lang", "h"], "inner")
    start = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length(text) - PASSAGE_CHARS, F.lit(0)) + 1).cast("int")
    return pin(rows.groupBy("lang", "n", "rank").agg(F.min(F.substring(text, start, F.lit(PASSAGE_CHARS))).alias("passage")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Dictionaries of the languages of the training rows, from the bounded ``sample``."""
    content: dict[str, list[bytes]] = {}
    count: dict[str, int] = {}
    for row in sample(docs, id_col, text_col, lang_col).orderBy("lang", F.desc("rank")).toLocalIterator():
        content.setdefault(row.lang, []).append(folded(row.passage))
        count[row.lang] = row.n
    languages = sorted(content, key=lambda k: (-count[k], k))
    return Model(languages, [b" ".join(content[k])[-DICTIONARY_BYTES:] for k in languages])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", narrow: float = NARROW) -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score, rejected).

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter, or nothing was learnt; its
    score is then 0. The score is the share of bytes that the chosen dictionary saves against the runner-up, 1 if only
    one language was learnt. ``rejected`` says that there is no choice or that the margin is below ``narrow``. Equal
    texts get equal answers; of tied languages the one with more training rows is chosen, then the smaller name. Only
    the text is looked at, and all of it. Rows without identifier are neither held out nor learnt from. An
    empty table gives an empty table; other columns are neither read nor returned.
    """
    with scratch(docs.sparkSession) as kept:
        return _identified(docs, train(docs, id_col, text_col, lang_col), id_col, text_col, narrow, kept)


def _identified(docs: DataFrame, learnt: Model, id_col: str, text_col: str, narrow: float, path: str) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learnt)
    held = F.coalesce(~in_training(id_col), F.lit(False)).alias("held_out")
    text = F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text")
    source = docs.select(F.struct(F.col(id_col)).alias("row"), held, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.value.compressors()
        for b in batches:
            found: list[str] = []
            score = np.zeros(b.num_rows)
            for i, value in enumerate(b.column("text")):
                text = value.as_py()
                if text is None or not compressors:
                    found.append(UNKNOWN)
                    continue
                best, score[i] = decide(encoded_sizes(folded(text), compressors))
                found.append(model.value.languages[best])
            rejected = np.array([f == UNKNOWN for f in found], bool) | (score < narrow)
            arrays = [b.column("row"), b.column("held_out"), pa.array(found, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "held_out", "lang_pred", "score", "rejected"])

    kind = source.schema["row"].dataType.simpleString()
    with small_batches(spark, 256):
        found = pin(source.mapInArrow(run, f"row {kind}, held_out boolean, lang_pred string, score double, rejected boolean"), path)
    return found.select("row.*", "held_out", "lang_pred", "score", "rejected")
