"""SentencePiece encoding by a streaming search over piece boundaries, and decoding.

The model at hand is of the BPE kind, whose ids the plain best-score path does not give: a piece sequence is the
encoding exactly if every two neighbours, joined, are encoded as just those two. The search therefore goes over the
same lattice of pieces and positions as Viterbi's, and a piece may extend a path only if it is compatible with the
path's last piece; every position then has one surviving path. Only positions within the longest piece of the end can
still be extended, so a window of that many back pointers is kept, and ids are committed whenever the paths of all
positions in it run through one boundary.

No piece reaches over a space mark that follows another character, so there all paths meet by themselves; the stretch
between two such places is encoded once per Python worker and then looked up.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import pin, small_batches

MARK = "▁"
#: Stretches and pairs that a worker remembers; more are worked out each time.
CACHE_STRETCHES, CACHE_PAIRS = 500_000, 500_000
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_OTHER = -1
_NO_PIECE = float("-inf")


class Pieces:
    """The vocabulary of a BPE model file, and the search over it.

    The model must have at most 65 536 pieces, and take texts as they are: no normaliser but blanks as space marks, one of
    them before the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        if len(self.names) > 1 << 16:
            raise ValueError("a model of over 65536 pieces; ids are held in 16 bits")
        plain = [not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)) for i in range(len(self.names))]
        self.ids = {name: i for i, name in enumerate(self.names) if plain[i]}
        self.rank = {name: library.get_score(i) for name, i in self.ids.items()}
        self.bytes = {int(name[3:5], 16): i for i, name in enumerate(self.names) if library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        #: Id of each piece, and -1 for what only begins a piece.
        self.table = dict.fromkeys((name[:n] for name in self.ids for n in range(1, len(name))), -1) | self.ids
        self.surface = [name.encode() if plain[i] else b"" for i, name in enumerate(self.names)]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.pairs: dict[int, bool] = {}
        self.stretches: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging, best piece first and leftmost among equals."""
        parts, rank = list(text), self.rank.get
        values = [rank(x + y, _NO_PIECE) for x, y in itertools.pairwise(parts)]
        while values and (best := max(values)) != _NO_PIECE:
            k = values.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del values[k]
            for i in (k - 1, k):
                if 0 <= i < len(values):
                    values[i] = rank(parts[i] + parts[i + 1], _NO_PIECE)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may come right after piece a."""
        found = self.pairs.get(a << 16 | b)
        if found is None:
            left, right = self.names[a], self.names[b]
            found = self.merged(left + right) == [left, right]
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[a << 16 | b] = found
        return found

    def stream(self) -> Stream:
        return Stream(self)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint16)
        parts = _STRETCH.findall(MARK + text.replace(" ", MARK))
        out = list(map(self.stretches.get, parts))
        if None in out:
            out = [self._encode_stretch(part) if ids is None else ids for part, ids in zip(parts, out, strict=True)]
        return np.frombuffer(b"".join(out), np.uint16)

    def _encode_stretch(self, stretch: str) -> bytes:
        if len(stretch) > 2 * self.longest:
            one = Stream(self)
            ids = one.feed(stretch) + one.end()
        else:
            ids = self._whole(stretch)
        out = array("H", ids).tobytes()
        if len(self.stretches) < CACHE_STRETCHES and len(stretch) <= 64:
            self.stretches[stretch] = out
        return out

    def _whole(self, text: str) -> list[int]:
        """The ids of a text that fits the window: its end is where all paths meet, so the furthest position goes on first.

        In whatever order positions are extended, each gets the one path it has.
        """
        find, pairs, longest, ids, n = self.table.get, self.pairs.get, self.longest, self.ids, len(text)
        back, last, at = [0] * (n + 1), [_OTHER, *[None] * n], 0
        open_steps: list[tuple[int, int, int]] = []
        while at < n:
            if text[at] not in ids:
                open_steps.append((at, at + 1, _OTHER))  # a character that no piece has stands alone
            for stop in range(at + 1, (at + longest if at + longest < n else n) + 1):
                piece = find(text[at:stop])
                if piece is None:
                    break
                if piece >= 0 and last[stop] is None:
                    open_steps.append((at, stop, piece))
            while True:
                start, stop, piece = open_steps.pop()
                if last[stop] is not None:
                    continue
                before = last[start]
                if before < 0 or piece < 0:
                    break
                fits = pairs(before << 16 | piece)
                if self.follows(before, piece) if fits is None else fits:
                    break
            last[stop], back[stop], at = piece, start, stop
        return self.path(text, back, last, n)

    def search(self, text: str, back: list[int], last: list[int | None], first: int, until: int) -> None:
        """Extend the paths that end from ``first`` up to ``until`` by every compatible piece; what they reach has one path then."""
        find, pairs, follows, longest, ids, n = self.table.get, self.pairs.get, self.follows, self.longest, self.ids, len(text)
        for start in range(first, until):
            before = last[start]
            if before is None:
                continue
            for stop in range(start + 1, (start + longest if start + longest < n else n) + 1):
                if last[stop] is not None:
                    continue
                piece = find(text[start:stop])
                if piece is None:
                    break
                if piece < 0:
                    continue
                if before >= 0:
                    fits = pairs(before << 16 | piece)
                    if not (follows(before, piece) if fits is None else fits):
                        continue
                last[stop], back[stop] = piece, start
            if last[start + 1] is None and text[start] not in ids:
                last[start + 1], back[start + 1] = _OTHER, start  # a character that no piece has stands alone

    def path(self, text: str, back: list[int], last: list[int | None], boundary: int) -> list[int]:
        """The ids of the path to ``boundary``; a character without a piece gives those of its bytes."""
        out: list[int] = []
        while boundary > 0:
            piece, start = last[boundary], back[boundary]
            if piece == _OTHER:
                out += [self.bytes[x] for x in reversed(text[start:boundary].encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece)
            boundary = start
        out.reverse()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Stream:
    """Encodes characters as they come, holding a window of the longest piece's length, or up to where paths meet."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # characters not committed
        self.back: list[int] = [0]  # start of the last piece of the path to each position
        self.last: list[int | None] = [_OTHER]  # that piece; None where no path ends
        self.done = 0  # positions whose next pieces are all known

    def feed(self, text: str) -> list[int]:
        """Take more characters; the ids that are now settled."""
        out: list[int] = []
        for a in range(0, len(text), 64):
            self.text += text[a : a + 64]
            if len(self.text) > 2 * self.pieces.longest:
                self._search(len(self.text) - self.pieces.longest + 1)
                out += self._commit(self._meeting())
        return out

    def end(self) -> list[int]:
        """The remaining ids."""
        self._search(len(self.text))
        out = self._commit(len(self.text))
        self.back, self.last, self.done = [0], [_OTHER], 0
        return out

    def _search(self, until: int) -> None:
        """Extend the paths that end before ``until`` by every compatible piece; what they reach has one path then."""
        missing = len(self.text) + 1 - len(self.last)
        self.last += [None] * missing
        self.back += [0] * missing
        self.pieces.search(self.text, self.back, self.last, self.done, until)
        self.done = max(self.done, until)

    def _meeting(self) -> int:
        """The last boundary that the paths of all positions which a piece can still start from have in common."""
        open_ends = {p for p in range(self.done, len(self.text) + 1) if self.last[p] is not None}
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.remove(top)
            open_ends.add(self.back[top])
        return open_ends.pop()

    def _commit(self, boundary: int) -> list[int]:
        out = self.pieces.path(self.text, self.back, self.last, boundary)
        if boundary:
            self.text = self.text[boundary:]
            self.back = [max(0, b - boundary) for b in self.back[boundary:]]
            self.last = self.last[boundary:]
            self.done = max(0, self.done - boundary)
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker, with what it remembers."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_ids, ids, ids_crc32); ids are little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Rows that repeat an identifier are encoded each; other columns are not read. An
    empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(model).encode
        for b in batches:
            ids = [encode(t or "").astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            arrays = [b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_ids", "ids", "ids_crc32"])

    with small_batches(docs.sparkSession, 256):
        return pin(source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_ids long, ids binary, ids_crc32 long")).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows. Null ids give a null text."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(model).decode
        for b in batches:
            texts = [None if x is None else decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    with small_batches(encoded.sparkSession, 256):
        return pin(source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text string")).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, n_chars, text_crc32, same) of each text encoded and decoded again in one pass.

    ``same`` says whether the decoded text is the input; it is not where the input holds the space mark itself.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = vocabulary.encode(text or "")
                back = vocabulary.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (text or "")))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [b.column("id"), *(pa.array(list(c), pa.int64()) for c in columns[:4]), pa.array(list(columns[4]), pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_ids", "ids_crc32", "n_chars", "text_crc32", "same"])

    with small_batches(docs.sparkSession, 256):
        out = pin(source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_ids long, ids_crc32 long, n_chars long, text_crc32 long, same boolean"))
    return out.withColumnRenamed("id", id_col)
