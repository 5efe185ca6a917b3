"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model none of whose pieces holds a white-space marker after another character, no merge crosses from one marked
word into the next. A slice of texts is therefore cut into marked words where they stand in Arrow's buffer, Arrow lists
the distinct ones, each of these is segmented once by byte-pair merging (best score first, leftmost on ties, bytes for
characters without a piece), and the ids are joined back by position. What was segmented before is kept in the Python
worker in a table of TABLE entries at most, which starts anew when full; that costs time but changes no result. A model
with crossing pieces takes each text as one chunk.

The library itself only lists the model's pieces and scores, and encodes a few probes once on the driver: a model that
is no byte-pair model, or changes texts before it encodes them, is refused. The model's bytes travel with the tasks, so
its file need not be on the executors.

Defined results: null reads as the empty text, which has no ids. Rows that repeat are encoded each for itself. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import slices

#: Entries of a worker's table of distinct chunks.
TABLE = 400_000
#: Chunks of more characters than this are merged with a heap, each for itself, and kept out of the table.
LONG = 64
#: The rank of two symbols that make no piece.
NONE = 1 << 40
#: Bytes of text whose chunks are listed together.
SLICE = 1 << 21
MARK = "▁"
#: Texts by which a model is told from one that this module would encode wrongly.
PROBES = ("", " ", "  two  blanks ", "a\nb\r\n\nc", "ﬁne ① Ａ é e\u0301 Ǆ", "Grüße, señor 12,345.67 \U0001f600", "the of and unbelievable internationalisation", "x" * 30, "<s></s><unk><0x0A>", "日本語の文 mixed 中文")


class Pieces:
    """The pieces of a model and the table of chunks segmented so far."""

    def __init__(self, model: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.ids = {names[i]: i for i in range(size) if i not in special}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        #: piece -> rank of its score; 0 is merged first
        self.rank = {p: place[model.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        # a symbol is a piece's id, or `size` plus the code point of a character that is no piece
        self.size = size
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(MARK)]  # a blank stands for the marker in chunks
        pairs = sorted((self._symbol(p[:i]) << 32 | self._symbol(p[i:]), r, self.ids[p]) for p, r in self.rank.items() for i in range(1, len(p)) if (i == 1 or p[:i] in self.ids) and (i == len(p) - 1 or p[i:] in self.ids))
        #: the two symbols of each pair that makes a piece, sorted; its rank; the piece
        self.pairs, self.pair_rank, self.pair_piece = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.full(1, -1), np.zeros(1), np.zeros(1))
        self.decimal = [str(i) for i in range(size)]
        self.text = {i: p for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.lines_apart = not any("\n" in p for p in self.ids)
        #: chunk -> its ids as decimal text, and its spelling where that is not the chunk again
        self.table: dict[bytes, tuple[bytes, str | None]] = {}

    def _symbol(self, piece: str) -> int:
        return int(self.symbol[ord(piece)]) if len(piece) == 1 else self.ids[piece]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols, NONE if they make no piece, and its place among the pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE), at

    def merge(self, chunks: list[bytes]) -> list[list[int]]:
        """Byte-pair merging of many chunks at once, as symbols: each step merges the best pair of every chunk, the
        leftmost where several are equal."""
        out: list[list[int]] = [[]] * len(chunks)
        texts = [c.decode("utf-8", "replace") for c in chunks]
        number = np.array([i for i, t in enumerate(texts) if 0 < len(t) <= LONG], np.int64)
        for i, t in enumerate(texts):
            if len(t) > LONG:
                out[i] = [self._symbol(p) for p in self._merge_long(t.replace(" ", MARK))]
        if not len(number):
            return out
        symbols = self.symbol[np.frombuffer("".join([texts[i] for i in number]).encode("utf-32-le", "replace"), np.uint32)]
        sizes = np.array([len(texts[i]) for i in number])
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank, at = self._ranks(symbols, np.append(symbols[1:], 0))
        rank[last] = NONE
        while True:
            first = np.flatnonzero(np.append(True, last[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            done = least == NONE
            if done.any():
                ended = np.repeat(done, sizes)
                flat, ends = symbols[ended].tolist(), np.cumsum(sizes[done]).tolist()
                for i, a, b in zip(number[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                number, least, sizes = number[~done], least[~done], sizes[~done]
                symbols, last, rank, at = (x[~ended] for x in (symbols, last, rank, at))
                if not len(number):
                    return out
            best = np.flatnonzero(rank == np.repeat(least, sizes))
            chunk = np.repeat(np.arange(len(sizes)), sizes)[best]
            best = best[np.append(True, chunk[1:] != chunk[:-1])]
            symbols[best] = self.pair_piece[at[best]]
            last[best] = last[best + 1]
            stays = np.ones(len(symbols), bool)
            stays[best + 1] = False
            best -= np.arange(len(best))  # where the merged symbols stand once the others are gone
            symbols, last, rank, at = (x[stays] for x in (symbols, last, rank, at))
            for changed in (best, best[best > 0] - 1):
                inside = changed[~last[changed]]
                rank[changed] = NONE
                rank[inside], at[inside] = self._ranks(symbols[inside], symbols[inside + 1])

    def _merge_long(self, chunk: str) -> list[str]:
        n = len(chunk)
        parts: list[str | None] = list(chunk)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, p) for i in range(n - 1) if (r := self.rank.get(p := chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != piece:
                continue  # one of its sides has been merged since
            parts[i], parts[j], after[i] = piece, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.rank.get(p := parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, p))
        return [p for p in parts if p is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the marker that encoding puts first."""
        return self._spell(ids).removeprefix(MARK).replace(MARK, " ")

    def _spell(self, ids: list[int]) -> str:
        try:
            return "".join([self.text[i] for i in ids])
        except (TypeError, KeyError):  # bytes, or ids that stand for no text
            pass
        out, raw = [], bytearray()
        for i in ids:
            piece = self.text.get(i, "")
            if isinstance(piece, bytes):
                raw += piece
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(piece)
        return "".join(out) + raw.decode("utf-8", "replace")

    def _entries(self, chunks: list[bytes]) -> list[tuple[bytes, str | None]]:
        """The table's entry of each chunk; those that it lacks are segmented."""
        if len(self.table) > TABLE:
            self.table.clear()
        missing = [c for c in chunks if c not in self.table]
        extra = {}
        for chunk, symbols in zip(missing, self.merge(missing), strict=True):
            if max(symbols) >= self.size:  # characters that are no pieces become bytes
                symbols = [i for x in symbols for i in ([x] if x < self.size else [self.bytes[b] for b in chr(x - self.size).encode("utf-8", "surrogatepass")])]
            text = chunk.decode("utf-8", "replace")
            spelled = self._spell(symbols).replace(MARK, " ")
            (self.table if len(text) <= LONG else extra)[chunk] = (",".join([self.decimal[i] for i in symbols]).encode(), None if spelled == text else spelled)
        return [self.table.get(c) or extra[c] for c in chunks]

    def rows(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """(ids as decimal text, decoded text) of each text of a column of strings."""
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        for lo, hi, data, starts in slices(column, SLICE):
            data[starts[:-1]] = 0x20  # the line end before each text becomes the marker that encoding puts first
            blank, line = data == 0x20, (data == 0x0A) & self.lines_apart
            begins = np.zeros(len(data), bool)
            begins[starts] = True
            if not self.crossing:
                begins[1:] |= (blank[1:] & ~blank[:-1]) | (line[1:] != line[:-1]) & ~blank[1:]
            offsets = np.flatnonzero(begins).astype(np.int32)  # the last one is the line end after all texts
            chunks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            entries = self._entries(chunks.dictionary.to_pylist())
            ids = np.array([e[0] for e in entries], object)
            changed = np.array([e[1] is not None for e in entries], bool)
            codes = chunks.indices.to_numpy()
            bounds = np.searchsorted(offsets, starts)
            for a, b, first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if end == first + 1:
                    yield b"", b""
                    continue
                here = codes[a:b]
                text = data[first + 1 : end].tobytes()
                if changed.any() and changed[here].any():
                    spelled = "".join([e[1] if e[1] is not None else c.as_py().decode("utf-8", "replace") for c, e in ((chunks.dictionary[i], entries[i]) for i in here.tolist())])
                    text = spelled.removeprefix(" ").encode("utf-8", "replace")
                yield b",".join(ids[here].tolist()), text

    def encode(self, text: str) -> np.ndarray:
        ((ids, _),) = self.rows(pa.array([text], pa.string()))
        return _numbers([ids])

    def check(self, model: bytes) -> None:
        """Raises ValueError if the library encodes or decodes a probe otherwise."""
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for text in PROBES:
            ids = library.encode(text)
            if self.encode(text).tolist() != ids or self.decode(ids) != library.decode(ids):
                raise ValueError("not a byte-pair model that leaves texts as they are")


def _numbers(ids: list[bytes]) -> np.ndarray:
    return np.fromstring(b",".join([x for x in ids if x]), np.int32, sep=",")


@lru_cache(maxsize=2)
def _model(model: bytes) -> Pieces:
    """The pieces of a model, read once in a Python worker; its table of chunks lives on from task to task."""
    return Pieces(model)


@lru_cache(maxsize=2)
def _checked(model_path: str) -> bytes:
    model = Path(model_path).read_bytes()
    _model(model).check(model)
    return model


def load(model_path: str) -> Pieces:
    """The model of a path, refused unless it encodes the probes as the library does."""
    return _model(_checked(model_path))


def _id_lists(pieces: Pieces, column: pa.Array) -> pa.Array:
    ids = [x for x, _ in pieces.rows(column)]
    sizes = [x.count(b",") + 1 if x else 0 for x in ids]
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_numbers(ids)))


def with_ids(docs: DataFrame, model_path: str, name: str = "ids") -> DataFrame:
    """docs with a column of the ids of its text, in place of a column of that name."""
    docs = docs.drop(name)
    place = docs.columns.index("text")

    shared = docs.sparkSession.sparkContext.broadcast(_checked(model_path))  # a model's file

    def run(batches):
        pieces = _model(shared.value)
        for batch in batches:
            ids = _id_lists(pieces, batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(_checked(model_path))  # a model's file

    def run(batches):
        pieces = _model(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(pieces, batch.column(1))], ["doc_id", "ids"])

    return _text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of each row of encoded (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(_checked(model_path))  # a model's file

    def run(batches):
        pieces = _model(shared.value)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip of each text, digested where its ids are."""
    shared = docs.sparkSession.sparkContext.broadcast(_checked(model_path))  # a model's file

    def run(batches):
        pieces = _model(shared.value)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for ids, decoded in pieces.rows(batch.column(1)):
                n.append(ids.count(b",") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
