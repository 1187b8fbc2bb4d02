"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding backtracks: an Aho-Corasick automaton gives the pieces that match at each place, the longest is
tried first, and a piece may follow another only if merging the two pieces' text anew gives just these
two. A bitfield holds the places from which no continuation was found. This gives the same pieces as the
merges in order of score, as these give the only sequence whose neighbours are all compatible.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.runtime import text_chunks, texts_of

SPACE = "\u2581"
#: Chunks of text whose result a Python worker remembers at most, and the longest of them.
MEMO_SIZE, MEMO_LENGTH = 200_000, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
TOKEN_SCHEMA = "doc_id long, ids array<int>, decoded string"
_CHUNK = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == (spec.eos_piece or "</s>"))
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.unknown_surface = spec.unk_surface
        #: No piece goes on after a space mark that follows another character, so text splits there.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The longest piece, or single character, that a piece begins with.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.scores), None) for p in self.scores if len(p) > 1}
        surfaces = [self.surface([i]).encode() if kind != BYTE else bytes([self.byte_of[i]]) for i, kind in enumerate(self.kinds)]
        self.surface_bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_sizes = np.array([len(x) for x in surfaces], np.int64)
        self.surface_places = np.cumsum(self.surface_sizes) - self.surface_sizes

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves: highest score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces and unknown characters of a text that is normalised already."""
        n = len(text)
        longest = [0] * n
        for last, size in self.automaton.iter(text):  # by rising end, so the longest comes last
            longest[last + 1 - size] = last + 1
        shorter, pairs, compatible = self.shorter, self.pairs, self.compatible
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        place, before = 0, ""
        piece: str | None = text[: longest[0] or 1]
        while True:
            while piece is not None:
                stop = place + len(piece)
                if not failed[stop >> 3] >> (stop & 7) & 1:
                    fits = not before or pairs.get((before, piece))
                    if fits or fits is None and compatible(before, piece):
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed[place >> 3] |= 1 << (place & 7)
                if not out:
                    raise ValueError("the model's merges don't reach this text")
                last = out.pop()
                before = out[-1] if out else ""
                place -= len(last)
                piece = shorter.get(last)
                continue
            out.append(piece)
            if stop == n:
                return out
            place, before = stop, piece
            piece = text[place : longest[place] or place + 1]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk that is normalised already; unknown characters as bytes."""
        ids: list[int] = []
        for piece in self.split(chunk):
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return ids

    def chunks(self, text: str) -> list[str]:
        """Normalised text in parts that are encoded apart."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        return _CHUNK.findall(text) if self.splits else [text]

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a text, with the end id last if asked for."""
        return [i for chunk in self.chunks(text) for i in self.chunk_ids(chunk)] + [self.end] * end

    def surface(self, ids: list[int]) -> str:
        """Text of ids, the dummy prefix still there. Byte runs that aren't UTF-8 become U+FFFD a byte."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if i is not None and self.kinds[i] == NORMAL:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i == self.unknown:
                out.append(self.unknown_surface)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the dummy prefix."""
        text = self.surface(ids)
        return text[1:] if self.prefix and text.startswith(" ") and next((self.kinds[i] == NORMAL for i in ids if self.kinds[i] != CONTROL), False) else text


def utf8(run: bytes) -> str:
    """Decoded bytes; each byte outside a whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


class Memo(dict):
    """Chunk to its ids (packed int32). When full, it becomes the older generation, from which chunks come back."""

    def __init__(self, model: PieceModel):
        self.model, self.older = model, {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            packed = array("i", self.model.chunk_ids(chunk)).tobytes()
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_SIZE:
                self.older = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    """This Python worker's memory for a model."""
    if path not in _memos:
        _memos[path] = Memo(PieceModel(path))
    return _memos[path]


def decode_batch(model: PieceModel, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """Texts of id sequences that stand end to end, by gathering the pieces' bytes."""
    size = model.surface_sizes[ids]
    first = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(first[-1]) + np.repeat(model.surface_places[ids] - first[:-1], size)
    normal = np.array(model.kinds)[ids[np.minimum(at[:-1], max(len(ids) - 1, 0))]] == NORMAL if len(ids) else np.zeros(len(at) - 1, bool)
    data, cut = model.surface_bytes[where].tobytes(), first[at].tolist()
    out = []
    for i in range(len(at) - 1):
        try:
            text = data[cut[i] : cut[i + 1]].decode()
            out.append(text[1:] if normal[i] and model.prefix and text.startswith(" ") else text)
        except UnicodeDecodeError:  # byte pieces that are no character
            out.append(model.decode(ids[at[i] : at[i + 1]].tolist()))
    return out


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """For each row of ``docs``: doc_id, ids (the end id last, no start id) and the text decoded from them.

    ``model_path`` must be there on every executor. Null text counts as empty: the end id alone, decoded
    to an empty text. Whole texts are encoded, whatever their length; repeated rows each, and further
    columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(model_path)
        model, get = known.model, known.__getitem__
        end = array("i", [model.end]).tobytes()
        for batch, _, _ in text_chunks(batches):
            packed = [b"".join(list(map(get, model.chunks(text or "")))) + end for text in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), np.int32)
            texts = decode_batch(model, ids, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return texts_of(docs).mapInArrow(scan, TOKEN_SCHEMA)
