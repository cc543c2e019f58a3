"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a segment the table keeps the one token that the prefix's
encoding ends with.  An Aho-Corasick automaton over the vocabulary finds the
pieces that end at a position; a piece is the last token there if it is
compatible with the last token before it, that is, if merging never rebuilds
the pair differently.  Walking the table backwards recovers the ids.  Pair
tests are merged out once and remembered, and so are whole segments.

Segments are runs of letters or of other characters, each with at most one
space marker in front.  No vocabulary piece crosses such a boundary (checked
on load), so no merge does, and segments can be encoded on their own.  Runs of
space markers all merge at one, lowest score, leftmost first, after everything
else; they have a table of their own.

Defined results: null is the empty text, which has no ids; characters outside
the vocabulary become their UTF-8 byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt

SPACE = "▁"
_LETTERS = rf"{SPACE}?[^\W\d_²³¹]+"
_OTHERS = rf"{SPACE}?(?:[^\w{SPACE}]|[\d_²³¹])+"
_SEGMENT = re.compile(rf"{SPACE}+(?={SPACE})|{_LETTERS}|{_OTHERS}|{SPACE}")
_WHOLE = re.compile(rf"{_LETTERS}|{_OTHERS}|{SPACE}+")
#: Remembered segments and pairs; both start anew when they are full.
MAX_SEGMENTS, MAX_PAIRS = 1_000_000, 400_000
LONGEST_REMEMBERED = 64


class _Segments(dict):
    def __init__(self, table: PieceTable):
        self.table = table

    def __missing__(self, segment: str) -> bytes:
        out = self.table.pack(self.table.tokens(segment))
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self) >= MAX_SEGMENTS:
                self.clear()
            self[segment] = out
        return out


class PieceTable:
    """A byte-fallback BPE model with identity normalization and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(lib.get_piece_size())
        names = [lib.id_to_piece(i) for i in size]
        self.byte_id = [-1] * 256
        self.surface: list[bytes] = []
        for i in size:
            if lib.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
                self.surface.append(bytes([int(names[i][3:5], 16)]))
            elif lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(names[i].replace(SPACE, " ").encode())
        self.is_byte = [lib.is_byte(i) for i in size]
        normal = [i for i in size if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {names[i]: i for i in normal}
        self.score = {names[i]: lib.get_score(i) for i in normal}
        self.runs = {len(p) for p in self.id if p.strip(SPACE) == ""}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if p.strip(SPACE) or p == SPACE:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.singles = {p for p in self.id if len(p) == 1}
        ranked = [self.score[p] for p in self.id if len(p) > 1 and p.strip(SPACE)]
        low = min(ranked, default=0)
        if (
            -1 in self.byte_id
            or len(set(ranked)) < len(ranked)
            or any(not _WHOLE.fullmatch(p) or not self.singles.issuperset(p) for p in self.id)
            or any(self.score[SPACE * n] >= low for n in self.runs if n > 1)
        ):
            raise ValueError("not a byte-fallback BPE model whose pieces keep to one segment")
        self.pairs: dict[str, dict[str, bool]] = {}  # by piece, then by the piece before it
        self.n_pairs = 0
        self.alone: dict[str, bool] = {}
        self.segments = _Segments(self)
        self.space_runs: dict[int, bytes] = {}
        self.lone_space = self.pack([SPACE])
        for probe in ("Ab  c\n", " \t x1.5", "é中\U0001d518"):
            if self.encode(probe).tolist() != lib.encode(probe):
                raise ValueError("the model normalizes text, which this table doesn't")

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost of equals: for pair tests only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        out = self.merged(a + b) == [a, b]
        if self.n_pairs >= MAX_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        self.pairs.setdefault(b, {})[a] = out
        return out

    def tokens(self, segment: str) -> list[str]:
        """The pieces of one segment; a character outside the vocabulary stands for itself."""
        n, singles, pairs, none = len(segment), self.singles, self.pairs, {}
        last: list[str | None] = [None if c in singles else c for c in segment]
        for end, piece in self.automaton.iter(segment):
            if last[end] is not None:
                continue
            before = end - len(piece)
            if before < 0:
                fits = self.alone.get(piece)
                if fits is None:
                    fits = self.alone[piece] = self.merged(piece) == [piece]
            else:
                prior = last[before]
                fits = pairs.get(piece, none).get(prior)
                if fits is None:
                    fits = self.compatible(prior, piece)
            if fits:
                last[end] = piece
        out, i = [], n - 1
        while i >= 0:
            piece = last[i]
            out.append(piece)
            i -= len(piece)
        return out[::-1]

    def pack(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                ids += [self.byte_id[x] for x in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        return array("i", ids).tobytes()

    def space_run(self, n: int) -> bytes:
        """A run of n space markers that nothing else claims."""
        if n not in self.space_runs:
            done: list[int] = []
            for _ in range(n):
                done.append(1)
                # Leftmost first: what grows is always the leftmost piece that still can.
                while len(done) > 1 and done[-2] + done[-1] in self.runs:
                    done[-2:] = [done[-2] + done[-1]]
            if len(self.space_runs) >= 10_000:
                self.space_runs.clear()
            self.space_runs[n] = self.pack([SPACE * k for k in done])
        return self.space_runs[n]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        found = _SEGMENT.findall(marked)
        if SPACE + SPACE not in marked:
            return b"".join(map(self.segments.__getitem__, found))
        out, run = [], 0
        for s in found:
            if s.strip(SPACE) == "":
                run += len(s)
                continue
            ids = self.segments[s]
            if run and ids[:4] == self.lone_space and s[0] == SPACE:
                run, ids = run + 1, ids[4:]
            if run:
                out.append(self.space_run(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self.space_run(run))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Any ids; byte pieces that are no valid UTF-8 become U+FFFD, one each."""
        if not ids:
            return ""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and not self.is_byte[first] and first and self.surface[first][:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        out, run, seen = [], b"", False

        def flush() -> None:
            nonlocal run
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run = b""

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                s = self.surface[i].decode()
                out.append(s[1:] if not seen and i and s.startswith(" ") else s)
            seen = seen or bool(self.surface[i])
        flush()
        return "".join(out)


_loaded: dict[str, PieceTable] = {}


def load(path: str) -> PieceTable:
    """The table of one model file, once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceTable(path)
    return _loaded[path]


def _ids_array(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for b in rt.small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array([table.encode_bytes(t) for t in rt.texts(b.column(1))])], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    rt.prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for b in rt.small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encode and decode in one Python pass, so that a task needs one worker."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for b in rt.small(batches):
            packed = [table.encode_bytes(t) for t in rt.texts(b.column(1))]
            decoded = [table.decode(np.frombuffer(x, np.int32).tolist()) for x in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(packed), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
