"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at every position its output links
name the pieces that end there, and each relaxes the best score at that position (Viterbi).  What
no piece reaches is written in byte pieces.  A text is cut where no piece can cross: before a run
of blanks and around line breaks, so a worker remembers the pieces of units it has met.  New units
in Latin signs walk a table of the automaton together, one sign at a time; units that
are long or hold other signs are read one by one.

Encoding is exact: decoding gives back the text, whatever it holds.  A null text has null pieces;
an empty text has none.  Repeated rows are encoded row by row; other columns pass through,
and an added column takes the place of one with its name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorebook.llm.common import slices, without

BLANK = "▁"
#: A run of blanks and what follows it; a line break; a literal blank sign; other text.
UNIT = re.compile(rf" +[^ \n{BLANK}]*|\n|{BLANK}|[^ \n{BLANK}]+")
#: Bytes of units and their pieces after which a worker forgets those it has met.
REMEMBERED = 32 << 20
#: What a unit takes besides its signs and its pieces.
BESIDES = 180
#: Code points below which a sign is in the tables, longest unit that walks them, cells of one walk.
LATIN = 0x180
LONG = 48
CELLS = 1 << 20
#: Characters that are encoded, and pieces that are decoded, at once.
CHARS_AT_ONCE = 1 << 21
PIECES_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Vocabulary:
    """``pieces``: (text, id, score); ``bytes_``: the ID of each byte's piece; ``size``: of all."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes_: tuple[int, ...]
    size: int


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file; control and unknown pieces are never produced.

    The file is read by the driver; its size is fixed with the model, not with the data.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    bytes_ = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
    pieces = tuple(
        (model.id_to_piece(i), i, model.get_score(i))
        for i in range(size)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    )
    crossing = [p for p, _, _ in pieces if BLANK in p.lstrip(BLANK) or "\n" in p]
    if crossing or len(bytes_) != 256:
        raise ValueError("the model needs byte pieces and pieces with blanks only in front")
    return Vocabulary(pieces, tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)), size)


class Walk:
    """The automaton as tables, for the Latin signs and the blank, where they are pieces."""

    def __init__(self, words: Vocabulary):
        singles = sorted(p for p, _, _ in words.pieces if len(p) == 1 and (ord(p) < LATIN or p == BLANK))
        self.signs = {ord(c): i + 1 for i, c in enumerate(singles)}
        self.index = np.zeros(ord(BLANK) + 1, dtype=np.int16)
        self.index[list(self.signs)] = list(self.signs.values())
        self.only = re.compile("[" + re.escape("".join(singles)) + "]{1,%d}" % LONG) if singles else re.compile("(?!)")
        children: list[dict[int, int]] = [{}]
        piece, score, length = [-1], [0.0], [0]
        for text, number, value in words.pieces:
            if not all(ord(c) in self.signs for c in text):
                continue
            at = 0
            for c in text:
                sign = self.signs[ord(c)]
                if sign not in children[at]:
                    children[at][sign] = len(children)
                    children.append({})
                    piece.append(-1)
                    score.append(0.0)
                    length.append(0)
                at = children[at][sign]
            piece[at], score[at], length[at] = number, value, len(text)
        self.piece, self.score, self.length = np.array(piece), np.array(score), np.array(length)
        self.move = np.zeros((len(children), len(singles) + 1), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        self.link = np.zeros(len(children), dtype=np.int32)  # the next state whose piece ends here
        fail = np.zeros(len(children), dtype=np.int32)
        level = [0]
        while level:
            below = []
            for at in level:
                row = self.move[fail[at]].copy() if at else self.move[0]
                for sign, child in children[at].items():
                    fail[child] = row[sign] if at else 0
                    row[sign] = child
                    below.append(child)
                self.move[at] = row
                ends = fail[at]
                self.link[at] = ends if piece[ends] >= 0 else self.link[ends]
            level = below

    def fits(self, unit: str) -> bool:
        return self.only.fullmatch(unit) is not None

    def best(self, units: list[str]) -> Iterator[bytes]:
        """The packed pieces of units that all fit."""
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        out: list[bytes] = [b""] * len(units)
        at = 0
        while at < len(order):
            width = len(units[order[at]])
            rows = order[at : at + max(1, CELLS // (width + 1))]
            for i, ids in zip(rows, self.together([units[i] for i in rows], width), strict=True):
                out[i] = ids
            at += len(rows)
        return iter(out)

    def together(self, units: list[str], width: int) -> list[bytes]:
        """The pieces of units by falling length."""
        n = np.array([len(u) for u in units])
        signs = np.zeros((len(units), width), dtype=np.int16)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        signs[np.arange(width) < n[:, None]] = self.index[codes] if len(codes) else 0
        score = np.full((len(units), width + 1), -np.inf)
        score[:, 0] = 0.0
        state = np.zeros(len(units), dtype=np.int32)
        back = np.zeros((len(units), width + 1), dtype=np.int32)
        for t in range(width):
            k = int(np.searchsorted(-n, -t, side="left"))
            state = self.move[state[:k], signs[:k, t]]
            end = np.where(self.piece[state] >= 0, state, self.link[state])
            rows = np.flatnonzero(end)
            end = end[rows]
            while len(rows):
                total = score[rows, t + 1 - self.length[end]] + self.score[end]
                better = total > score[rows, t + 1]
                score[rows[better], t + 1] = total[better]
                back[rows[better], t + 1] = end[better]
                end = self.link[end]
                more = end > 0
                rows, end = rows[more], end[more]
        steps, rows, at = [], np.arange(len(units)), n.copy()
        while len(rows):
            state = back[rows, at]
            steps.append((rows, self.piece[state]))
            at = at - self.length[state]
            rows, at = rows[at > 0], at[at > 0]
        if not steps:
            return [b""] * len(units)
        owner = np.concatenate([r for r, _ in steps[::-1]])
        ids = np.concatenate([i for _, i in steps[::-1]])[np.argsort(owner, kind="stable")].astype(np.int32)
        whole, ends = ids.tobytes(), (np.cumsum(np.bincount(owner, minlength=len(units))) * 4).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Segmenter(dict):
    """The pieces of each unit, as packed IDs, computed when first met."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.held = 0
        self.bytes_ = words.bytes_
        self.walk = Walk(words)
        self.automaton = ahocorasick.Automaton()
        for piece, number, score in words.pieces:
            self.automaton.add_word(piece, (len(piece), number, score))
        self.automaton.make_automaton()
        self.fallback = min((s for _, _, s in words.pieces), default=0.0) - 10.0

    def __missing__(self, unit: str) -> bytes:
        ids = self.in_bytes(BLANK) if unit == BLANK else self.best(unit.replace(" ", BLANK))
        packed = array("i", ids).tobytes()
        self[unit] = packed
        self.held += BESIDES + len(unit) + len(packed)
        return packed

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def packed_all(self, texts: list[str | None]) -> list[bytes | None]:
        """The packed pieces of every text; units not met before are segmented together first."""
        rows = [UNIT.findall(" " + t) if t else [] for t in texts]
        if self.held >= REMEMBERED:
            self.forget()
        new = {u for row in rows for u in row}.difference(self)
        ready = {u: u.replace(" ", BLANK) for u in new if u != BLANK}
        fitting = [u for u, plain in ready.items() if self.walk.fits(plain)]
        for unit, packed in zip(fitting, self.walk.best([ready[u] for u in fitting]), strict=True):
            self[unit] = packed
            self.held += BESIDES + len(unit) + len(packed)
        return [None if t is None else b"".join(map(self.__getitem__, row)) for t, row in zip(texts, rows, strict=True)]

    def in_bytes(self, text: str) -> list[int]:
        return [self.bytes_[b] for b in text.encode("utf-8")]

    def best(self, text: str) -> list[int]:
        """The segmentation with the largest sum of scores; of equal sums the longer last piece."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        settled = 0
        for end, (length, number, value) in self.automaton.iter(text):
            while settled < end:
                settled += 1
                if score[settled] is None:
                    score[settled], back[settled] = score[settled - 1] + self.fallback, (1, -1)
            total = score[end + 1 - length] + value
            if score[end + 1] is None or total > score[end + 1]:
                score[end + 1], back[end + 1] = total, (length, number)
        while settled < n:
            settled += 1
            if score[settled] is None:
                score[settled], back[settled] = score[settled - 1] + self.fallback, (1, -1)
        parts, at = [], n
        while at:
            length, number = back[at]
            parts.append([number] if number >= 0 else self.in_bytes(text[at - 1]))
            at -= length
        return [i for part in reversed(parts) for i in part]


def encoded(
    docs: DataFrame, words: Vocabulary, *, text: str = "text", keep_text: bool = True, back: str | None = None, same: str | None = None
) -> DataFrame:
    """``docs`` with ``pieces``, the IDs of each whole text.

    The same pass decodes again where asked to: ``back`` names a column for the text that the
    pieces give back (the text's own name replaces it), ``same`` one for whether it is the text.
    """
    extra = [c for c in (back, same) if c is not None and c != text]
    docs = without(docs, "pieces", *extra)
    kept = [c for c in docs.columns if c != text or (keep_text and back != text)]
    added = [T.StructField("pieces", T.ArrayType(T.IntegerType(), False))]
    added += [T.StructField(back, T.StringType())] if back else []
    added += [T.StructField(same, T.BooleanType())] if same else []
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words)
        decoder = Decoder(words) if back or same else None
        for whole in batches:
            place = whole.schema.get_field_index(text)
            lengths = pc.utf8_length(whole.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(lengths, CHARS_AT_ONCE):
                batch = whole.slice(lo, hi - lo)
                pieces = listed(segmenter.packed_all(batch.column(place).to_pylist()))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pieces]
                if decoder:
                    texts = decoder.texts(pieces)
                    columns += [texts] if back else []
                    columns += [pc.equal(texts, batch.column(place)).fill_null(True)] if same else []
                yield pa.RecordBatch.from_arrays(columns, names=names)
        # Workers serve other tasks next: what this one took goes back.
        segmenter.forget()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def listed(packed: list[bytes | None]) -> pa.ListArray:
    """Packed pieces as one array of lists."""
    sizes = np.array([0 if p is None else len(p) // 4 for p in packed], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(p for p in packed if p), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([p is None for p in packed]))


def decoded(docs: DataFrame, words: Vocabulary, *, pieces: str = "pieces", into: str = "text") -> DataFrame:
    """``docs`` with the text of each row's pieces in the column ``into``."""
    docs = without(docs, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())])
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(words)
        for whole in batches:
            place = whole.schema.get_field_index(pieces)
            lengths = pc.list_value_length(whole.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(lengths, PIECES_AT_ONCE):
                batch = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*batch.columns, table.texts(batch.column(place))], names=[*names, into])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


class Decoder:
    """The bytes of every piece, laid end to end."""

    def __init__(self, words: Vocabulary):
        parts = [b""] * words.size
        for piece, number, _ in words.pieces:
            parts[number] = piece.replace(BLANK, " ").encode("utf-8")
        for byte, number in enumerate(words.bytes_):
            parts[number] = bytes([byte])
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def texts(self, column: pa.ListArray) -> pa.Array:
        """All texts of a column of pieces at once; the blank put in front of a text goes."""
        ids = column.flatten().to_numpy(zero_copy_only=False)
        rows = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        whole = self.blob[source].tobytes()
        limits = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(rows)])]
        valid = column.is_valid().to_pylist()
        return pa.array(
            [
                whole[a + 1 : b].decode("utf-8") if ok else None
                for a, b, ok in zip(limits[:-1].tolist(), limits[1:].tolist(), valid, strict=True)
            ],
            type=pa.string(),
        )
