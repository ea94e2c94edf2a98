"""SentencePiece BPE: exact encoding by backtracking, and decoding.

Merging by score gives one result for a text, and a row of pieces is that result just when each piece
merges to itself and each two neighbours, merged again from their characters, come out as the same two
pieces. So no text is merged as a whole. An Aho-Corasick automaton over the reversed pieces finds the longest
piece that starts at each place; from left to right the longest is taken that fits to the piece before, and
when none fits the place is marked as failed in a bitfield and the piece before gives way to its longest
shorter one. No place is tried twice after it failed, so the work is linear in the text.

Pieces have white space at their start only (or are nothing else), so a text can be cut before white space
that follows another character, and each distinct cut is encoded once. The model's pieces and scores
go to the executors; their size is that of the model file (half a megabyte), whatever the corpus. Texts are
encoded where they are read; there is no shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.memo import Memo
from basketlens.llm.words import pieces

#: The library's mark for white space; here white space stands for it.
MARK = "▁"
#: What the library makes of an unknown id, and of a byte that is part of no character (fixed values).
UNKNOWN, BROKEN = " ⁇ ", "�"
#: Bytes of text handled at once; cuts and pairs of pieces remembered by a Python worker.
PIECE = 1 << 22
REMEMBERED = 300_000
PAIRS = 1_000_000
#: Longer cuts are not remembered.
LONGEST = 64


class Model:
    """The pieces of a BPE model with their scores, for encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _settings(library.serialized_model_proto())
        self.prefix = spec["add_dummy_prefix"]
        ids = range(library.get_piece_size())
        self.unknown = library.unk_id()
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec["byte_fallback"] else None
        self.control = {i for i in ids if library.is_control(i)}
        #: Bytes that an id stands for; None for control ids and the unknown one.
        self.spelled: list[bytes | None] = [
            None
            if library.is_unknown(i) or i in self.control
            else bytes([int(library.id_to_piece(i)[3:5], 16)])
            if library.is_byte(i)
            else library.id_to_piece(i).replace(MARK, " ").encode()
            for i in ids
        ]
        self.of_byte = {i for i in ids if library.is_byte(i)}
        normal = [i for i in ids if not (i == self.unknown or i in self.control or library.is_byte(i))]
        if any(library.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {library.id_to_piece(i).replace(MARK, " "): i for i in normal}
        self.score = {library.id_to_piece(i).replace(MARK, " "): library.get_score(i) for i in normal}
        #: Whether no piece has white space after another character, so that texts can be cut there.
        self.cuts = not any(re.search("[^ ] ", piece) for piece in self.ids)
        letters = {c for piece in self.ids for c in piece}
        #: Pieces that the merges of their own characters give, and single characters.
        self.known = sorted(letters | {p for p in self.ids if self.merged(p) == [p]})
        self._ready()

    def merged(self, text: str) -> list[str]:
        """Merges as defined: the pair of best score first, the leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score.get
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            right = after[i]
            # An entry is good if its two sides are as they were.
            if parts[i] is None or right >= n or len(parts[i]) + len(parts[right]) != len(piece):
                continue
            parts[i], parts[right] = piece, None
            after[i] = after[right]
            if after[i] < n:
                before[after[i]] = i
                if (s := score(piece + parts[after[i]])) is not None:
                    heappush(heap, (-s, i, piece + parts[after[i]]))
            if (left := before[i]) >= 0 and (s := score(parts[left] + piece)) is not None:
                heappush(heap, (-s, left, parts[left] + piece))
        return [p for p in parts if p is not None]

    def _ready(self) -> None:
        import ahocorasick

        self.place = {piece: at for at, piece in enumerate(self.known)}
        self.length = [len(piece) for piece in self.known]
        self.shorter = [
            next((self.place[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.place), -1) for p in self.known
        ]
        self.automaton = ahocorasick.Automaton()
        for at, piece in enumerate(self.known):
            self.automaton.add_word(piece[::-1], at)
        self.automaton.make_automaton()
        self.letters = {p for p in self.known if len(p) == 1}
        self.coded = [self._coded(piece) for piece in self.known]
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(REMEMBERED)

    def __getstate__(self) -> dict:
        made = "place length shorter automaton letters coded pairs memo".split()
        return {k: v for k, v in self.__dict__.items() if k not in made}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def _coded(self, piece: str) -> list[int]:
        """The ids of a piece; of a character that is none, its bytes or the unknown id."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.replace(" ", MARK).encode()] if self.bytes else [self.unknown]

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbours come out of their merged characters as they are."""
        a, b = self.known[left], self.known[right]
        fit = self.merged(a + b) == [a, b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = fit
        return fit

    def _longest(self, text: str) -> list[int]:
        """The longest piece that starts at each place."""
        # Of the pieces that end together the longest comes first, so it is set last.
        ends = dict(reversed(list(self.automaton.iter(text[::-1]))))
        return [ends[i] for i in range(len(text) - 1, -1, -1)]

    def _row(self, text: str) -> list[int]:
        """Places of the pieces of a text of known characters."""
        if (whole := self.place.get(text)) is not None:
            return [whole]
        longest, n = self._longest(text), len(text)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        failed = bytearray((n >> 3) + 1)
        row: list[int] = []
        # Before the first piece there is none that could not fit.
        at, piece, left = 0, longest[0], -1
        while True:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] & 1 << (end & 7):
                    fit = left < 0 or pairs.get(left << 32 | piece)
                    if fit or (fit is None and self.fits(left, piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                row.append(piece)
                if end == n:
                    return row
                at, left, piece = end, piece, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = row.pop()
                at -= length[piece]
                piece = shorter[piece]
                left = row[-1] if row else -1

    def encoded(self, text: str) -> list[int]:
        """The ids of a text, with white space already at its start where the model puts it."""
        coded = self.coded
        if self.letters.issuperset(text):
            return [i for piece in self._row(text) for i in coded[piece]] if text else []
        out: list[int] = []
        at = 0
        strange = [i for i, c in enumerate(text) if c not in self.letters]
        for i in [*strange, len(text)]:
            if i > at:
                out += [x for piece in self._row(text[at:i]) for x in coded[piece]]
            if i < len(text):
                out += self._coded(text[i])
            at = i + 1
        if self.bytes is None:
            # A run of unknown characters is one id.
            out = [x for i, x in enumerate(out) if x != self.unknown or i == 0 or out[i - 1] != x]
        return out

    def encode(self, text: str) -> list[int]:
        whole = text.replace(MARK, " ")
        return self.encoded((" " if self.prefix else "") + whole) if whole else []

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut as 32-bit numbers."""
        out = []
        for cut in cuts:
            ids = self.memo.get(cut)
            if ids is None:
                ids = array("i", self.encoded(cut)).tobytes()
                if len(cut) <= LONGEST:
                    self.memo.put(cut, ids)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str | None:
        """The text of ids; None if one is out of range."""
        spelled = self.spelled
        if ids and (min(ids) < 0 or max(ids) >= len(spelled)):
            return None
        try:
            text = b"".join([spelled[i] for i in ids]).decode()
        except (TypeError, UnicodeDecodeError):
            return self._decode_slowly(ids)
        if self.prefix and ids and ids[0] not in self.of_byte and spelled[ids[0]]:
            return text[1:] if text.startswith(" ") else text
        return self._decode_slowly(ids) if self.prefix else text

    def _decode_slowly(self, ids: list[int]) -> str:
        """With unknown ids, broken bytes, and control ids or bytes before the first piece."""
        out: list[str] = []
        run = bytearray()
        start, dropped = self.prefix, False
        for i in [*ids, None]:
            if i in self.of_byte:
                run += self.spelled[i]
                continue
            out += _characters(bytes(run))
            run.clear()
            if i is None:
                break
            if dropped or any(out):
                start = False
            dropped = False
            if i in self.control:
                out.append("")
            elif i == self.unknown:
                out.append(UNKNOWN)
            else:
                text = self.spelled[i].decode()
                dropped = start and text.startswith(" ")
                out.append(text[1:] if dropped else text)
        return "".join(out)


def _characters(run: bytes) -> Iterator[str]:
    """The characters of bytes; a byte that starts none is a mark of its own."""
    at = 0
    while at < len(run):
        for n in range(1, 5):
            try:
                yield run[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            yield BROKEN
            at += 1


def _settings(proto: bytes) -> dict[str, bool]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    normal, trainer = model.normalizer_spec, model.trainer_spec
    if trainer.model_type != trainer.BPE or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
        raise ValueError("only BPE models that keep texts as they are")
    if trainer.treat_whitespace_as_suffix or not normal.escape_whitespaces:
        raise ValueError("only models with white space as a prefix")
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError("models with pieces of the user are not supported")
    return {"add_dummy_prefix": normal.add_dummy_prefix, "byte_fallback": trainer.byte_fallback}


def _starts(data: np.ndarray, offsets: np.ndarray, cuts: bool) -> np.ndarray:
    """Where a new cut begins: at each text, and at white space that follows another character."""
    first = np.zeros(len(data) + 1, dtype=bool)
    if cuts:
        white = data == 0x20
        first[1:-1] = white[1:] & ~white[:-1]
    first[offsets] = True
    first[-1] = False
    return np.flatnonzero(first)


def _encode(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.replace_substring(batch["text"].cast(pa.large_string()).fill_null(""), MARK, " ")
        if model.prefix:
            empty = pc.equal(pc.binary_length(texts), 0)
            texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        for part in pieces(texts, PIECE):
            starts = _starts(part.data, part.offsets, model.cuts)
            # The cuts lie side by side, so they are an Arrow column over the same bytes.
            column = pa.LargeStringArray.from_buffers(
                len(starts), pa.py_buffer(np.append(starts, len(part.data))), pa.py_buffer(part.data)
            ).dictionary_encode()
            cut = model.encode_cuts(column.dictionary.to_pylist()).__getitem__
            codes = column.indices.to_numpy()
            at = np.searchsorted(starts, part.offsets)
            ids = [
                np.frombuffer(b"".join(map(cut, codes[at[i] : at[i + 1]].tolist())), dtype="<i4")
                for i in range(len(part))
            ]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(part.first, len(part)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array([model.decode(x.tolist()) for x in ids], pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )


def round_trip(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string, from the ids) for every text.

    As the library does it for the BPE model file ``path``, without begin or end ids and without sampling; the
    file must be readable by the driver. A null text counts as empty: no ids, an empty string. Each row
    is encoded by itself; repeated rows and ids, also null ones, stay, and an empty table gives none. Other
    columns, also such as are named ids or decoded, are not read. A very long text without white space is
    encoded in linear time, but as a whole in one task.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    model = documents.sparkSession.sparkContext.broadcast(Model(path))
    return frame.mapInArrow(
        lambda batches: _encode(model.value, batches), f"doc_id {kind}, ids array<int>, decoded string"
    )


def decode(frame: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with a column of the texts its ids stand for, as the library decodes them.

    Null for null ids, and where an id is null or none of the model's; empty ids are an empty text. Repeated rows and other
    columns stay as they are; a column that has the name of the new one is replaced.
    """
    model = frame.sparkSession.sparkContext.broadcast(Model(path))
    kept = [c for c in frame.columns if c != decoded]
    source = "_ids_of_the_text"
    while source in kept:
        source += "_"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*kept).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch[source].to_pylist()
            texts = [None if x is None or None in x else model.value.decode(x) for x in rows]
            yield batch.select(kept).append_column(decoded, pa.array(texts, pa.string()))

    given = frame.select(*kept, F.col(ids).cast("array<int>").alias(source))
    return given.mapInArrow(run, ", ".join([*fields, f"`{decoded}` string"]))
