"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single pass that keeps the best way to each position.

At each end position the automaton's output links give every piece that ends there, longest first. For a unigram model each relaxes the best score of the position (Viterbi).
Characters that are no piece cost the least score less ten, and become byte pieces where the model has them.

The scores of a BPE model are ranks of merges, not log-probabilities, and a Viterbi over them gives other ids than the model's. There the same pass keeps at each position the last piece of the model's
encoding up to it: of the pieces that end there, the one that agrees with the last piece before it. Two neighbours agree if the model's merges of their joint text give just these two,
which the derivations of both tell; a row of pieces is the model's encoding if all neighbours agree.

Where no piece holds two characters side by side, nothing is ever encoded across them; text is cut there into units that are encoded once (see ``units``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, units

#: Fixed values of the SentencePiece format: the sign for a space, and what an unknown character costs below the least score.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Bytes encoded at once.
BLOCK = 1 << 20
#: Units and pairs of neighbours that a worker remembers; others are worked out again.
UNITS, PAIRS = 250_000, 1 << 17


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file: (id, piece, score) of the pieces, byte pieces by byte, the unknown id, all pieces as bytes."""

    pieces: list[tuple[int, str, float]]
    byte_ids: dict[int, int]
    unknown: int
    decoded: list[bytes]
    dummy_prefix: bool
    key: str
    bpe: bool = False


def load_model(path: str) -> Model:
    """Read a ``.model`` file whose normaliser is the identity."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        data = file.read()
    whole = proto.ModelProto.FromString(data)
    spec, kind = whole.normalizer_spec, whole.trainer_spec.model_type
    if kind not in (proto.TrainerSpec.UNIGRAM, proto.TrainerSpec.BPE) or any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in whole.pieces):
        raise ValueError(f"{path}: only unigram and BPE models without pieces of the user are read")
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError(f"{path}: only models with the identity normaliser are read")
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces, bytes_, decoded = [], {}, []
    for i in range(len(sp)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i):
            decoded.append(b"")
        elif sp.is_unknown(i):
            decoded.append(" ⁇ ".encode())
        else:
            decoded.append(piece.replace(MARK, " ").encode())
            if not sp.is_unused(i):
                pieces.append((i, piece, sp.get_score(i)))
    return Model(pieces, bytes_, sp.unk_id(), decoded, spec.add_dummy_prefix, f"{path}:{zlib.crc32(data)}", kind == proto.TrainerSpec.BPE)


def _joins(model: Model) -> np.ndarray:
    """Whether two bytes side by side may be in one piece: of ASCII characters those that a piece holds side by side; all bytes beyond are one class (128), of which any two may."""
    out = np.zeros((129, 129), dtype=bool)
    place = lambda c: 32 if c == MARK else min(ord(c), 128)
    for _, piece, _ in model.pieces:
        for a, b in zip(piece, piece[1:]):
            out[place(a), place(b)] = True
    out[128, 128] = True
    if not model.byte_ids:
        # Unknown characters in a row have one id in common.
        single = {p for _, p, _ in model.pieces if len(p) == 1}
        lone = [i for i in range(128) if (MARK if i == 32 else chr(i)) not in single] + [128]
        out[np.ix_(lone, lone)] = True
    return out


class Encoder:
    """Encodes and decodes with a model; remembers the ids of the units it has seen."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in model.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.singles = {p for _, p, _ in model.pieces if len(p) == 1}
        self.least = min((s for _, _, s in model.pieces), default=0.0) - UNKNOWN_PENALTY
        self.joins = _joins(model)
        self.pool = units.UnitPool(self._units, [], UNITS)
        self.said = np.frombuffer(b"".join(model.decoded), dtype=np.uint8)
        self.length = np.array([len(x) for x in model.decoded], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The ids of the best path through ``text``, which has marks for spaces, and its score."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        singles, least = self.singles, self.least
        done = 0  # up to here unknown characters have been considered
        for end, (size, i, score) in self.automaton.iter(text):
            while done < end:
                done += 1
                if text[done - 1] not in singles and best[done - 1] + least > best[done]:
                    best[done], back[done] = best[done - 1] + least, (done - 1, -1)
            start = end + 1 - size
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (start, i)
        while done < n:
            done += 1
            if text[done - 1] not in singles and best[done - 1] + least > best[done]:
                best[done], back[done] = best[done - 1] + least, (done - 1, -1)
        return self._spelled(text, back), best[n]

    def _spelled(self, text: str, back: list[tuple[int, int]]) -> list[int]:
        """The ids on the way back from the end; -1 stands for a character that is no piece."""
        out: list[int] = []
        at = len(text)
        while at:
            start, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.model.byte_ids:
                out.extend(self.model.byte_ids[b] for b in reversed(text[start:at].encode()))
            elif not (out and out[-1] == self.model.unknown):
                out.append(self.model.unknown)
            at = start
        return out[::-1]

    def path(self, text: str) -> list[int]:
        return self.viterbi(text)[0]

    def _units(self, cut: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.path(u.decode().replace(" ", MARK)) for u in cut]
        return np.array([i for f in found for i in f], dtype=np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and the place where each begins (one more at the end); empty texts have none."""
        mark, lead = MARK.encode(), b" " if self.model.dummy_prefix else b""
        data = units.joined([lead + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts])
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = np.minimum(raw, 128)
        start = np.append(True, ~self.joins[kind[:-1], kind[1:]]) if len(raw) else np.zeros(0, dtype=bool)
        edge = raw == units.EDGE
        start[edge] = True
        start[1:][edge[:-1]] = True
        starts = np.flatnonzero(start)
        ids, sizes = self.pool.ids(data, starts)
        return ids.astype("<i4"), units.by_text(data, starts, sizes)

    def encode(self, text: str | None) -> np.ndarray:
        """A text's ids; null and empty texts have none."""
        return self.encode_all([text.encode() if text else b""])[0]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of ids whose places ``at`` bound; a literal space mark comes back as the space that it stands for."""
        sizes = self.length[ids]
        data = self.said[units.places(self.begin[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[at].tolist()
        return [data[a + (self.model.dummy_prefix and data[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].decode(errors="replace")


class MergeEncoder(Encoder):
    """Encodes as the merges of a BPE model do: of the neighbours whose join is a piece those of the best score are joined first, the leftmost of equals."""

    def __init__(self, model: Model):
        super().__init__(model)
        # The places of the joins in the order of the merges.
        order = sorted((p for p in model.pieces if len(p[1]) > 1), key=lambda p: -p[2])
        scores = sorted({p[2] for p in order}, reverse=True)
        place = {x: float(k) for k, x in enumerate(scores)}
        self.rank = {p: place[score] for _, p, score in order}
        self.number = {p: i for i, p, _ in model.pieces}
        # Pieces that the merges of their own text don't give are never in an encoding.
        never = [p for p in self.rank if self.merged(p, len(p)) != [p]]
        for p in never:
            self.automaton.remove_word(p)
        if never:
            self.automaton.make_automaton()
        self.agreed: dict[tuple[str, str], bool] = {}

    def merged(self, text: str, seam: int) -> list[str] | None:
        """A short text's pieces by the merges themselves, or None once one joins what is on both sides of ``seam``."""
        rank, none = self.rank.get, float("inf")
        parts = list(text)
        places = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while places and (best := min(places)) < none:
            i = places.index(best)
            if i == seam - 1:
                return None
            seam -= i < seam
            parts[i] += parts.pop(i + 1)
            del places[i]
            if i:
                places[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(places):
                places[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the merges of two pieces' joint text give these two."""
        if len(self.agreed) >= PAIRS:
            self.agreed.clear()
        found = self.agreed[left, right] = self.merged(left + right, len(left)) == [left, right]
        return found

    def path(self, text: str) -> list[int]:
        """The ids of ``text``, which has marks for spaces: the pieces by which the merges encode it."""
        n = len(text)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        agreed, agree = self.agreed.get, self.agree
        done = 0  # up to here each position has its last piece; a character that is no piece stands alone
        for end, (size, i, _) in self.automaton.iter(text):
            if last[end + 1] is not None:
                continue
            while done < end:
                done += 1
                if last[done] is None:
                    last[done], back[done] = text[done - 1], (done - 1, self.number.get(text[done - 1], -1))
            start = end + 1 - size
            piece, before = text[start : end + 1], last[start]
            fits = agreed((before, piece)) if start else True
            if fits or (fits is None and agree(before, piece)):
                last[end + 1], back[end + 1] = piece, (start, i)
        while done < n:
            done += 1
            if last[done] is None:
                last[done], back[done] = text[done - 1], (done - 1, self.number.get(text[done - 1], -1))
        return self._spelled(text, back)


_encoders: dict[str, Encoder] = {}


def encoder(model: Model) -> Encoder:
    if model.key not in _encoders:
        _encoders[model.key] = (MergeEncoder if model.bpe else Encoder)(model)
    return _encoders[model.key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back); one row a row of ``docs``.

    Null and empty texts have no ids and decode to the empty text. Repeated rows stay; an empty table gives an empty result; further columns are not read. A text
    with a literal space mark decodes to a space there, as the format has it, and its round_trip is false.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in common.slices(batches):
            texts = [t or b"" for t in common.utf8(batch.column(1)).to_pylist()]
            for a, b in common.text_blocks(texts, BLOCK):
                ids, at = coder.encode_all(texts[a:b])
                raw, ends = ids.tobytes(), (4 * at).tolist()
                crcs = [zlib.crc32(raw[x:y]) for x, y in zip(ends, ends[1:])]
                same = [x == y for x, y in zip(coder.decode_all(ids, at), texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"],
                )

    return common.text_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")
