"""SentencePiece encoding and decoding of whole texts, by the model type that a piece file names.

The scores of a BPE file are merge ranks: neighbours whose joint piece has the best score are joined first, the leftmost of equals. A
row of pieces is what these merges give exactly if the merges keep every two neighbours of the row apart, as the first merge over a
border would happen between the two alone too. So the last piece of the first i characters follows from the pieces before it, and the
text is read from left to right like below, with one path to each place.

Other files are searched for the path of the best score (Viterbi). The search reads a text from left to right and keeps the best score of the last places only, as many as the longest piece has
characters. It commits ids as soon as the backpointers of all places that a later piece can start from meet in one boundary, so a text
of any length needs a window, not a lattice. Where no piece of the file can span two characters (a space after a word, for instance),
all paths meet by construction; such stretches are encoded once and remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty

SPACE_SIGN = "▁"


class PieceModel:
    """Pieces, scores and bytes of a model file without a rewriting normaliser."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.pieces.items()}
        proto = sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if self.merges and any(map(sp.is_unused, range(n))):
            raise ValueError("a BPE file with unused pieces: what their merges are taken apart into isn't known")
        #: pieces that are cut out of a text before anything is merged, the longest first
        self.defined = sorted((x.piece for x in proto.pieces if x.type == x.USER_DEFINED), key=len, reverse=True)
        value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [b"" if sp.is_control(i) else value.get(i, sp.id_to_piece(i).encode()) for i in range(n)]  # what each id decodes to
        self.longest = max(map(len, self.pieces), default=1)
        self.penalty = min(self.scores.values(), default=0.0) - 10.0  # of a character that no piece covers
        self.table: dict[str, float | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.scores  # score of a piece; None: only the beginning of one
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}  # neighbours that some piece spans
        self._apart: dict[tuple[str, str], bool] = {}
        #: whether some piece goes on behind a word with a space; if none does, words with their leading spaces are encoded alone
        self.spans_words = any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in self.pieces)

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if len(self.bytes) == 256 else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merge order; single characters stay where nothing joins them."""
        parts = list(text)
        ranks = [self.scores.get(a + b, -inf) for a, b in pairwise(parts)]
        while ranks and (best := max(ranks)) > -inf:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.scores.get(parts[i - 1] + parts[i], -inf)
            if i < len(ranks):
                ranks[i] = self.scores.get(parts[i] + parts[i + 1], -inf)
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges leave these two neighbours as they are; an empty `left` is the beginning of a text."""
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) >= 1_000_000:
                self._apart.clear()
            found = self._apart[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found


class StreamingViterbi:
    """Feed characters, receive ids; ties go to the path found first, that with the longer last piece."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.start, self.buffer, self.best, self.back = 0, "", [0.0], [0]  # best[i], back[i]: of the boundary i characters behind `start`
        self.done = 0  # boundaries whose outgoing pieces are known

    @property
    def window(self) -> int:
        """Characters that are held back."""
        return len(self.buffer)

    def feed(self, text: str, last: bool = False) -> list[int]:
        m = self.model
        self.buffer += text
        grow = len(self.buffer) + 1 - len(self.best)
        self.best += [-inf] * grow
        self.back += [0] * grow
        end = len(self.buffer) if last else len(self.buffer) - m.longest + 1
        ids: list[int] = []
        while self.done < end:
            self._extend(self.done)
            self.done += 1
            if self.done >= 8 * m.longest and self.done % m.longest == 0:
                cut = self._meeting()
                if cut:
                    ids += self._commit(cut)
                    end -= cut
        return ids + (self._commit(len(self.buffer)) if last and self.buffer else [])

    def _extend(self, at: int) -> None:
        """Offer the places behind `at` the pieces that start there."""
        m, buffer, best, back = self.model, self.buffer, self.best, self.back
        table, longest, absent = m.table, m.longest, m
        base, single = best[at], False
        for to in range(at + 1, min(at + longest, len(buffer)) + 1):
            score = table.get(buffer[at:to], absent)
            if score is absent:
                break
            if score is not None:
                if to == at + 1:
                    single = True
                if base + score > best[to]:
                    best[to], back[to] = base + score, at
        if not single and base + m.penalty > best[at + 1]:
            best[at + 1], back[at + 1] = base + m.penalty, at

    def _meeting(self) -> int:
        """The last boundary that every surviving path goes through: those to the places where later pieces start or end."""
        ends = {i for i in range(self.done, min(self.done + self.model.longest, len(self.best))) if self.best[i] > -inf}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.back[top])
        return ends.pop()

    def _commit(self, cut: int) -> list[int]:
        path, at = [], cut
        while at:
            path.append((self.back[at], at))
            at = self.back[at]
        ids: list[int] = []
        for a, b in reversed(path):
            piece = self.buffer[a:b]
            found = self.model.pieces.get(piece)
            ids += [found] if found is not None else self.model.ids_of(piece)
        if cut == len(self.buffer):
            self.buffer, self.best, self.back, self.done, self.start = "", [0.0], [0], 0, self.start + cut
            return ids
        base = self.best[cut]
        self.buffer, self.best, self.back = self.buffer[cut:], [b - base for b in self.best[cut:]], [max(0, b - cut) for b in self.back[cut:]]
        self.done, self.start = max(0, self.done - cut), self.start + cut
        return ids


class StreamingMerges(StreamingViterbi):
    """The same by merge order: `best` is 0 where the pieces up to a place are known, `back` the start of the last of them."""

    def __init__(self, model: PieceModel):
        super().__init__(model)
        self.before = ""  # the piece that ends at `start`

    def _extend(self, at: int) -> None:
        m, buffer, best, back = self.model, self.buffer, self.best, self.back
        table, absent = m.table, m
        before = buffer[back[at] : at] if at else self.before
        for to in range(at + 1, min(at + m.longest, len(buffer)) + 1):
            piece = buffer[at:to]
            score = table.get(piece, absent)
            if (to == at + 1 or score is not absent and score is not None) and m.apart(before, piece):
                best[to], back[to] = 0.0, at
            if score is absent:
                break

    def _commit(self, cut: int) -> list[int]:
        self.before = self.buffer[self.back[cut] : cut]
        return super()._commit(cut)


class Codec(dict):
    """Best paths. stretch -> its ids as bytes, for stretches that no piece can leave; beyond `limit` entries the memory starts anew."""

    search = StreamingViterbi

    def __init__(self, path: str, limit: int = 400_000, block: int = 1 << 16):
        super().__init__()
        self.model, self.limit, self.block = PieceModel(path), limit, block
        self.stretch = re.compile(f"{SPACE_SIGN}*[^{SPACE_SIGN}]+|{SPACE_SIGN}+")

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        pairs = self.model.pairs
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in pairs] if len(stretch) <= 64 else []
        if cuts:  # no piece spans these places, so all paths meet there
            found = b"".join([self[stretch[a:b]] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
        else:
            found = self._encoded(stretch)
        if len(stretch) <= 64:
            self[stretch] = found
        return found

    def _encoded(self, text: str) -> bytes:
        search, parts = self.search(self.model), []
        if len(text) <= self.block:
            ids = search.feed(text, last=True)
            return struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(text), self.block):
            ids = search.feed(text[at : at + self.block], last=at + self.block >= len(text))
            parts.append(struct.pack(f"<{len(ids)}I", *ids))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers; like the library, a leading space is put before a text that isn't empty."""
        if not text:
            return b""
        text = SPACE_SIGN + text.replace(" ", SPACE_SIGN)
        if self.model.spans_words:
            return self._encoded(text)
        return b"".join(map(self.__getitem__, self.stretch.findall(text)))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: runs of byte ids are read as UTF-8, control ids give nothing, the leading space goes."""
        parts = b"".join(map(self.model.raw.__getitem__, ids))
        text = parts.decode(errors="replace").replace(SPACE_SIGN, " ")
        return text[1:] if text.startswith(" ") else text


class MergeCodec(Codec):
    """Merge order, as the library encodes with a BPE file."""

    search = StreamingMerges

    def __init__(self, path: str, limit: int = 400_000, block: int = 1 << 10):  # what is fed at once is moved at every commit
        super().__init__(path, limit, block)
        self.defined = re.compile("(" + "|".join(map(re.escape, self.model.defined)) + ")") if self.model.defined else None

    def _encoded(self, text: str) -> bytes:
        if len(text) > 64:
            return super()._encoded(text)
        m = self.model
        ids = [i for p in m.merged(text) for i in ((m.pieces[p],) if p in m.pieces else m.ids_of(p))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.defined is None:
            found = super().encode(text)
        elif text:
            known, parts = self.model.pieces, self.defined.split(SPACE_SIGN + text.replace(" ", SPACE_SIGN))
            whole = (lambda t: self._encoded(t) if t else b"") if self.model.spans_words else lambda t: b"".join(map(self.__getitem__, self.stretch.findall(t)))
            found = b"".join(struct.pack("<I", known[p]) if i % 2 else whole(p) for i, p in enumerate(parts))
        else:
            found = b""
        if len(self.model.bytes) < 256:  # a run of unknown characters is one id
            ids = np.frombuffer(found, "<u4")
            again = ids == self.model.unknown
            again[1:] &= ids[:-1] == self.model.unknown
            again[:1] = False
            found = ids[~again].tobytes()
        return found


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process, of the kind that the file's model type asks for."""
    own = MergeCodec(path)
    return own if own.model.merges else Codec(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (a list) of every whole text.

    By merge order for a BPE file, the best path over the scores for others; characters that no piece covers become byte ids (the unknown id where the file has no bytes).
    Defined results: null and empty texts have no ids; null ids and repeated rows are encoded like others; an empty table gives an empty
    result; other columns are ignored. The sign U+2581 stands for a space, as in the library.
    """
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                coded = [own.encode(t) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of the ids; a null list is the empty text."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_ids, ids_crc32, text_crc32 (of the decoded text) and round_trip."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = own.encode(t)
                back = own.decode(memoryview(ids).cast("I"))
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == t))
            n, crc, back, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "text_crc32", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean")
