"""SentencePiece encoding and decoding for merge-type vocabularies (op 12), checked against the library.

Encoding keeps an agenda of adjacent symbol pairs that form a piece of the vocabulary: the best
score leaves first, of equal ones the leftmost, until no pair forms a piece; what is no piece
becomes bytes. No merge crosses two neighbouring bytes that no piece holds next to each other (a
space after another character, for one), so texts are cut there, and each distinct cutting is
encoded once a worker. Decoding gathers the bytes of the ids' pieces. Whole Arrow batches of texts
and ids then go to the sentencepiece library, and each row says whether both agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text
from lumenframe.llm.tokens import Encoder, Table
from lumenframe.llm.wordhash import CASED, blocks, column, release

SPACE = "▁"  # how pieces write a space
UNKNOWN = " ⁇ "
MERGES = 2  # the model type of merge vocabularies
_loaded: dict[str, "PieceEncoder"] = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class PieceEncoder(Encoder):
    """A vocabulary file: a path, or the bare name of a file of the public tokenizers. Shares the table of known cuttings with the other tokenizers' encoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.library_model = sp = SentencePieceProcessor(model_file=path)
        parts = dict(fields(sp.serialized_model_proto()))
        trainer, normal = (dict(fields(parts.get(k, b""))) for k in (2, 3))
        suffix, byte_fallback = trainer.get(24, 0), trainer.get(35, 0)
        self.prefix = bool(normal.get(3, 1))
        if trainer.get(3) != MERGES or suffix or not byte_fallback or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError(f"{path}: only merge-type vocabularies with bytes for unknown characters, which take texts as they are, are encoded")
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: unused pieces are not split again")
        self.id = {p: i for i, p in enumerate(names) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        shown = [byte[i] if i in byte else b"" if sp.is_control(i) else UNKNOWN.encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.spaced = np.array([p[:1] == SPACE and not s for p, s in zip(names, special, strict=True)])
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self.joins = np.zeros((256, 256), bool)
        self.joins[:, 0x80:0xC0] = True  # within a character
        for p in self.id:
            data = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.joins[data[:-1], data[1:]] = True
        self.table, self.letters = Table(), CASED

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = ~self.joins[data[:-1], data[1:]] if n else False
        begin[offsets] = True
        first = np.flatnonzero(begin[:n])
        return first, np.append(first[1:], n)[: len(first)], np.searchsorted(first, offsets)

    def library(self, new: list[str]) -> list[np.ndarray]:
        return [np.array(self.merged(p.replace(" ", SPACE)), "<u4") for p in new]

    def merged(self, text: str) -> list[int]:
        """Ids of a text as pieces write it."""
        part = list(text)
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                score = self.score.get(part[i] + part[j])
                if score is not None:
                    heapq.heappush(agenda, (-score, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size:
                continue  # one of them has grown or is gone
            part[i], part[j] = part[i] + part[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out: list[int] = []
        for p in part:
            if p:
                i = self.id.get(p)
                out += [i] if i is not None else [self.byte_id[b] for b in p.encode()]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end."""
        texts = pc.replace_substring(texts, SPACE, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        return self.encode(texts)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of runs of ids. Bytes that make no character become one replacement character each."""
        start, count = self.shown_at[ids], np.diff(self.shown_at)[ids]
        if self.prefix:  # the space before the first piece is not the text's
            told = np.flatnonzero(~self.control[ids])
            at = np.searchsorted(told, bounds[:-1])
            lead = told[at[at < len(told)]] if len(told) else told
            lead = lead[lead < bounds[1:][at < len(told)]]
            lead = lead[self.spaced[ids[lead]]]
            start, count = start.copy(), count.copy()
            start[lead] += 1
            count[lead] -= 1
        end = np.concatenate([[0], np.cumsum(count)])
        data = self.shown[np.repeat(start - end[:-1], count) + np.arange(end[-1])]
        raw_texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(end[bounds].astype(np.int64)), pa.py_buffer(data)])
        if not self.is_byte[ids].any():
            return raw_texts.cast(pa.large_string())
        out = raw_texts.to_pylist()
        for d in np.flatnonzero(np.add.reduceat(np.append(self.is_byte[ids], False), bounds[:-1]) * (np.diff(bounds) > 0)).tolist():
            own = slice(bounds[d], bounds[d + 1])
            out[d] = self.repaired(data, end[own.start : own.stop + 1], self.is_byte[ids[own]])
        return pa.array(out, pa.large_binary()).cast(pa.large_string())

    @staticmethod
    def repaired(data: np.ndarray, end: np.ndarray, is_byte: np.ndarray) -> bytes:
        """A text's bytes where each run of byte pieces is valid by itself."""
        cut = np.flatnonzero(np.diff(is_byte)) + 1
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(is_byte)], strict=True):
            run = data[end[a] : end[b]].tobytes()
            if is_byte[a]:
                text = run.decode("utf-8", "surrogateescape")
                run = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text).encode()
            out.append(run)
        return b"".join(out)


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))


def _agree(own: np.ndarray, bounds: np.ndarray, theirs: list[list[int]]) -> np.ndarray:
    return np.array([own[bounds[d] : bounds[d + 1]].tolist() == x for d, x in enumerate(theirs)], bool)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, ``ids`` array<int> and ``agrees``, whether the library gives the same ids.

    Null and empty texts have no ids; rows are independent, so repeated rows and ids give a row
    each and a null id stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            m, texts = piece_encoder(model), column(batch, "text")
            ids, bounds = m.ids(texts)
            same = _agree(ids, bounds, m.library_model.encode(texts.to_pylist(), num_threads=1))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists(ids, bounds), pa.array(same)], ["doc_id", "ids", "agrees"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, agrees boolean")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Per row of ``rows(doc_id, ids, ...)``: doc_id, ``text`` and ``agrees``, whether the library gives the same text. Null ids count as none, null elements are passed over; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, given = piece_encoder(model), column(batch, "ids")
            ids, bounds = given.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(given).to_numpy(zero_copy_only=False))])
            texts = m.texts(ids, bounds)
            same = pc.equal(texts, pa.array(m.library_model.decode(given.to_pylist()), pa.large_string())) if len(given) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), texts.cast(pa.string()), same], ["doc_id", "text", "agrees"])
        release()

    whole = F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda i: i.isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("ids")).mapInArrow(run, "doc_id long, text string, agrees boolean")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, ``ids``, the decoded ``text`` and ``agrees``, whether the library gives the same ids and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            m, texts = piece_encoder(model), column(batch, "text")
            ids, bounds = m.ids(texts)
            back = m.texts(ids, bounds).cast(pa.string())
            theirs = m.library_model.encode(texts.to_pylist(), num_threads=1)
            same = _agree(ids, bounds, theirs) & np.array(pc.equal(back, pa.array(m.library_model.decode(theirs), pa.string())))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists(ids, bounds), back, pa.array(same)], ["doc_id", "ids", "text", "agrees"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, text string, agrees boolean")


def digest(coded: DataFrame) -> DataFrame:
    """Per row of ``round_trip``: number of ids, hashes of the ids in decimals and of the decoded text, and ``agrees``."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), "agrees"
    )
