"""Toxicity by a factorization machine over hashed terms (op 8).

Terms are words (letters of any script) and two prefixes of longer ones, all hashed to a fixed
number of slots; a document is the set of its slots. The machine adds pairwise interactions of
latent slot vectors to linear weights, so a pair of terms can count for more than its parts. No
term is left out: a slot enters with a scale between FLOOR and 1 by how far its documents' labels
are from the common rate, so that the many indifferent words move little by themselves and still
take part in interactions. It is fitted on at most ``SAMPLE_ROWS`` labelled rows; every document
is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import crc_mod, id_and_text, written
from lumenframe.llm.wordhash import LETTERS, SPACES, U, blocks, column, words

SAMPLE_ROWS = 20_000  # labelled rows that a fit uses at most, by hash order of their ids
SLOT_BITS = 18
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 15, 128, 0.1, 1e-4, 11
FLOOR, FAR = 0.08, 5.0  # least scale of a slot, and the deviation from which on it is 1
PREFIXES = (5, 7)
THRESHOLD = 0.7

_letters = LETTERS.copy()
_letters[0x80:0x9F] = LETTERS[0xA0:0xBF]  # second bytes of Latin capitals count as those of small letters
_spaces = SPACES.copy()
_spaces[:128] = [not chr(c).isalpha() for c in range(128)]


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) of all words and prefixes, in order of rows."""
    w = words(texts, _letters, _spaces)
    doc, length = w.doc(), w.last - w.first
    rows = np.concatenate([doc, *(doc[length > n] for n in PREFIXES)])
    term = np.concatenate([w.hash, *(w.prefix(n)[length > n] for n in PREFIXES)])
    pair = np.unique(rows << SLOT_BITS | (term >> U(64 - SLOT_BITS)).astype(np.int64))
    return pair >> SLOT_BITS, pair & (1 << SLOT_BITS) - 1


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, at = slots(texts)
        n = len(texts)
        out = self.bias + np.bincount(doc, self.weight[at], n)
        for f in range(FACTORS):
            v = self.factor[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def scales(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each slot, by the deviation of the log odds of its documents."""
    at = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    pos = np.bincount(at, np.repeat(y, [len(d) for d in docs]), 1 << SLOT_BITS)
    neg = np.bincount(at, minlength=1 << SLOT_BITS) - pos
    a, b = pos + 0.5, neg + 0.5
    odds = np.log(a / (y.sum() - pos + 0.5)) - np.log(b / (len(y) - y.sum() - neg + 0.5))
    return np.clip((odds / np.sqrt(1 / a + 1 / b) / FAR) ** 2, FLOOR, 1).astype(np.float32)


def fit(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """Adagrad on the logistic loss; ``docs`` hold slots. Without both labels the model is the bare rate."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias, weight = float(np.log(rate / (1 - rate))), np.zeros(1 << SLOT_BITS, np.float32)
    factor = np.zeros((1 << SLOT_BITS, FACTORS), np.float32)
    if not len(y) or y.min() == y.max():
        return Model(bias, weight, factor)
    rng, scale = np.random.default_rng(SEED), scales(docs, y)
    factor = rng.normal(0, 0.05, factor.shape).astype(np.float32)
    square_b, square_w, square_v = 1e-6, np.full(weight.shape, 1e-6, np.float32), np.full(factor.shape, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(y)), RATE / (1 + epoch / 10)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            doc = np.repeat(np.arange(len(rows)), [len(docs[r]) for r in rows])
            used, where = np.unique(np.concatenate([docs[r] for r in rows]), return_inverse=True)
            by_doc = lambda x: np.bincount(doc, x, len(rows))  # noqa: B023, E731
            by_slot = lambda x: np.bincount(where, x, len(used))  # noqa: B023, E731
            x = scale[used][where]
            v = factor[used][where] * x[:, None]
            total = np.stack([by_doc(v[:, f]) for f in range(FACTORS)], axis=1)
            logit = bias + by_doc(weight[used][where] * x) + 0.5 * ((total**2).sum(1) - by_doc((v * v).sum(1)))
            g = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[rows]) / len(rows)
            gx = g[doc] * x
            gw = by_slot(gx) + DECAY * weight[used]
            step = (total[doc] - v) * gx[:, None]
            gv = np.stack([by_slot(step[:, f]) for f in range(FACTORS)], axis=1) + DECAY * factor[used]
            square_b += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(square_b)
            square_w[used] += gw**2
            weight[used] -= rate * gw / np.sqrt(square_w[used])
            square_v[used] += gv**2
            factor[used] -= rate * gv / np.sqrt(square_v[used])
    return Model(bias, weight * scale, factor * scale[:, None])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        doc, at = slots(column(batch, "text"))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        parts = [at[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array(parts, pa.binary())], names=["doc_id", "y", "at"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose id hash allows it.

    ``labels(doc_id, toxic)``: null ids and labels are passed over, of repeated ids the largest
    label counts, and ids that ``docs`` lacks add nothing. Without both labels the model is the
    bare rate. At most ``SAMPLE_ROWS`` ids, the first by hash, are used, each by the smallest of its texts.
    """
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .where(crc_mod(F.col("doc_id"), 3) != 1)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    texts = id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = written(texts.mapInArrow(_encode, "doc_id long, y int, at binary"), "labelled").orderBy("doc_id").toArrow()  # at most SAMPLE_ROWS
    return fit([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("at")], rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; null text counts as empty and gets the model's rate.

    All other columns pass through; columns named score or predicted are replaced.
    """
    keep = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = batch.set_column(batch.schema.get_field_index("text"), "text", column(batch, "text").fill_null(""))
            parts = [model.scores(column(b, "text")) for b in blocks(iter([filled]))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            batch = batch.append_column("score", pa.array(s))
            yield batch.append_column("predicted", pa.array((s >= THRESHOLD).astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(run, f"{schema}, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all columns as they are, whatever their names; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = pa.RecordBatch.from_arrays([column(batch, "text").fill_null("")], names=["text"])
            parts = [model.scores(column(b, "text")) for b in blocks(iter([filled]))]
            yield batch.filter(pa.array(np.concatenate([*parts, np.zeros(0)]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
