"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is a space; n-grams of one to three characters are hashed
to 2**16 numbers. Document frequencies cover all texts that may be learnt from (one row per task
and number is summed). The regression is trained on the driver with follow-the-regularised-leader
and elastic-net penalties, on at most about ``per_class`` texts of each language, chosen by a hash
of doc_id and text; a part of them is kept for the temperature that calibrates the scores. Prediction is
one map over whole texts, without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no labelled
text at all every text is ``und`` with score 0; with a single language it gets score 1; null
languages are not learnt; very long texts are read whole, in parts; repeated rows are judged
alike and learnt from once; other columns are not read. Languages are a small set of labels: one
row for each comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped
from quire.llm.ftrl import FTRL

BITS = 16
SIZE = 1 << BITS
UND = "und"
PART = 1 << 18
_LETTERS: list[np.ndarray] = []


def learns(doc_id: Column) -> Column:
    """Rows whose language may be learnt from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _hashed(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def n_grams(text: str | None, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a text's n-grams; both empty if it has no letter. ``part`` characters
    are counted at a time, which does not change the result."""
    total = np.zeros(SIZE, np.int64)
    text = (text or "").lower()  # as a whole: some letters lower by their neighbours
    seen = False
    space, shift = np.uint64(32), np.uint64(21)
    tail = np.full(1, space)  # the last two characters before the part; a text begins and ends with a space
    for at in range(0, len(text), part):
        code = np.frombuffer(text[at : at + part].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        seen = seen or bool(letter.any())
        code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
        if at + part >= len(text):
            code = np.r_[code, space]
        code = code[(code != space) | (np.r_[tail[-1], code[:-1]] != space)]
        one = code[code != space]
        code = np.r_[tail, code]
        two = (code[:-1] << shift) | code[1:]
        three = (two[:-1] << shift) | code[2:]
        two = two[len(tail) - 1 :]  # those that the part before has not counted
        marks = [_hashed(g + np.uint64(k * 0x5851F42D)) for k, g in enumerate((one, two, three))]
        total += np.bincount(np.concatenate(marks), minlength=SIZE)
        tail = code[-2:]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers = np.flatnonzero(total)
    return numbers, total[numbers]


def weighted(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[numbers]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE + 1 rows, the last the constants
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        numbers, counts = n_grams(text)
        if not len(numbers) or not self.languages:
            return UND, 0.0
        logits = weighted(numbers, counts, self.idf) @ self.weights[numbers] + self.weights[-1]
        p = _softmax(logits / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows kept from training."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(
    examples: Sequence[tuple[np.ndarray, np.ndarray, str]],
    idf: np.ndarray,
    *,
    epochs: int = 4,
    keep_every: int = 5,
    alpha: float = 2.0,
    l1: float = 0.02,
    l2: float = 0.02,
    seed: int = 0,
) -> Model:
    """``examples``: (numbers, counts, language); every ``keep_every``-th sets the temperature."""
    languages = sorted({e[2] for e in examples})
    label = {name: k for k, name in enumerate(languages)}
    fit = FTRL(SIZE + 1, len(languages), alpha=alpha, l1=l1, l2=l2)
    rows = [(np.r_[n, SIZE], np.r_[weighted(n, c, idf), 1.0], label[name]) for n, c, name in examples if len(n)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept, learnt = (order[::keep_every], [k for i, k in enumerate(order) if i % keep_every]) if len(rows) >= 10 * keep_every else ([], order)
    for _ in range(epochs):
        for k in rng.permutation(learnt):
            at, x, y = rows[int(k)]
            w = fit.weights(at)
            gap = _softmax(x @ w)
            gap[y] -= 1
            fit.step(at, x[:, None] * gap, w)
    weights = fit.weights()
    logits = np.array([rows[int(k)][1] @ weights[rows[int(k)][0]] for k in kept]).reshape(len(kept), len(languages))
    return Model(languages, idf, weights, _temperature(logits, np.array([rows[int(k)][2] for k in kept], int)))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts have each n-gram number, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for v in batch.column(0):
                numbers, _ = n_grams(v.as_py())
                total[numbers] += 1
                total[SIZE] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["number", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for number, n in mapped(rows.select("text"), run, "number long, n long").groupBy("number").agg(F.sum("n")).collect():
        out[number] = n
    return out[:SIZE], int(out[SIZE])


def fit_language(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = 800, **options) -> Model:
    """Fit on rows that ``learns`` admits and that have a language."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & learns(F.col("doc_id")))
    count = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return Model([], np.ones(SIZE), np.zeros((SIZE + 1, 0)), 1.0)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    # By id and text: however many texts an id has, the share that is chosen is near the rate.
    part = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    rate = F.create_map(*[F.lit(x) for name, k in sorted(count.items()) for x in (name, min(1.0, per_class / k))])
    # Repeated texts are one example.
    chosen = rows.where(part < F.element_at(rate, F.col("lang"))).select("text", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [n_grams(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0].astype(np.uint16).tobytes() for x in got], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in got], pa.binary()), batch.column(1)],
                names=["numbers", "counts", "lang"],
            )

    found = mapped(chosen, run, "numbers binary, counts binary, lang string").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["numbers"]), bytes(r["counts"])))  # rows come in any order
    examples = [(np.frombuffer(r["numbers"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.int32), r["lang"]) for r in found]
    return train(examples, idf, **options)


def languages(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = fit_language(documents, doc_id=doc_id, text=text, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    slim = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(~learns(F.col(doc_id)), F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            got = [predict(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return mapped(slim, run, "doc_id long, held_out boolean, lang_pred string, score double")
