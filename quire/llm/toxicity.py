"""Toxicity by a counterfactual-regularised logistic classifier.

A text is the set of its words and word beginnings. Labelled texts that mention an identity term
also get a counterfactual: every such term swapped for another of its group. Training adds
``swap_weight`` times the squared change of the score between the two, so a term by itself moves
the score little and neutral mentions of a group are not taken for toxicity.

The classifier is fitted on the driver from at most about ``per_class`` labelled texts of each
class, chosen by a hash of doc_id; class counts cover all labels. Only the chosen texts' feature
numbers leave the executors. The list of chosen ids that is broadcast has the same bound; where ids
have so many texts that twice as many rows are found, a hash of the text chooses among them. Scoring
is one map over whole texts without a shuffle.

Defined cases: null and empty texts get the score of a text without words; labels with a null
doc_id or a null mark are left out; a doc_id counts once for each mark that it has, however often
rows repeat; if all labels are one class, or there are none, every score is near 1 (all toxic) or
0; extra columns pass through under ``drop_toxic`` and are not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped, own_name, worker_state
from quire.llm.ftrl import FTRL
from quire.llm.pretokens import Cache

WORDS = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 18
#: Identity terms in groups whose members may stand for each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("blind", "deaf", "disabled"),
    ("immigrants", "refugees", "citizens"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("noirs", "blancs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
THRESHOLD = 0.7


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word: itself, and its first four and five letters."""
    keys = {f"w{word}", f"p{word[:4]}", f"p{word[:5]}"}
    return tuple(sorted({xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) % (FEATURES - 1) + 1 for k in keys}))


def features(words: set[str]) -> np.ndarray:
    """Sorted feature numbers; 0 is the constant."""
    return np.array(sorted({0}.union(*map(word_features, words))), np.int32)


def swapped(words: set[str], groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> set[str] | None:
    """The words with each identity term replaced by the next of its group; None without any."""
    after = {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}
    return {after.get(w, w) for w in words} if words & after.keys() else None


@dataclass
class Model:
    weights: np.ndarray
    constant: float

    def score(self, total: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(total + self.constant, -30, 30))))


def train(
    examples: Sequence[tuple[np.ndarray, np.ndarray | None, int]],
    *,
    epochs: int = 5,
    swap_weight: float = 1.0,
    shift: float = 0.0,
    alpha: float = 1.0,
    l1: float = 5.0,
    l2: float = 0.1,
    seed: int = 0,
) -> Model:
    """``examples``: (features, counterfactual's features or None, label). ``shift`` is added to
    the constant and undoes a class's larger share of the chosen rows."""
    fit = FTRL(FEATURES, 1, alpha=alpha, l1=l1, l2=l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, other, label = examples[k]
            w = fit.weights(at)[:, 0]
            gap = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            fit.step(at, np.full((len(at), 1), gap), w[:, None])
            if other is not None and swap_weight:
                # Only features that the swap changes have a part in the change of the score.
                gone, new = np.setdiff1d(at, other), np.setdiff1d(other, at)
                if len(both := np.r_[gone, new]):
                    sign = np.r_[-np.ones(len(gone)), np.ones(len(new))]
                    w = fit.weights(both)[:, 0]
                    change = float((sign * w).sum())
                    fit.step(both, (2 * swap_weight * change * sign)[:, None], w[:, None])
    w = fit.weights()[:, 0]
    constant, w[0] = float(w[0]) + shift, 0.0
    return Model(w, constant)


def _examples(documents: DataFrame, chosen: DataFrame, doc_id: str, text: str, most: int) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, others = [], []
            for v in batch.column(0):
                words = words_of(v.as_py())
                other = swapped(words)
                own.append(features(words).tobytes())
                others.append(None if other is None else features(other).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(others, pa.binary()), batch.column(1)], names=["own", "other", "toxic"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")
    # Only if an id has very many texts, more rows are found than ids were chosen.
    if (n := rows.count()) > most:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(8), "text"), 11) / F.lit(float(1 << 53)) < most / n)
    rows = rows.select("text", "toxic").distinct()  # repeated documents are one example
    found = mapped(rows, run, "own binary, other binary, toxic int").collect()
    found.sort(key=lambda r: (r["toxic"], r["own"]))  # the order of rows is not fixed, the model is
    load = lambda raw: None if raw is None else np.frombuffer(raw, np.int32)
    return [(load(r["own"]), load(r["other"]), r["toxic"]) for r in found]


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    per_class: tuple[int, int] = (8000, 4000),
    **options,
) -> Model:
    """Fit on at most about ``per_class`` texts labelled (0, 1), from rows that ``learns`` admits."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learns(F.col("doc_id"))).distinct()
    count = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(count) < 2:
        share = float(count.get(1, 0) > 0)
        return Model(np.zeros(FEATURES), 30.0 if share else -30.0)
    rate = [min(1.0, per_class[k] / count[k]) for k in (0, 1)]
    part = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53))
    chosen = marked.where(part < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    return train(_examples(documents, chosen, doc_id, text, 2 * sum(per_class)), shift=float(np.log(rate[0] / rate[1])), **options)


def with_scores(documents: DataFrame, model: Model, name: str, *, text: str = "text") -> DataFrame:
    """All rows and columns plus the score."""
    schema = documents.selectExpr("*", f"cast(0 as double) `{name}`").schema
    at = documents.columns.index(text)
    live = np.flatnonzero(model.weights)
    shared = documents.sparkSession.sparkContext.broadcast((live, model.weights[live], model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, values, constant = shared.value
        weight = dict(zip(numbers.tolist(), values.tolist(), strict=True))
        known = lambda: Cache(lambda w: tuple(k for k in word_features(w) if k in weight), {}, 100_000)
        cache = worker_state(("toxicity", numbers.tobytes()), known)
        score = Model(np.zeros(0), constant).score
        for batch in batches:
            got = []
            for v in batch.column(at):
                found = set().union(*map(cache.__getitem__, words_of(v.as_py())))
                got.append(score(sum(weight[k] for k in sorted(found))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return mapped(documents, run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit_toxicity(documents, labels, doc_id=doc_id, text=text, **options)
    slim = documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    out = with_scores(slim, model, "score", text="text")
    held = F.coalesce(~learns(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Documents scored below ``threshold``, with their own columns."""
    model = fit_toxicity(documents, labels, doc_id=doc_id, text=text, **options)
    (score,) = own_name(documents, "toxic_score")
    return with_scores(documents, model, score, text=text).where(F.col(score) < threshold).select(*documents.columns)
