"""Language identification: multinomial logistic regression on hashed TF-IDF character n-grams.

Document frequencies come from every learning document. The weights are fitted with the
follow-the-regularised-leader rule (L1 and L2 penalties) on a balanced sample of at most about
``train_docs`` (2 * ``train_docs`` in any case) whole learning documents of distinct texts, and a temperature is then fitted on a tenth of that sample
which the weights have not seen. tf is an n-gram's share of the document's n-grams, so one pass of
table look-ups scores a text of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, drop_table, materialise, odd_constants, passes

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    max_n: int = 3
    bits: int = 15
    train_docs: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-2
    l2: float = 1e-4
    scale: float = 30.0
    pass_chars: int = 1_000_000
    seed: int = 17


@dataclass(frozen=True)
class LanguageModel:
    params: LanguageParams
    classes: list[str]
    table: np.ndarray  # idf times weight, one row an n-gram slot
    bias: np.ndarray
    temperature: float


def ngram_slots(texts: list[str | None], p: LanguageParams) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: (n, slots of all n-grams, first and end position of each text's n-grams); texts are lower-cased."""
    low = [(t or "").lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    starts = ends - lens
    mult = odd_constants(p.max_n + 1, p.seed)
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, p.max_n + 1):
        rolling = (rolling[: len(codes) - n + 1] + codes[n - 1 :]) * mult[n] if len(codes) >= n else rolling[:0]
        slots = ((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - p.bits)).astype(np.int32)
        yield n, slots, starts, np.maximum(starts, ends - n + 1)


def _document_frequencies(p: LanguageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs += len(texts)
            for lo, hi in passes([len(t or "") for t in texts], p.pass_chars):
                grams = list(ngram_slots(texts[lo:hi], p))
                for i in range(hi - lo):
                    seen = np.zeros(1 << p.bits, bool)
                    for _, slots, s, e in grams:
                        seen[slots[s[i] : e[i]]] = True
                    df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["slot", "n"])

    return run


def _vectors(p: LanguageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                slots = np.concatenate([g[1] for g in ngram_slots([t], p)])
                at, n = np.unique(slots, return_counts=True)
                rows.append((at.tolist(), (n / max(1, len(slots))).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["lang", "turn", "slots", "tf"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int, classes: int, p: LanguageParams) -> np.ndarray:
    """Weights (dims, classes) after ``epochs`` passes over (class, slots, values)."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for y, at, x in rows:
            w = weights(z[at], n[at])
            err = _softmax(x @ w)
            err[y] -= 1
            g = x[:, None] * err
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g2
    return weights(z, n)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm.

    Targets keep 1/(n+2) for the other classes, so that a sample without errors doesn't call for certainty.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    target = np.full(logits.shape, 1 / (len(y) + 2) / (logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    loss = lambda lt: -(target * np.log(np.maximum(_softmax(logits / np.exp(lt)), 1e-12))).sum(axis=1).mean()
    lo, hi, g = -3.0, 5.0, (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fitter(classes: list[str], idf: np.ndarray, p: LanguageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(classes.index(lang), turn, np.append(at, 1 << p.bits).astype(np.int64), np.append(np.asarray(tf) * idf[at] * p.scale, 1.0)) for b in batches for lang, turn, at, tf in zip(*[b.column(c).to_pylist() for c in ("lang", "turn", "slots", "tf")], strict=True)]
        rows.sort(key=lambda r: (r[1], len(r[2]), r[0]))
        fit, held = [r for r in rows if r[1] % 10], [r for r in rows if r[1] % 10 == 0]
        w = ftrl([(y, at, x) for y, _, at, x in fit], (1 << p.bits) + 1, len(classes), p)
        t = _temperature(np.array([x @ w[at] for _, _, at, x in held]).reshape(-1, len(classes)), np.array([r[0] for r in held], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["w", "t"])

    return run


def fit_language_model(docs: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Fit on ``docs(text, lang)`` (nulls do not count); None if no document has text and lang."""
    with batch_rows(docs.sparkSession):
        return _fit(docs, p)


def _fit(docs: DataFrame, p: LanguageParams) -> LanguageModel | None:
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return None
    classes = sorted(counts)
    stats = docs.select("text").mapInArrow(_document_frequencies(p), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, count = stats["slot"].to_numpy(), stats["n"].to_numpy()
    df = np.zeros(1 << p.bits)
    n = int(count[slot < 0].sum())
    df[slot[slot >= 0]] = count[slot >= 0]
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.lit(0.0)
    for c in classes:
        share = F.when(F.col("lang") == c, min(1.0, p.train_docs / len(classes) / counts[c])).otherwise(share)
    turn = F.pmod(F.xxhash64("text", F.lit(p.seed)), F.lit(1_000_000_000))
    sample = docs.withColumn("turn", turn).where(F.col("turn") < share * 1_000_000_000)
    sample = sample.groupBy("lang", "turn").agg(F.first("text").alias("text"))  # copies of a text are drawn together, and count once
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    sample = sample.withColumn("place", place).where(F.col("place") <= 2 * p.train_docs // len(classes) + 1).drop("place")
    vectors = materialise(sample.mapInArrow(_vectors(p), "lang string, turn long, slots array<int>, tf array<double>"))
    w, t = vectors.coalesce(1).mapInArrow(_fitter(classes, idf, p), "w binary, t double").first()
    drop_table(vectors)
    w = np.frombuffer(w, np.float64).reshape(-1, len(classes))
    return LanguageModel(p, classes, (w[:-1] * idf[:, None] * p.scale).astype(np.float32), w[-1].copy(), t)


def _predictor(model: LanguageModel, columns: list[str], added: tuple[str, str]):
    p, classes = model.params, np.array(model.classes, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for lo, hi in passes(batch.column(_CHARS).to_numpy(), p.pass_chars):
                part = batch.column(_TEXT)[lo:hi].to_pylist()
                logits, grams = np.zeros((hi - lo, len(classes))), np.zeros(hi - lo)
                for _, slots, s, e in ngram_slots(part, p):
                    for c in range(len(classes)):
                        run_sum = np.zeros(len(slots) + 1)
                        np.cumsum(np.take(model.table[:, c], slots), out=run_sum[1:], dtype=np.float64)
                        logits[:, c] += run_sum[np.minimum(e, len(slots))] - run_sum[np.minimum(s, len(slots))]
                    grams += e - s
                prob = _softmax((logits / np.maximum(grams, 1)[:, None] + model.bias) / model.temperature)
                best = prob.argmax(axis=1)
                for t, b, q in zip(part, best, prob[np.arange(len(best)), best], strict=True):
                    letters = t is not None and any(map(str.isalpha, t))
                    names.append(classes[b] if letters else UNDETERMINED)
                    scores.append(float(q) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, *added])

    return run


_TEXT, _CHARS = "_text_to_judge", "_chars_to_judge"


def predict_language(docs: DataFrame, model: LanguageModel | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` with its language and the calibrated probability of that, under ``names``.

    Only ``text`` is looked at, to its end however long. Null texts, and those without any letter, are ``und`` with score 0; so is
    all if no model could be fitted. Of languages of equal probability the first by name is told. Kept columns named like
    those added are replaced. Repeated rows each come back; an empty table gives an empty result.
    """
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    text = F.col("text").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(_TEXT), F.coalesce(F.length(text), F.lit(0)).alias(_CHARS))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(_predictor(model, keep, names), ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
