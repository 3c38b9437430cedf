"""Quality of texts by Naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import fresh
from chronotape.llm.wordhash import Words, mixed, slices

#: Half of the features are n-grams of 1 to 4 bytes, half are single words and word pairs, all by hash.
BUCKETS = 1 << 17
#: At most this many labelled documents of each class are fitted.
FIT_ROWS = 3000
#: They have at most so many features of each class together (4 bytes each).
FIT_FEATURES = 1 << 26
ACCEPT = 0.7
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
FOLDS = 3


def indicators(words: Words, row: int, seen: np.ndarray) -> np.ndarray:
    """The features that occur in one text, in rising order; `seen` is all false before and after."""
    data = words.data[words.offsets[row] : words.offsets[row + 1]]
    code = data.astype(np.uint32)
    found = [code]
    for n in (2, 3, 4):
        if len(data) >= n:
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
            spread = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16)
            found.append(spread % np.uint32(BUCKETS // 2 - 256) + np.uint32(256))
    h = words.hashes[words.first[row] : words.first[row + 1]]
    if len(h):
        half = np.uint64(BUCKETS // 2)
        found.append((h % half + half).astype(np.uint32))
        found.append((mixed(h[:-1] * np.uint64(3) + h[1:]) % half + half).astype(np.uint32))
    at = np.concatenate(found)
    seen[at] = True
    out = np.flatnonzero(seen)
    seen[at] = False
    return out


def featured(column: pa.Array) -> Iterator[np.ndarray]:
    """The features of every text of the column."""
    seen = np.zeros(BUCKETS, bool)
    for _, count, words in slices(column):
        for row in range(count):
            yield indicators(words, row, seen)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logarithm of how much likelier a feature is in the documents marked +1 than in the others."""
    counts = []
    for sign in (1, -1):
        c = np.full(BUCKETS, SMOOTHING)
        for r, mark in zip(rows, y, strict=True):
            if mark == sign:
                c[r] += 1
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def normed(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[row]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the least hinge loss, by dual coordinate descent over the scaled indicators."""
    values = [normed(r, ratios) for r in rows]
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    # A row's curvature: its squared length, and 1 for the bias. Classes weigh the same in all.
    curve = np.array([float(x @ x) for x in values]) + 1.0
    most = {s: COST * len(y) / (2.0 * max(1, int((y == s).sum()))) for s in (1, -1)}
    order = np.random.RandomState(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            slope = y[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / curve[i], 0.0), most[y[i]])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weights[rows[i]] += step * values[i]
                bias += step
    return weights, bias


def margin(row: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return float(weights[row] @ normed(row, ratios)) + bias


def calibrated(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve of the margins, by Newton steps."""
    share = float((weight * good).sum() / weight.sum())
    a, b = 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = weight * (p - good)
        h = weight * p * (1 - p) + 1e-9
        gradient = np.array([g @ margins + 1e-3 * a, g.sum()])
        hessian = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fitted(rows: list[np.ndarray], good: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Ratios, weights, bias, slope and offset. Margins that rows get from the other folds' models are calibrated."""
    y = np.where(good, 1, -1)
    if len(set(y.tolist())) < 2:
        share = min(max(prior, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share)))
    fold = np.zeros(len(rows), int)
    for s in (1, -1):
        mine = np.flatnonzero(y == s)
        fold[mine] = np.arange(len(mine)) % FOLDS
    out = np.zeros(len(rows))
    for k in range(FOLDS):
        learn, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = [rows[i] for i in learn]
        ratios = log_count_ratios(part, y[learn])
        weights, bias = descend(part, y[learn], ratios)
        for i in rest:
            out[i] = margin(rows[i], ratios, weights, bias)
    ratios = log_count_ratios(rows, y)
    weights, bias = descend(rows, y, ratios)
    weight = np.where(good, prior / max(1, good.sum()), (1 - prior) / max(1, (~good).sum())) * len(rows)
    slope, offset = calibrated(out, good.astype(float), weight)
    return ratios, weights, bias, slope, offset


class Model:
    """The fitted classifier: BUCKETS ratios and scaled weights, and the logistic curve of its margins."""

    def __init__(self, ratios, weights, bias, slope, offset):
        self.squares = np.square(ratios).astype(np.float32)
        self.scaled = (ratios * weights).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def score(self, row: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[row].sum(dtype=np.float64)))
        at = float(self.scaled[row].sum(dtype=np.float64)) / max(1e-12, length) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * at + self.offset, -40, 40))))


def fit(docs: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Model:
    """A model from the texts of `docs` and marks (doc_id, good: boolean).

    Of each class the `fit_rows` documents of the smallest id hashes are fitted, of these the first that have
    `fit_features` features together, so twice that meets in one task; the share of good documents among all
    marks is the prior. Several marks of one document count as their majority (good on a tie), and of several
    texts of one id the one whose features have the smallest digest is fitted: rows in any order give the
    same model. Without marks every score is 0.5, with one class only it is that class's share.
    """
    per_doc = marks.where("doc_id is not null and good is not null").groupBy("doc_id").agg(
        (F.avg(F.col("good").cast("int")) >= 0.5).alias("good")
    )
    known = per_doc.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    total, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0))).first()
    prior = good / total if total else 0.5
    chosen = [known.where("good" if x else "not good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for x in (True, False)]
    sample = chosen[0].unionByName(chosen[1])

    def features(batches):
        for batch in batches:
            lists = list(featured(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("good"), pa.array([x.astype(np.int32).tobytes() for x in lists], pa.binary())],
                names=["doc_id", "good", "features"],
            )

    def learn(batches):
        got: dict = {}
        for batch in batches:
            for i, g, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "good", "features")), strict=True):
                got[i] = (g, np.frombuffer(x, np.int32))
        order = sorted(got)
        out = fitted([got[i][1] for i in order], np.array([got[i][0] for i in order], bool), prior)
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in out[:2]] + [pa.array([x]) for x in out[2:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["ratios", "weights", "bias", "slope", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    # The sample's ids are bounded by 2 * fit_rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(features, f"doc_id {kind}, good boolean, features binary")
    one_text = F.min(F.struct(F.sha2("features", 256).alias("digest"), "features")).alias("text")
    first = Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # A row per chosen id, whatever number of rows the id has.
    rows = rows.groupBy("doc_id", "good").agg(one_text).select("doc_id", "good", "text.features")
    rows = rows.withColumn("held", F.sum(F.octet_length("features") / 4).over(first)).where(F.col("held") <= fit_features).drop("held")
    one = rows.repartition(1).mapInArrow(learn, "ratios binary, weights binary, bias double, slope double, offset double").first()
    if one is None:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))))
    return Model(np.frombuffer(one["ratios"]), np.frombuffer(one["weights"]), one["bias"], one["slope"], one["offset"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with a score in (0, 1) of the whole text, in a column named score.

    A score depends on the text alone; blank and null texts get the score of no features (the bias). Rows of
    equal text get equal scores; an empty table gives an empty result.
    """
    score, = fresh(docs, "score")
    names = docs.columns

    def run(batches):
        for batch in batches:
            scores = [model.score(x) for x in featured(batch.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score])

    schema = docs.select("*", F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, schema)


def training_marks(labels: DataFrame) -> DataFrame:
    """Quality labels outside the held-out quarter: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", (F.col("quality") == 1).alias("good"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a classifier fitted on their labels accepts, whole rows."""
    score, = fresh(docs, "score")
    rows = scored(docs, fit(docs, training_marks(labels)))
    return rows.where(F.col(score) >= ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])
