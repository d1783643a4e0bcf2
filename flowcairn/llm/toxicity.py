"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcairn.llm.shared import lean, materialise, worker_state

SIZES = (4, 5, 6, 7, 8)
PER_CLASS = 4_000  # labelled documents of each class that the classifier is fitted on, at most
SAMPLE_TASKS, COUNT_TASKS = 32, 8  # for the n-grams of the sample, at most 2 * PER_CLASS documents
FEATURES = 16_384
LEAST_DOCS = 3
SMOOTHING = 1.0
PENALTY = 1e-3
DECISION, GAP = 0.7, 0.3
STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _plain_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; ASCII marks and white space become single code 32."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.array([chr(i).isalnum() for i in range(128)])
    keep = (codes >= 128) | word[np.minimum(codes, 127)]
    codes = np.where(keep, codes, 32).astype(np.uint64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def ngram_codes(text: str | None, sizes=SIZES) -> np.ndarray:
    """64-bit codes of every n-gram in the whole text, with repeats."""
    codes = _plain_codes(text or "")
    out = [np.zeros(0, dtype=np.uint64)]
    total = np.ones(len(codes) + 1, dtype=np.uint64)
    for n in range(1, min(max(sizes), len(codes)) + 1):  # an n-gram's code goes on from that of its first n - 1
        total = (total[:-1] ^ codes[n - 1 :]) * STEP
        if n in sizes:
            mixed = (total ^ (total >> np.uint64(32))) * MIX
            out.append(mixed ^ (mixed >> np.uint64(29)))
    return np.concatenate(out)


def _count_partition(batches):
    """Per task: in how many documents of each class an n-gram occurs."""
    counts: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            counts[int(label)].append(np.unique(ngram_codes(text)))
    for label, parts in enumerate(counts):
        if parts:
            codes, docs = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(codes), 50_000):
                piece = codes[at : at + 50_000].view(np.int64)
                yield pd.DataFrame({"code": piece, "label": np.int32(label), "docs": docs[at : at + 50_000].astype(np.int64)})


def _vector_partition(codes: np.ndarray, ratios: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                at = _positions(codes, np.unique(ngram_codes(text)))
                rows.append((at.tolist(), ratios[at].tolist()))
            yield pd.DataFrame({"label": batch["label"].astype("float64"), "at": [a for a, _ in rows], "value": [v for _, v in rows]})

    return run


def _positions(codes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``codes`` of those of ``found`` that are there."""
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
    return at[codes[at] == found]


@dataclass
class ToxicityModel:
    """Sorted n-gram codes, their weights (log-count ratio times coefficient) and the intercept.

    Without labels of both classes nothing was learnt: there are no codes and every score is 0.
    """

    codes: np.ndarray
    weights: np.ndarray
    intercept: float
    rows: int

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """The rows with a score (double, 0 to 1) added; a null or empty text has the score of no n-gram.

        A column of that name is replaced, all others stay, as do repeated rows.
        """
        key = uuid.uuid4().hex
        shared = docs.sparkSession.sparkContext.broadcast((self.codes, self.weights))  # at most FEATURES entries
        intercept, columns = self.intercept, [c for c in docs.columns if c != score_col]
        schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(score_col, T.DoubleType())])

        def run(batches):
            state = worker_state("toxicity")
            if state.get("key") != key:
                codes, weights = shared.value
                gate = np.zeros(1 << 20, dtype=bool)
                gate[codes >> np.uint64(44)] = True
                state.update(key=key, model=(codes, weights, gate))
            codes, weights, gate = state["model"]
            np.seterr(over="ignore")  # a margin far below zero scores 0
            for batch in batches:
                scores = []
                for text in batch[text_col]:
                    found = ngram_codes(text)
                    found = found[gate[found >> np.uint64(44)]]
                    margin = intercept + float(weights[_positions(codes, np.unique(found))].sum())
                    scores.append(1.0 / (1.0 + np.exp(np.float64(min(-margin, 1e3)))))
                batch[score_col] = np.array(scores, dtype=np.float64)
                yield batch[[*columns, score_col]]

        return docs.select(*columns).mapInPandas(lean("toxicity", run), schema)


def _boundary_shift(fitted: DataFrame) -> float:
    """Move the intercept so that ``DECISION`` lies in the gap between clean and toxic margins.

    Most toxic training texts hold several insults and set the fitted boundary far from the clean ones;
    a text with one insult lies between. The boundary goes ``GAP`` of the way from the upper clean
    margins to the lower toxic ones.
    """
    margin = vector_to_array("rawPrediction")[1]
    edges = fitted.agg(
        F.percentile(F.when(F.col("label") == 0, margin), 0.995).alias("clean"),
        F.percentile(F.when(F.col("label") == 1, margin), 0.05).alias("toxic"),
    ).first()
    boundary = edges["clean"] + GAP * max(edges["toxic"] - edges["clean"], 0.0)
    return float(np.log(DECISION / (1 - DECISION)) - boundary)


def learnable(doc_id: str = "doc_id"):
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, seed: int = 7) -> ToxicityModel:
    """Learn from labelled documents outside the held-out third.

    About ``per_class`` documents of each class are used at most: those whose seeded hash lies below the
    share that they are of all labels. Their n-grams are counted by document and class, all of them; the log-count ratio of an
    n-gram is that of its smoothed shares in the two classes. The ``features`` n-grams with the largest
    chi-squared statistic go, as presence times ratio, into a logistic regression on Spark.

    Null labels and ids are ignored; a document id with several labels counts as toxic if one says so.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(learnable())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).where("label IN (0, 1)")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, min(1.0, per_class / n))]) if totals else F.lit(None)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = known.where(drawn < (share[F.col("label")] if totals else F.lit(0.0)))  # about 2 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    # The scan of all documents keeps its tasks; only the written sample, whose size is bounded, is read in few.
    rows = materialise(rows, "toxic-sample").coalesce(SAMPLE_TASKS)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float("-inf"), sum(sizes.values()))
    counts = rows.mapInPandas(lean("toxicity", _count_partition), "code long, label int, docs long").groupBy("code").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("q"),
    )
    counts = counts.where(F.col("p") + F.col("q") >= LEAST_DOCS)
    n_p, n_q = float(sizes[1]), float(sizes[0])
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    cross = p * (n_q - q) - q * (n_p - p)
    chi = cross * cross * (n_p + n_q) / F.greatest((p + q) * (n_p + n_q - p - q) * n_p * n_q, F.lit(1.0))
    ratio = F.log((p + SMOOTHING) / (n_p + 2 * SMOOTHING)) - F.log((q + SMOOTHING) / (n_q + 2 * SMOOTHING))
    best = counts.select("code", ratio.alias("ratio"), chi.alias("chi")).coalesce(COUNT_TASKS).orderBy(F.desc("chi"), "code").limit(features).toPandas()
    codes = best["code"].to_numpy(dtype=np.int64).view(np.uint64)
    by_code = np.argsort(codes)
    codes, ratios = codes[by_code], best["ratio"].to_numpy(dtype=np.float64)[by_code]
    placed = rows.mapInPandas(lean("toxicity", _vector_partition(codes, ratios)), "label double, at array<int>, value array<double>")
    n = len(codes)
    vector = F.udf(lambda at, value: SparseVector(n, at, value), VectorUDT())
    table = materialise(placed, "toxic-vectors").select("label", vector("at", "value").alias("features"))
    table = table.withColumn("weight", F.when(F.col("label") == 1, 0.5 / n_p).otherwise(0.5 / n_q) * (n_p + n_q))
    model = LogisticRegression(maxIter=60, regParam=PENALTY, standardization=False, weightCol="weight").fit(table.cache())
    shift = _boundary_shift(model.transform(table))
    table.unpersist()
    return ToxicityModel(codes, model.coefficients.toArray() * ratios, float(model.intercept) + shift, int(n_p + n_q))
