"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed on the executors over whole texts. The trees are fitted on a bounded sample of labelled rows (SAMPLE rows, the
smallest hashes of doc_id, so reruns agree), by histograms of binned statistics with logistic loss; they are complete binary trees held
in flat arrays, which numpy traverses for a whole batch at once. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have the statistics of an empty text and are scored like any other; null doc_ids are scored and
count as held out; label rows with a null quality or doc_id are ignored; of labels that contradict each other for one doc_id the smallest
holds, and of repeated doc_ids one text is learnt from; without any usable label the score is 0.5 for all; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import bound_arrow, free_name, own_columns

#: Labelled rows to fit on, at most.
SAMPLE = 20_000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 2.0

NAMES = (
    "log_bytes log_words mean_word long_words upper lower digits spaces punctuation bangs marks bars angles brackets high_bytes controls "
    "lines mean_line blank_lines unique_lines unique_words top_word top5_words sentence_ends capital_words marked_words digit_words short_words entropy bigram_repeat"
).split()

_CLASS = np.zeros((256, 11))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\f\v", b".,;:'\"()-", b"!?", b"#$%&*@^~+=_", b"|", b"<>{}\\", b"[]", range(128, 256))):
    _CLASS[list(_bytes), _k] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES."""
    raw = (text or "").encode()
    if not raw.strip():
        return [float(np.log1p(len(raw)))] + [0.0] * (len(NAMES) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digits, spaces, punctuation, bangs, marks, bars, angles, brackets, high = (counts @ _CLASS / n).tolist()
    words, lines = raw.split(), raw.split(b"\n")
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    lasts = np.bincount(np.fromiter((x[-1] for x in words), np.uint8, w), minlength=256)
    firsts = np.bincount(np.fromiter((x[0] for x in words), np.uint8, w), minlength=256)
    common = Counter(words)
    top = sorted(common.values(), reverse=True)[:5]
    share = counts[counts > 0] / n
    pairs = set(zip(words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(w)), n / w, float((sizes > 14).mean()), upper, lower, digits, spaces, punctuation, bangs, marks, bars, angles, brackets, high,
        float(counts[:9].sum() + counts[14:32].sum()) / n, float(np.log1p(len(lines))), n / len(lines), lines.count(b"") / len(lines), len(set(lines)) / len(lines),
        len(common) / w, top[0] / w, sum(top) / w, float(lasts[[33, 46, 63]].sum()) / w, float(firsts[65:91].sum()) / w, float(lasts[[33, 35, 36, 37, 38, 42, 64, 94, 126]].sum()) / w,
        float(firsts[48:58].sum()) / w, float((sizes < 3).mean()), float(-(share * np.log2(share)).sum()), 1 - len(pairs) / max(1, w - 1),
    ]


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: inner nodes' features and thresholds, and the leaves' values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Boosts on histograms: each level of a tree takes, for each node, the split of best gain over the bins of all statistics."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    rate_of_1 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_1 / (1 - rate_of_1)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    width, k_all = bins + 1, np.arange(x.shape[1])
    total = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * x.shape[1] + k_all) * width + binned
            g, h = (np.bincount(slot.ravel(), np.repeat(v, x.shape[1]), n * x.shape[1] * width).reshape(n, x.shape[1], width).cumsum(2) for v in (grad, hess))
            ga, ha = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (ga - g) ** 2 / (ha - h + l2) - ga**2 / (ha + l2)
            gain[(h < 1) | (ha - h < 1)] = 0
            best = gain.reshape(n, -1).argmax(1)
            for i, b in enumerate(best):
                k, cut = divmod(int(b), width)
                if gain[i, k, cut] > 1e-6 and cut < len(edges[k]):
                    out.feature[t, first + i], out.threshold[t, first + i] = k, edges[k][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
        g, h = (np.bincount(node - inner, v, leaves) for v in (grad, hess))
        out.leaf[t] = -rate * g / (h + l2)
        total += out.leaf[t][node - inner]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True if crc32 of doc_id as text leaves no remainder by FOLDS; also for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the columns to carry, and stats, an array of the statistics."""
    bound_arrow(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = [statistics(v.as_py()) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "stats"])

    schema = StructType([*docs.select(*keep).schema.fields, StructField("stats", ArrayType(DoubleType()))])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on at most `sample` labelled documents that aren't held out."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text for each label, however often its doc_id is repeated: what the driver gets is at most the sample.
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = with_statistics(texts, ["doc_id", "quality"]).toPandas()
    rows = rows.sort_values("doc_id")
    x = np.stack(rows["stats"].to_list()) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, score_name: str = "quality_score", predicted_name: str = "quality_predicted") -> DataFrame:
    """docs with two more columns, whose names must be free: the score and whether it reaches THRESHOLD."""
    bound_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            text = batch.column(columns.index("text"))
            x = np.array([statistics(v.as_py()) for v in text]).reshape(-1, len(NAMES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*columns, score_name, predicted_name])

    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # mapInArrow can't take names with dots
    return plain.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_name, DoubleType()), StructField(predicted_name, IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs.select("doc_id", "text"), fit_on(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents (all columns, of whatever names) predicted to be of quality 1; repeated rows stay or go alike, a null text is judged as
    an empty one, an empty table gives no rows, and without any usable label (score 0.5) all stay."""
    score_name, predicted_name = free_name(docs.columns, "quality_score"), free_name(docs.columns, "quality_predicted")
    scored = score(docs, fit_on(docs, labels, sample), score_name, predicted_name)
    return scored.filter(F.col(predicted_name) == 1).select(*own_columns(docs))
