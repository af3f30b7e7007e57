"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of target text (labelled good) and of raw text (all documents), give each
document the log ratio of its likelihoods, per word and times SHARPNESS, as its log importance weight. Gumbel noise
seeded by the document's id is added and the k largest keys are a sample: that draws k documents without replacement in
proportion to their weights. Two samples are read from the same keys. For the classifier, k is the number of documents
whose weight passes a cutoff that labelled rows set which took no part in the target model: clean documents stand far
above the noise and stay. For a training sample, k is any share of the accepted ones, and there the draw decides.

N-grams are single words and pairs, of the lower-cased word and of its shape (runs of small letters, capitals,
digits and each mark); a word equal to the one before counts as a repeat sign.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import read, settled
from strandlake.llm.kernels import LOW, U, chunks, mix, raw, word_bounds, word_hashes

BUCKETS = 1 << 16
#: The target model and the cutoff are fitted on at most so many labelled rows each, those of least hash.
TARGET_ROWS = 20_000
HOLDOUT_ROWS = 20_000
#: Labelled rows of this remainder (of two, by hash) fit the target model, the others set the cutoff.
FIT_PART = 0
#: Log weights are the mean log ratio of a word's n-grams times this.
SHARPNESS = 8.0
#: Share of the accepted documents that the sample has.
SAMPLE_SHARE = 0.5
REPEAT = U(0x51AB5E11CA7E60F1)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("0")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_LONG_RUN = np.zeros(256, bool)
_LONG_RUN[[c for c in range(33, 127) if not chr(c).isalnum()] + [ord("A")]] = True


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets: one row of four n-grams for each word, where each text's words begin)."""
    data, offsets = raw(texts)
    starts, ends, at = word_bounds(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, 4), np.int64), at
    core = word_hashes(LOW[data], starts, ends)
    kind = _CLASS[data]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    new[starts] = True
    new[ends[ends < len(data)]] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.concatenate([runs, [len(data)]]))
    sign = kind[runs].copy()
    sign[(length > 1) & _LONG_RUN[sign]] ^= 128
    shape = word_hashes(sign, np.searchsorted(runs, starts), np.searchsorted(runs, ends))
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    same = np.concatenate([[False], core[1:] == core[:-1]]) & ~first
    core = np.where(same, REPEAT, core)
    pair = lambda x, m: mix(np.where(first, U(m), np.concatenate([x[:1], x[:-1]])) * U(3) + x * U(0x9E3779B97F4A7C15) + U(m))
    grams = np.stack([core, pair(core, 11), mix(shape + U(5)), pair(shape, 13)], axis=1)
    return (grams >> U(48)).astype(np.int64), at


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def gumbel(ids: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise from the id; a null id has a fixed value."""
    h = mix(mix(np.where(known, ids, -1).view(np.uint64) + U(seed)) + U(1))
    return -np.log(-np.log((h >> U(12)).astype(np.float64) * 2.0**-52 + 2.0**-53))


def least_hashed(labels: DataFrame, where: str, most: int, seed: int) -> np.ndarray:
    rows = labels.where("doc_id is not null").where(where).select("doc_id").distinct()
    return np.sort(np.array([r[0] for r in rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).collect()], np.int64))


def fit_ratio(docs: DataFrame, target: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw for each bucket, both with one added. All documents count as raw text; the target
    documents are those whose ids are in target. Without any target text all ratios are 0."""

    def run(batches):
        counts, goal = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch, "t"):
                grams, at = ngrams(part["t"])
                counts += np.bincount(grams.reshape(-1), minlength=BUCKETS)
                ids = part["i"].fill_null(-1).to_numpy()
                mine = np.isin(ids, target) & part["i"].is_valid().to_numpy(zero_copy_only=False)
                goal += np.bincount(grams[np.repeat(mine, np.diff(at))].reshape(-1), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(goal[some])], names=["b", "raw", "goal"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(run, "b long, raw long, goal long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("goal").alias("goal")).toPandas()
    counts = np.ones((2, BUCKETS))
    counts[:, found["b"].to_numpy(np.int64)] += found[["goal", "raw"]].to_numpy(np.float64).T
    if counts[0].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return p[0] - p[1]


def score(batch: pa.RecordBatch, ratio: np.ndarray, seed: int, i: str = "i", t: str = "t") -> tuple[np.ndarray, np.ndarray]:
    """(log weight, Gumbel key) of each row."""
    weights = []
    for part in chunks(batch, t):
        grams, at = ngrams(part[t])
        weights.append(SHARPNESS * sums_by_text(ratio[grams].sum(axis=1), at) / np.maximum(1, np.diff(at)))
    log_weight = np.concatenate(weights) if weights else np.zeros(0)
    ids = batch[i].fill_null(-1).to_numpy().astype(np.int64)
    return log_weight, log_weight + gumbel(ids, batch[i].is_valid().to_numpy(zero_copy_only=False), seed)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, exactly, by four counting rounds over 16 bits each: no sort, and at most
    65,536 counts reach the driver in a round. None if there are fewer rows than k or k is 0."""
    if k <= 0:
        return None
    prefix = None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(column, shift)
        some = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        for r in sorted(some.groupBy(digit.alias("g")).count().collect(), key=lambda r: -r["g"]):
            if k <= r["count"]:
                prefix = r["g"]
                break
            k -= r["count"]
        else:
            return None
    return prefix


def best_cutoff(weights: np.ndarray, good: np.ndarray, cost: float = 10.0) -> float:
    """The cutoff that loses least: a lost good row costs as much as cost bad rows kept, by shares. Between two
    values the lower third of the gap is taken, towards the bad rows. -inf without bad or good rows."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum() * cost
    kept = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    best = int(np.argmin(lost + kept))
    return float(-np.inf if best == 0 else np.inf if best == len(w) else w[best - 1] + (w[best] - w[best - 1]) / 3)


class Model:
    """The fitted ratio, the seed of the noise, the smallest keys (as ordered bits) that are accepted and sampled, the
    cutoff of log weights, and how many rows pass it."""

    def __init__(self, ratio, seed, least_key, least_sampled, cutoff, drawn):
        self.ratio, self.seed, self.least_key, self.least_sampled, self.cutoff, self.drawn = ratio, seed, least_key, least_sampled, cutoff, drawn


SCORES = "doc_id long, log_weight double, key double, key_bits long"


def scores(docs: DataFrame, ratio: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            w, key = score(batch, ratio, seed)
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array(w), pa.array(key), pa.array(ordered_bits(key))], names=["doc_id", "log_weight", "key", "key_bits"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCORES)


def fit_part(labels: DataFrame) -> DataFrame:
    """labels by id (good if any row says so), with in_fit: whether an id fits the target model or sets the cutoff."""
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return label.withColumn("in_fit", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == FIT_PART)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17, share: float = SAMPLE_SHARE) -> tuple[Model, DataFrame]:
    """(model, scored rows). labels has doc_id and quality; an id labelled twice counts as good if any label says so.
    Empty and null texts have weight 0. Without labels everything is accepted."""
    label = fit_part(labels)
    ratio = fit_ratio(docs, least_hashed(label.where("in_fit"), "quality = 1", TARGET_ROWS, 1))
    scored = settled(scores(docs, ratio, seed))
    holdout = label.where("not in_fit").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(HOLDOUT_ROWS)
    rows = scored.join(holdout, "doc_id").select("log_weight", "quality").toPandas()
    cutoff = best_cutoff(rows["log_weight"].to_numpy(np.float64), rows["quality"].to_numpy() == 1) if len(rows) else -np.inf
    k = scored.where(F.col("log_weight") >= float(cutoff)).count()
    least, sampled = (2**63 - 1 if x is None else x for x in (kth_largest(scored, "key_bits", n) for n in (k, int(k * share))))
    return Model(ratio, seed, least, sampled, cutoff, k), scored


def classify(docs: DataFrame, labels: DataFrame, seed: int = 17, share: float = SAMPLE_SHARE) -> DataFrame:
    """Per row: doc_id, log_weight, gumbel_key, accepted, sampled (drawn when a share of the accepted is). Keys equal to
    the k-th are all drawn, so rows that repeat an id and a text share their fate."""
    model, scored = fit(docs, labels, seed, share)
    drawn = {"accepted": model.least_key, "sampled": model.least_sampled}
    return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), *[(F.col("key_bits") >= least).alias(name) for name, least in drawn.items()])


def keep_accepted(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs that are drawn, with all their columns (text columns as string)."""
    model, _ = fit(docs, labels, seed)
    names = docs.columns
    i, t = names.index("doc_id"), names.index("text")

    def run(batches):
        for batch in batches:
            _, key = score(pa.RecordBatch.from_arrays([batch.column(i), batch.column(t)], names=["i", "t"]), model.ratio, model.seed)
            yield batch.filter(pa.array(ordered_bits(key) >= model.least_key))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
