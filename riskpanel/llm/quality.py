"""Quality by weak labels: heuristic labellers vote, a label model weighs them, a hashed linear scorer learns the result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import Memo, map_rows, table, text_bytes, text_rows
from riskpanel.llm.weak import estimate, fit_linear

#: Texts that the scorer is fitted on, at most; the label model counts the votes on every text.
TRAINING_TEXTS = 6_000
SLOTS = 1 << 12
KEEP_FROM = 0.5

MARKS = b"#*$%&|<>{}[]=~^\\_@"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
ENDS = (b".", b",", b";", b":", b"?", b")")
#: (bad from, good to) of each measure that is bad when high
HIGH = {"marks": (0.02, 0.004), "upper": (0.35, 0.12), "repeated": (0.06, 0.03), "shouts": (0.1, 0.01), "bars": (0.08, 0.01)}
#: (bad to, good from) of each measure that is bad when low
LOW = {"variety": (0.55, 0.72), "short": (0.03, 0.12)}
VOTERS = (*HIGH, *LOW)


def measures(data: bytes) -> dict[str, float] | None:
    """What the labellers look at; None for a text without words."""
    words = data.split()
    n = len(words)
    if not n:
        return None
    distinct = set(words)
    letters = len(data) - len(data.translate(None, LETTERS))
    lengths = np.fromiter(map(len, words), np.int32, n)
    return {
        "marks": (len(data) - len(data.translate(None, MARKS))) / len(data),
        "upper": (len(data) - len(data.translate(None, UPPER))) / max(letters, 1),
        "repeated": sum(map(eq, words, words[1:])) / n,
        "shouts": data.count(b"!") / n,
        "bars": (data.count(b" | ") + data.count(b"###") + data.count(b"$$$") + data.count(b"***")) / n,
        "variety": np.log(len(distinct) + 1) / np.log(n + 1),
        "short": float((lengths <= 3).mean()) if n >= 20 else 0.2,  # too few words to tell
    }


def votes(data: bytes) -> list[int]:
    """1 for good, -1 for bad, 0 for no opinion, by labeller."""
    found = measures(data)
    if found is None:
        return [-1] * len(VOTERS)
    out = [-1 if found[k] >= bad else 1 if found[k] <= good else 0 for k, (bad, good) in HIGH.items()]
    return out + [-1 if found[k] <= bad else 1 if found[k] >= good else 0 for k, (bad, good) in LOW.items()]


_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> int:
    """Slot of a word's shape: classes of characters with runs cut to one, and its length to the next power of two."""
    form = _RUNS.sub(rb"\1", word.translate(_CLASSES))[:8]
    return xxhash.xxh3_64_intdigest(form + bytes([len(word).bit_length()])) % SLOTS


def features(data: bytes, shapes: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and values: shares of shapes, of pairs of neighbouring shapes, and of what repeats."""
    words = data.split()
    n = len(words)
    if not n:
        return np.array([0]), np.array([1.0])
    ids = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    slots, values = [ids], [np.full(n, 2.0 / n)]
    if n > 1:
        slots.append((ids[:-1] * 31 + ids[1:] * 7 + 1) % SLOTS)
        values.append(np.full(n - 1, 2.0 / n))
    extra = {"repeated": 4 * sum(map(eq, words, words[1:])) / n, "variety": 4 * np.log(len(set(words)) + 1) / np.log(n + 1), "one": 1.0}
    slots.append(np.array([xxhash.xxh3_64_intdigest(k) % SLOTS for k in extra]))
    values.append(np.array(list(extra.values())))
    at, where = np.unique(np.concatenate(slots), return_inverse=True)
    return at, np.bincount(where, np.concatenate(values))


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in text_bytes(batch)], pa.list_(pa.int32()))], ["votes"])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Memo(shape)
    for batch in batches:
        rows = [(votes(t), *features(t, shapes)) for t in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
             pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["place", "votes", "slots", "shares"])


def train(docs: DataFrame, training_texts: int = TRAINING_TEXTS) -> tuple[np.ndarray, float]:
    """Weights of the scorer. Votes of all texts are counted; at most `training_texts` texts of least hash are fitted."""
    rows = text_rows(docs)
    counted = map_rows(rows.select("text"), _vote_rows, "votes array<int>").groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** voters rows at most
    if not counted:
        return np.zeros(SLOTS), 0.0
    counts = np.array([r["n"] for r in counted], float)
    posterior = dict(zip((tuple(r["votes"]) for r in counted), estimate(np.array([r["votes"] for r in counted]), counts)[0]))
    bound = min(2**63 - 1, 3 * training_texts * 2**62 // int(counts.sum()))  # lets half as many again pass
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    drawn = rows.select("text", place.alias("place")).filter(F.col("place") <= bound)
    sample = map_rows(drawn, _training_rows, "place long, votes array<int>, slots array<long>, shares array<double>")
    sample = sample.orderBy("place").limit(training_texts).collect()
    target = np.array([posterior.get(tuple(r["votes"]), 0.5) for r in sample])
    return fit_linear([(r["slots"], r["shares"]) for r in sample], target, SLOTS, steps=400, rate=2.0, ridge=1e-5)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, score, kept for every row, from the weights of `train`.

    Null, empty and blank texts score 0 and are not kept. Repeated rows are repeated. Whole texts count. Other columns
    are not read, so none can clash. A model of an empty table scores every text with words 0.5.
    """
    weight, bias = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Memo(shape)
        for batch in batches:
            found = []
            for data in text_bytes(batch):
                if not data.strip():
                    found.append(0.0)
                    continue
                slots, shares = features(data, shapes)
                found.append(float(1 / (1 + np.exp(-np.clip(weight[slots] @ shares + bias, -50, 50)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([s >= keep_from for s in found], pa.bool_())], ["doc_id", "score", "kept"])

    return map_rows(text_rows(docs), work, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` whose text scores enough, unchanged and with all their columns, of any name.

    The scorer is trained on `docs`. Null, empty and blank texts go; whole texts count, however long. Rows with a null id
    are judged by their text, and repeated rows alike, so all or none of them stay. An empty table gives an empty table.
    """
    weight, bias = train(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Memo(shape)

        def good(data: bytes) -> bool:
            if not data.strip():
                return False
            slots, shares = features(data, shapes)
            return bool(1 / (1 + np.exp(-np.clip(weight[slots] @ shares + bias, -50, 50))) >= keep_from)

        for batch in batches:
            yield batch.filter(pa.array([good(t) for t in text_bytes(batch)], pa.bool_()))

    return map_rows(docs, work, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
