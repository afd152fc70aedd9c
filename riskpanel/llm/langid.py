"""Language by compression: the language whose dictionary makes the text smallest.

A dictionary is raw text of one language. Every block of a text is compressed with each dictionary on its own, so each
block counts alike, however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import map_rows, table, text_rows, texts

#: Learning sample: for each language one slice of SLICE characters for each of SLICES hash buckets of documents.
SLICES = 400
SLICE = 600
LEVEL = 6
BLOCK = 4096
#: Bits that the best language must save against the next, as a share of its size, to be sure of the answer.
MARGIN = 0.02
UNKNOWN = "und"
#: Letters, and signs such as a half or a square, which are none.
LETTER = re.compile(r"[^\W\d_]")
REST = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters, with one blank for anything else: case, marks and digits say little about the language."""
    return REST.sub(" ", text.lower())


def dictionaries(labelled: DataFrame) -> dict[str, tuple[bytes, int]]:
    """Raw dictionary and number of documents of each language. A dictionary comes from at most SLICES slices of SLICE characters.

    The slice of a bucket comes from its document of least hash, from a place that the hash chooses. Partial aggregates
    hold one slice for each language and bucket, so neither a frequent language nor the number of documents matters.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("place"))
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - SLICE + 1, F.lit(1))).cast("int") + 1
    least = rows.groupBy("lang", F.pmod(F.shiftrightunsigned("place", 20), F.lit(SLICES)).alias("bucket")).agg(
        F.min_by(F.substring(F.col("text"), start, F.lit(SLICE)), "place").alias("slice"), F.count("*").alias("n"))
    found: dict[str, list] = {}
    for r in least.orderBy("lang", "bucket").collect():
        found.setdefault(r["lang"], []).append(r)
    return {lang: (" ".join(plain(r["slice"]) for r in own).encode(), sum(r["n"] for r in own)) for lang, own in found.items()}


class Languages:
    def __init__(self, raw: dict[str, tuple[bytes, int]]):
        self.names = sorted(raw, key=lambda name: (-raw[name][1], name))
        self.packers = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(raw[name][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough; ties go to the language with most documents."""
        if not self.names or not any(found.group().isalpha() for found in LETTER.finditer(text)):
            return UNKNOWN, 0.0, False
        data = plain(text).encode()
        sizes = np.zeros(len(self.names))
        for at in range(0, len(data), BLOCK):
            block = data[at:at + BLOCK]
            sizes += [len(p.compress(block)) for p in self.packers]
        best = int(sizes.argmin())
        gap = (np.delete(sizes, best).min() - sizes[best]) / sizes[best] if len(sizes) > 1 else 1.0
        chances = np.exp(-(sizes - sizes[best]) / sizes[best] * 50)
        return self.names[best], float(1 / chances.sum()), bool(gap >= MARGIN)


def identify(docs: DataFrame, raw: dict[str, tuple[bytes, int]]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), sure for every row of `docs`; only the text is read.

    `sure` is false where the margin is too narrow. Null texts, texts without a letter and all texts if nothing was
    learned get `und`, score 0 and not sure. Whole texts count. Repeated rows are repeated.
    """
    holder: list[Languages] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(Languages(raw))
        for batch in batches:
            found = [holder[0].predict(t) for t in texts(batch)]
            names, scores, sure = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "sure"])

    return map_rows(text_rows(docs), work, "doc_id long, lang_pred string, score double, sure boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    raw = dictionaries(docs.filter(~held_out).select("text", "lang"))
    out = identify(docs, raw)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "sure")
