"""Personal data by weak supervision: labellers vote on candidate spans, a label model weighs them, a linear model decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import map_rows, replaced, table, text_rows, texts
from riskpanel.llm.weak import estimate, fit_linear, slot

KINDS = ("email", "ip", "card", "phone")
MASKS = {k: f"<{k.upper()}>" for k in KINDS}
#: Training spans of the final classifier, at most; the label model itself counts every candidate of the table.
TRAINING_SPANS = 5_000
SLOTS = 1 << 12
#: Score from which a span that no base rule found is added.
ADD_FROM = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)
AT = re.compile(r"\x20?[\[(]at[\])]\x20?", re.IGNORECASE)
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]+)+")
IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
CARD_DOTS = re.compile(r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/])")
PHONE_BARE = re.compile(r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")

# Gazetteers and cue words (fixed values)
ENDINGS = frozenset("com org net edu gov mil int info io co us uk de fr es it nl eu ca au ch at".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "30", "35", "60", "65", "62", "2")
CUES = {
    "email": frozenset("email mail contact write address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address client login from addr".split()),
    "card": frozenset("card visa credit debit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel call mobile fax contact telephone tel telefon telefono".split()),
}
AGAINST = frozenset("version v isbn issn order section chapter figure table no build release rev id doi".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _left(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed rules, sorted by start and kind.

    Each rule gives its leftmost matches that don't overlap, as its pattern would, in linear time.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = _left(text, at, end)
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the fixed rules: spelt-out addresses, long IP addresses, other separators, numbers without a plus."""
    found = []
    for m in AT.finditer(text):
        start = _left(text, m.start(), 0)  # a bracket ends the walk, so no character is passed twice
        domain = SPELT_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            found.append((0, start, domain.end()))
    found += [(1, m.start(), m.end()) for m in IP6.finditer(text)]
    found += [(2, m.start(), m.end()) for m in CARD_DOTS.finditer(text) if luhn(only_digits(m.group()))]
    found += [(3, m.start(), m.end()) for m in PHONE_BARE.finditer(text)]
    out, taken, i, end = [], sorted((s, e) for _, s, e in base), 0, 0
    reach = 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], s[0])):
        while i < len(taken) and taken[i][0] < stop:
            reach = max(reach, taken[i][1])
            i += 1
        if start >= reach and start >= end:
            out.append((kind, start, stop))
            end = stop
    return out


def votes_of(text: str, span: tuple[int, int, int], base: bool) -> tuple[list[int], list[str]]:
    """The labellers' votes on a span and the features of the final classifier."""
    kind, start, end = span
    name, value = KINDS[kind], text[start:end]
    before, after = text[max(0, start - 40):start], text[end:end + 20]
    words = re.findall(r"[^\W\d_]+", before.lower())
    digits = only_digits(value)
    if kind == 0:
        known = value.rpartition(".")[2].strip(")] ").lower() in ENDINGS
    elif kind == 1:
        known = ":" in value or not value.lstrip("0").startswith(("127.", "255."))
    elif kind == 2:
        known = digits.startswith(ISSUERS)
    else:
        known = value.startswith("+") or digits[:1] not in ("0", "1")
    cue = any(w in CUES[name] for w in words)
    doubt = any(w in AGAINST for w in words[-2:])
    edges = before[-1:] + after[:1]
    joined = any(c.isalnum() or c in "_/=" for c in edges)
    dull = bool(digits) and len(set(digits)) <= 2 and kind >= 2
    votes = [1 if base else 0, 1 if known else -1, 1 if cue else -1 if doubt else 0, -1 if joined else 1, -1 if dull else 1]
    features = [f"kind {name}", f"{name} base {base}", f"{name} known {known}", f"{name} joined {joined}", f"{name} dull {dull}",
                f"{name} digits {len(digits)}", f"{name} before {words[-1] if words else ''}", f"{name} edges {edges}"]
    return votes, features


def _candidates(text: str) -> Iterator[tuple[tuple[int, int, int], bool]]:
    if not ANY.search(text):
        return
    base = base_spans(text)
    for span in base:
        yield span, True
    for span in more_spans(text, base):
        yield span, False


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, votes, order, features = [], [], [], []
        for text in texts(batch):
            for span, base in _candidates(text):
                v, f = votes_of(text, span, base)
                kinds.append(span[0])
                votes.append(v)
                features.append(f)
                order.append(xxhash.xxh3_64_intdigest(f"{span} {text[span[1]:span[2]]} {len(text)} {v} {f}") >> 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(votes, pa.list_(pa.int32())), pa.array(order, pa.int64()), pa.array(features, pa.list_(pa.string()))],
            ["kind", "votes", "place", "features"])


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the span classifier: votes of all candidates are counted, at most TRAINING_SPANS distinct ones of least hash are fitted.

    The number of distinct candidates bounds the hash, so that about half as many again pass and reach the driver's sort.
    """
    rows = map_rows(docs.select("text"), _vote_rows, "kind int, votes array<int>, place long, features array<string>")
    counted = rows.groupBy("kind", "votes").agg(
        F.count("*").alias("n"), F.approx_count_distinct("place").alias("distinct")).collect()  # kinds times vote patterns at most
    posterior = {}
    for kind in range(len(KINDS)):
        own = [r for r in counted if r["kind"] == kind]
        votes = np.array([r["votes"] for r in own]).reshape(len(own), 5)
        for r, p in zip(own, estimate(votes, np.array([r["n"] for r in own], float))[0]):
            posterior[kind, tuple(r["votes"])] = p
    bound = min(2**63 - 1, 3 * TRAINING_SPANS * 2**62 // max(1, sum(r["distinct"] for r in counted)))
    drawn = rows.filter(F.col("place") <= bound).dropDuplicates(["place"])  # copies of a span are alike in all columns
    sample = drawn.orderBy("place").limit(TRAINING_SPANS).collect()
    fitted = [([slot(f, SLOTS) for f in r["features"]], [1.0] * len(r["features"])) for r in sample]
    target = np.array([posterior[r["kind"], tuple(r["votes"])] for r in sample])
    return fit_linear(fitted, target, SLOTS)


def _decide(model: tuple[np.ndarray, float], add_from: float):
    weight, bias = model

    def spans(text: str) -> list[dict]:
        out = []
        for span, base in _candidates(text):
            margin = bias + sum(weight[slot(f, SLOTS)] for f in votes_of(text, span, base)[1])
            score = float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))
            if base or score >= add_from:
                out.append({"kind": KINDS[span[0]], "start": span[1], "end": span[2], "base": base, "score": score})
        return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))

    return spans


SPAN = "struct<kind: string, start: int, end: int, base: boolean, score: double>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base, score) for every row, sorted by start and kind.

    Spans of the fixed rules are always there; others are there if the classifier's score reaches `add_from`. Null and
    empty texts have none; repeated rows are repeated; with an empty table there is nothing to learn and nothing to find.
    Other columns are not read, so none can clash. Time is linear in the length of a text.
    """
    rows = text_rows(docs)
    spans = _decide(train(rows), add_from)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([spans(t) for t in texts(batch)], _SPAN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "spans"])

    return map_rows(rows, work, f"doc_id long, spans array<{SPAN}>")


def masked(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by the mask of its first."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at:s["start"]], MASKS[s["kind"]]]
        at = max(at, s["end"])
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """The rows of `docs` with personal data in `text` replaced; null texts stay null, other columns are as they were.

    The span classifier is trained on `docs`. Empty texts stay empty, null ids and repeated rows stay; of spans that
    overlap, the first gives the mask. Whole texts are read. An empty table gives an empty table.
    """
    spans = _decide(train(text_rows(docs)), add_from)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (v.as_py() for v in batch.column("text"))
            yield replaced(batch, "text", pa.array([None if t is None else masked(t, spans(t)) for t in found], pa.string()))

    return map_rows(docs, clean, docs.schema)


def told(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return out.select("doc_id", *(counted(F.col("base"), k) for k in KINDS), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      told(F.col("spans")).alias("spans"))
