"""Trained operators and the pipeline's stages against plain versions that go through the rows one at a time."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard

from riskpanel.llm import bpe, langid, pii, quality
from riskpanel.llm.common import written, shared_folder
from tests.llm.conftest import sentence
from tests.llm.test_dedup_rules import brute_components, brute_contamination, key, mutated
from tests.llm.test_text_models import brute_spans


def signed_hash(text):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), seed=42)))[0]


def letters_only(text):
    return re.sub(r"[\W\d_]+", " ", text.lower())


def brute_languages(rows):
    """(doc_id, held out, language) of rows (doc_id, text, lang): every block against every dictionary, none kept ready."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    least, count = {}, {}
    for (i, text, lang), out in zip(rows, held):
        # a null id has no remainder, so its row is not known to be outside the held-out ones
        if i is None or out or lang is None or not text:
            continue
        place = signed_hash(text)
        bucket = ((place % 2**64) >> 20) % langid.SLICES
        count[lang] = count.get(lang, 0) + 1
        if (lang, bucket) not in least or place < least[lang, bucket][0]:
            start = place % max(len(text) - langid.SLICE + 1, 1)
            least[lang, bucket] = place, text[start:start + langid.SLICE]
    content = {}
    for (lang, bucket) in sorted(least):
        content.setdefault(lang, []).append(letters_only(least[lang, bucket][1]))
    found = []
    for (i, text, _), out in zip(rows, held):
        best = "und"
        if text and any(c.isalpha() for c in text):
            data, sizes = letters_only(text).encode(), {}
            for lang, slices in content.items():
                words = zstandard.ZstdCompressionDict(" ".join(slices).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=langid.LEVEL)
                packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=words, write_content_size=False, write_dict_id=False)
                sizes[lang] = sum(len(packer.compress(data[at:at + langid.BLOCK])) for at in range(0, len(data), langid.BLOCK))
            best = min(sizes, key=lambda lang: (sizes[lang], -count[lang], lang)) if sizes else "und"
        found.append((key(i), out, best))
    return sorted(found)


def test_languages_by_brute_force(spark, make, odd, tmp_path):
    turn = lambda text: " ".join(w[::-1] for w in text.split())
    docs = make(odd).unionByName(make([(100 + i, sentence(i, 10 + 40 * (i % 4))) for i in range(60)], lang="en"))
    docs = docs.unionByName(make([(200 + i, turn(sentence(i, 10 + 40 * (i % 4)))) for i in range(60)], lang="ne")).unionByName(make([(300, turn(sentence(3, 2000)))], lang=None))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = sorted((key(r["doc_id"]), r["held_out"], r["lang_pred"]) for r in langid.op1_language_id(spark, str(tmp_path)).collect())
    assert got == brute_languages(rows)
    assert {g[2] for g in got} == {"en", "ne", "und"}


def brute_votes(text):
    data = text.encode()
    words = data.split()
    if not words:
        return [-1] * 7
    n, letters = len(words), sum(chr(c).isascii() and chr(c).isalpha() for c in data)
    high = [sum(c in b"#*$%&|<>{}[]=~^\\_@" for c in data) / len(data), sum(65 <= c <= 90 for c in data) / max(letters, 1),
            sum(words[i] == words[i - 1] for i in range(1, n)) / n, text.count("!") / n,
            (text.count(" | ") + text.count("###") + text.count("$$$") + text.count("***")) / n]
    low = [np.log(len(set(words)) + 1) / np.log(n + 1), np.mean([len(w) <= 3 for w in words]) if n >= 20 else 0.2]
    out = [-1 if x >= bad else 1 if x <= good else 0 for x, (bad, good) in zip(high, quality.HIGH.values())]
    return out + [-1 if x <= bad else 1 if x >= good else 0 for x, (bad, good) in zip(low, quality.LOW.values())]


def brute_features(text):
    """A dense row: every word, every pair of neighbours and the three extras one at a time."""
    out, words = np.zeros(quality.SLOTS), text.encode().split()
    if not words:
        out[0] = 1.0
        return out
    slots = []
    for w in words:
        form = bytes("A".encode()[0] if 65 <= c <= 90 else "a".encode()[0] if 97 <= c <= 122 or c >= 128 else "0".encode()[0] if 48 <= c <= 57 else c for c in w)
        short = b""
        for i, c in enumerate(form):
            short += bytes([c]) if i == 0 or form[i - 1] != c else b""
        slots.append(xxhash.xxh3_64_intdigest(short[:8] + bytes([len(w).bit_length()])) % quality.SLOTS)
    n = len(words)
    for s in slots:
        out[s] += 2.0 / n
    for a, b in zip(slots, slots[1:]):
        out[(a * 31 + b * 7 + 1) % quality.SLOTS] += 2.0 / n
    extra = {"repeated": 4 * sum(a == b for a, b in zip(words, words[1:])) / n, "variety": 4 * np.log(len(set(words)) + 1) / np.log(n + 1), "one": 1.0}
    for name, value in extra.items():
        out[xxhash.xxh3_64_intdigest(name) % quality.SLOTS] += value
    return out


def brute_quality(texts):
    """Scores: expectation-maximisation over all rows, one at a time, and gradient descent on dense rows."""
    votes = [brute_votes(t or "") for t in texts]
    post = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(500):
        chance = []
        for side in (0, 1):
            weight = [p if side == 0 else 1 - p for p in post]
            prior = [0.2, 1.0, 1.8] if side == 0 else [1.8, 1.0, 0.2]
            table = [[prior[o + 1] + sum(w for w, v in zip(weight, votes) if v[j] == o) for o in (-1, 0, 1)] for j in range(7)]
            chance.append(([[x / sum(row) for x in row] for row in table], sum(weight) + 1))
        (good, n1), (bad, n0) = chance
        odds = [np.log(n1) - np.log(n0) + sum(np.log(good[j][v[j] + 1]) - np.log(bad[j][v[j] + 1]) for j in range(7)) for v in votes]
        now = [1 / (1 + np.exp(-np.clip(o, -50, 50))) for o in odds]
        moved, post = max(abs(a - b) for a, b in zip(now, post)), now
        if moved < 1e-7:
            break
    x = np.array([brute_features(t or "") for t in texts])
    target, w, b, dw, db = np.array(post), np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 2.0 / ((x * x).sum(axis=1).mean() + 1)
    for _ in range(400):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - target
        dw, db = 0.9 * dw - 4 * rate * (x.T @ error / len(x) + 1e-5 * w), 0.9 * db - 4 * rate * error.mean()
        w, b = w + dw, b + db
    return [1 / (1 + np.exp(-np.clip(r @ w + b, -50, 50))) if (t or "").encode().split() else 0.0 for r, t in zip(x, texts)]


@pytest.fixture(scope="module")
def corpus(spark, odd):
    """Odd rows, near copies, benchmark passages, bad texts and personal data."""
    rnd = random.Random(8)
    passage = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    near = sentence(77, 100).split()
    rows = odd + [(100 + i, sentence(i, 80)) for i in range(40)] + [(150 + i, mutated(near, rnd, share)) for i, share in enumerate([0, 0.01, 0.02, 0.3])]
    rows += [(160, sentence(60, 40) + " " + passage), (161, sentence(61, 3000) + " " + passage), (162, "###$$$ " * 60), (163, "THE!! BIG!! DOG!! " * 30)]
    rows += [(164, sentence(70, 60) + " mail a.b@c.example.com"), (165, "write to x.y@z.example.org, host 10.0.0.7 " + sentence(71, 50)), (165, sentence(72, 50))]
    return rows


def test_quality_by_brute_force(make, corpus):
    docs = make(corpus)
    got, want = quality.score(docs, quality.train(docs)).collect(), brute_quality([t for _, t in corpus])
    assert [r["doc_id"] for r in got] == [i for i, _ in corpus]
    assert np.allclose([r["score"] for r in got], want, atol=1e-6)
    assert [r["kept"] for r in got] == [s >= quality.KEEP_FROM for s in want]


def entries(groups, i, text):
    """What brute_components says of one row; the size of its set tells rows of one id apart."""
    w = (text or "").lower().split()
    size = len({tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))}) if w else 0
    return [r for r in groups if r[0] == key(i) and r[1] == size]


def test_stages_by_brute_force(spark, make, corpus, tmp_path):
    import corpus_pipeline as C
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    make(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), shared_folder(spark)
    columns, work = docs.columns, dict(C.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def step(name, want):
        nonlocal docs, rows
        docs = written(work[name](spark, docs, str(tmp_path)), folder, name)
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))

    good = brute_quality([t for _, t in rows])
    step("quality_classifier", [r for r, s in zip(rows, good) if s >= quality.KEEP_FROM])
    groups = brute_components(rows)
    gone = {(i, t) for i, t in rows for *_, kept in entries(groups, i, t) if not kept}
    step("minhash_near_dedup", [r for r in rows if r not in gone])
    dirty = {i for i, *_, bad in brute_contamination(rows, items) if bad}
    assert 160 in dirty and 161 not in dirty
    step("benchmark_decontamination", [r for r in rows if key(r[0]) not in dirty])
    spans = [r["spans"] for r in pii.find_spans(docs).collect()]
    clean = []
    for (i, text), own in zip(rows, spans):
        assert {(pii.KINDS[k], a, b) for k, a, b in brute_spans(text or "")} <= {(s["kind"], s["start"], s["end"]) for s in own}
        covered, out, at = {p for s in own for p in range(s["start"], s["end"])}, "", 0
        while at < len(text or ""):
            first = [s for s in own if s["start"] == at]
            if first and at - 1 not in covered:
                out += pii.MASKS[first[0]["kind"]]
            if at not in covered:
                out += text[at]
            at += 1
        clean.append((i, out if text is not None else None))
    step("personal_data", clean)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((key(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert {"<EMAIL>", "<IP>"} <= {m for _, t in rows for m in re.findall("<[A-Z]+>", t or "")}


def test_stages_of_an_empty_table(spark, make, tmp_path):
    import corpus_pipeline as C
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, work in C.STAGES:
        assert work(spark, make([]), str(tmp_path)).count() == 0, name
