"""Language, tokens, quality, personal data and training order."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from riskpanel.llm import bpe, common, langid, ordering, pii, quality, weak
from riskpanel.llm.common import shared_folder
from tests.llm.conftest import sentence

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf", [(64, 1 << 15), (2, 8)])
def test_tree_equals_library(library, leaf, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf[0])
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf[1])
    monkeypatch.setattr(bpe, "DECODE_LEAF", 3 if leaf[0] == 2 else 1 << 16)
    codec, rnd = bpe.Codec(bpe.load_ranks(RANKS), PATTERN), random.Random(5)
    for alphabet in ("a", "ab", " \n\t", "ab '\n  s", "éß漢 1!", "thein ,.'s", "\x1c\x85\xa0 a"):
        for n in (0, 1, 2, 3, 5, 8, 13, 40, 400):
            for _ in range(5):
                text = "".join(rnd.choice(alphabet) for _ in range(n))
                packed = codec.encode(text)
                assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)
                assert codec.decode(packed) == text.encode()


@pytest.mark.parametrize("leaf", range(2, 9))
def test_split_inside_a_contraction(library, leaf, monkeypatch):
    """A cut inside 're, 've or 'll: the apostrophe left of it is a match of its own only for want of the letters that follow."""
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    codec, rnd = bpe.Codec(bpe.load_ranks(RANKS), PATTERN), random.Random(leaf)
    texts = ["".join(rnd.choice("rvel'" + more) for _ in range(rnd.randrange(40))) for more in ("", " ", "s \n", "1!") for _ in range(300)]
    for text in [*texts, "they're x", "we've y", "I'll z"]:
        assert codec.pieces(text) == regex.findall(PATTERN, text)
        packed = codec.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)


def test_token_digests(make, odd, library):
    got = sorted(tuple(r) for r in bpe.token_digests(make(odd), RANKS, PATTERN).fillna(-1, ["doc_id"]).collect())
    want = []
    for i, t in odd:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.token_digests(make([]), RANKS, PATTERN).count() == 0
    apart = bpe.decode(bpe.encode(make(odd), RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(map(str, apart.collect())) == sorted(map(str, bpe.round_trip(make(odd), RANKS, PATTERN).collect()))


def test_language(make, odd):
    learn = make([(i, sentence(i, 60)) for i in range(20)], lang="en").unionByName(make([(i, " ".join(w[::-1] for w in sentence(i, 60).split())) for i in range(30)], lang="ne"))
    raw = langid.dictionaries(learn.select("text", "lang"))
    assert sorted(raw) == ["en", "ne"] and raw["ne"][1] == 30
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(make([(50, sentence(77, 50)), (51, " ".join(w[::-1] for w in sentence(78, 50).split()))]), raw).collect()}
    assert got == {(50, "en"), (51, "ne")}
    rows = langid.identify(make(odd), raw).collect()
    assert len(rows) == len(odd)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 8) or (r["doc_id"] is None and r["score"] == 0)) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(make([]), raw).count() == 0
    assert [r["lang_pred"] for r in langid.identify(make([(1, "a b")]), langid.dictionaries(make([]).select("text", "lang"))).collect()] == ["und"]


def test_language_held_out(spark):
    out = langid.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.filter("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0


def test_label_model_finds_the_classes():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.8
    votes = np.where(rnd.random((4000, 5)) < [0.9, 0.8, 0.7, 0.6, 0.9], 1, 0) * np.where(truth, 1, -1)[:, None]
    rows, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chances = weak.estimate(rows, counts.astype(float))
    assert ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.97
    assert np.allclose(chances.sum(axis=2), 1)


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs)).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(not r["kept"] for r in bad) >= 0.95 * len(bad)


def test_quality_odd_rows(make, odd):
    model = quality.train(make(odd))
    rows = quality.score(make(odd), model).collect()
    assert len(rows) == len(odd)
    assert all(r["score"] == 0 and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert set(quality.keep_good(make(odd)).columns) == set(make(odd).columns)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in quality.keep_good(make(odd)).collect())
    assert kept == sorted((r["doc_id"] or 0, t) for r, (_, t) in zip(rows, odd) if r["kept"])
    assert quality.score(make([]), quality.train(make([]))).count() == 0


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@pytest.mark.parametrize("alphabet", ["ab@.", "a@.-1 ", "0123. ", "12 -", "+12() .-", "a@.1+ -é", "0000000.1"])
def test_base_spans(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        pii.base_spans(text)


def test_personal_data(make, odd):
    plain = "é write to ann.lee@mail.example.com or +1 (555) 010-9999, host 10.0.0.7, card 4111 1111 1111 1111"
    spelt = "contact bob (at) mail.example.org or call tel (555) 010-4477 today"
    rows = odd + [(20, plain), (21, spelt), (22, "version 300.1.1.1 and 4111 1111 1111 1112")]
    got = pii.find_spans(make(rows)).collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, rows):
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == [(pii.KINDS[k], a, b) for k, a, b in brute_spans(text or "")]
    clean = {r["doc_id"]: r["text"] for r in pii.mask(make(rows)).collect()}
    assert clean[20] == "é write to <EMAIL> or <PHONE>, host <IP>, card <CARD>" and clean[1] is None and clean[2] == ""
    assert set(pii.mask(make(rows)).columns) == set(make(rows).columns)
    assert pii.find_spans(make([])).count() == 0


def test_overlapping_spans_get_one_mask():
    spans = [{"kind": "card", "start": 2, "end": 9}, {"kind": "phone", "start": 4, "end": 12}]
    assert pii.masked("a 0123456789 b", spans) == "a <CARD> b"


def test_permutation():
    for n in (1, 2, 3, 5, 17, 100, 4097):
        assert sorted(ordering.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert not np.array_equal(ordering.permuted(np.arange(100), 100, 1), ordering.permuted(np.arange(100), 100, 2))


def test_training_order(spark, make, odd, library):
    path = f"{shared_folder(spark)}/shards"
    out = ordering.training_order(make(odd), RANKS, PATTERN, path, stride=16, shard_sequences=32)
    rows = out.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 32 and len(r["tokens"]) == 32 for r in rows)
    files = {}
    for r in out.selectExpr("shard", "slot", "_metadata.file_path as file", "_metadata.file_name as name").collect():
        files.setdefault(r["file"], []).append((r["shard"], r["slot"]))
    assert all(len({s for s, _ in v}) == 1 and [s for _, s in v] == sorted(s for _, s in v) for v in files.values())
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["seq_no"], struct.unpack("<16H", r["tokens"])[:r["n_tokens"]]))
    for i, t in odd:
        if i not in (4, None):
            assert [x for _, p in sorted(parts.get(i, [])) for x in p] == library.encode_ordinary(t or "")
    assert len(parts[4]) == 2 * -(-len(library.encode_ordinary(sentence(1, 30))) // 16)
    assert ordering.training_order(make([]), RANKS, PATTERN, path + "-none").count() == 0


def test_ascii_form_of_a_pattern():
    import regex
    find, plain = regex.compile(PATTERN).findall, bpe.ascii_form(PATTERN).findall
    rnd = random.Random(3)
    signs = [c for c in map(chr, range(128)) if not "\x1c" <= c <= "\x1f"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs if rnd.random() < 0.3 else "  \n\tab're'll'S1.,") for _ in range(rnd.randrange(40)))
        assert plain(text) == find(text)
    assert bpe.ascii_form(r"\p{Lu}+|\s+") is None and bpe.ascii_form(r"\w+") is None


def test_ascii_texts_equal_the_library(library):
    codec, rnd = bpe.Codec(bpe.load_ranks(RANKS), PATTERN), random.Random(4)
    for _ in range(500):
        text = "".join(chr(rnd.randrange(128)) if rnd.random() < 0.4 else rnd.choice("  \r\n\x1c\x1d\x1e\x1f\x0b'dlvre") for _ in range(rnd.randrange(60)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_two_tokenizers_in_one_session(spark, make, tmp_path):
    bytes_only = tmp_path / "bytes.tiktoken"
    import base64
    bytes_only.write_text("".join(f"{base64.b64encode(bytes([255 - b])).decode()} {b}\n" for b in range(256)))
    docs = make([(1, "abc")])
    for _ in range(3):
        one = bpe.encode(docs, str(bytes_only), PATTERN).first()["ids"]
        two = bpe.encode(docs, RANKS, PATTERN).first()["ids"]
        assert np.frombuffer(one, "<u4").tolist() == [255 - b for b in b"abc"] and np.frombuffer(two, "<u4").tolist() != np.frombuffer(one, "<u4").tolist()
    assert bpe.share_codec(spark, str(bytes_only), PATTERN).key != bpe.share_codec(spark, str(bytes_only), PATTERN, "H").key


def test_ids_beyond_16_bits_raise():
    codec = bpe.Codec({**{bytes([b]): b for b in range(256)}, b"ab": 70_000}, PATTERN, "H")
    assert codec.encode("a b") == np.array([97, 32, 98], "<u2").tobytes()
    with pytest.raises(ValueError):
        codec.encode("ab")


def test_run_starts_equal_the_pattern():
    assert bpe.RUNS == PATTERN
    codec, rnd = bpe.Codec(bpe.load_ranks(RANKS), PATTERN), random.Random(6)
    for alphabet in ("a'sre vld\n", "éß漢 1!'s\t\n  ", "\x00a '\x85\xa0\u3000\x1cs", "ab \U0001d4b3٣²'ll\n "):
        for _ in range(500):
            block = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(1, 5))]
            found, counts = codec.matches(block)
            want = [codec.find_any(text) for text in block]
            assert found.to_pylist() == [x for w in want for x in w] and counts.tolist() == list(map(len, want))


@pytest.mark.parametrize("pattern", [PATTERN, r"\S+|\s+"])
@pytest.mark.parametrize("leaf,width", [(64, "I"), (2, "H")])
def test_blocks_equal_the_library(pattern, leaf, width, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    ranks, rnd = bpe.load_ranks(RANKS), random.Random(7)
    codec, own = bpe.Codec(ranks, pattern, width), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    block = ["".join(rnd.choice(rnd.choice(["ab 'll", "éß漢 1!", "\x00a\n", "the in"])) for _ in range(rnd.choice((0, 1, 9, 40, 200)))) for _ in range(300)]
    for some in (block, [], [""], ["", "", "a", ""], ["\0"], ["x" * 100_000, "x"]):
        got = list(codec.encode_all(iter(some)))
        assert got == [codec.encode(text) for text in some]
        assert [np.frombuffer(x, codec.width).tolist() for x in got] == [own.encode_ordinary(text) for text in some]


def test_a_match_is_merged_once_a_block():
    codec, merged = bpe.Codec(bpe.load_ranks(RANKS), PATTERN, "H"), []
    plain = codec.merge_apart
    codec.merge_apart = lambda text: merged.extend(text.split("\0")[:-1]) or plain(text)
    codec.known.work = codec.find_any = codec.find_ascii = None  # neither by themselves nor by the regular expression
    out = list(codec.encode_all(["qwxz vbnk 1é"] * 1000))
    assert sorted(merged) == sorted(["qwxz", " vbnk", " 1", "é"]) and len(out) == 1000 and len(set(out)) == 1


def test_blocks_raise_beyond_16_bits():
    codec = bpe.Codec({**{bytes([b]): b for b in range(256)}, b"ab": 70_000}, PATTERN, "H")
    assert list(codec.encode_all(["a b"])) == [np.array([97, 32, 98], "<u2").tobytes()]
    with pytest.raises(ValueError):
        list(codec.encode_all(["a", "ab"]))


def test_long_spelt_address():
    name = "n" * 200
    text = f"ask {name}[at]host.example.com or b (at) c.org"
    assert pii.more_spans(text, [])[0] == (0, 4, 4 + 200 + 4 + len("host.example.com"))
    assert len(pii.more_spans("x[at]" * 20_000, [])) == 0


def test_span_sample_is_bounded(make, monkeypatch):
    monkeypatch.setattr(pii, "TRAINING_SPANS", 20)
    seen = []
    monkeypatch.setattr(pii, "fit_linear", lambda rows, target, size: seen.append(len(rows)) or (np.zeros(size), 0.0))
    rows = [(i, f"mail user{i}@host{i % 7}.com now") for i in range(400)] + [(1000 + i, "mail same@host.com now") for i in range(400)]
    pii.train(make(rows))
    assert seen == [20]


def test_signs_that_are_no_letters():
    known = langid.Languages({"en": (b"the river was calm", 3), "de": (b"der fluss war still", 2)})
    assert known.predict("12 \u00bd \u00b2 \u2460")[0] == "und" and known.predict("12 \u00bd river")[0] != "und"


def test_workers_forget_codecs_when_other_work_begins(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(8)], "doc_id long, text string").repartition(4)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.KEPT)], pa.int64())], ["kept"])

    bpe.token_digests(docs, RANKS, PATTERN).collect()
    assert {r.kept for r in common.map_rows(docs, count, "kept long", bpe.CODECS).collect()} == {1}
    assert {r.kept for r in common.map_rows(docs, count, "kept long").collect()} == {0}
