"""Substring and near duplicates, decontamination, line rules and shards against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from riskpanel.llm import contamination, lines, neardup, registry, sharding, substring
from tests.llm.conftest import sentence


def key(i):
    return -1 if i is None else i


def test_substring(make, odd):
    shared = sentence(5, 40)
    rows = odd + [(20, sentence(11, 20) + " " + shared), (21, shared + "\n" + sentence(12, 20)), (22, "a b " + shared + " c " + shared), (23, "x " * 40)]
    first, windows = {}, {}
    for n, (i, t) in enumerate(rows):
        words = (t or "").split()
        windows[n] = [tuple(words[p:p + 13]) for p in range(len(words) - 12)]
        for w in windows[n]:
            first[w] = min(first.get(w, 1 << 70), 1 << 63 if i is None else i)
    want = []
    for n, (i, t) in enumerate(rows):
        words = (t or "").split()
        gone = {p + k for p, w in enumerate(windows[n]) if first[w] < (1 << 63 if i is None else i) for k in range(13)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        want.append((key(i), len(words), len(gone), kept))
    got = [(key(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in substring.remove_repeats(make(rows)).collect()]
    assert sorted(got) == sorted(want)
    assert substring.remove_repeats(make([])).count() == 0


def test_substring_blocks(make, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1500)
    rnd = random.Random(2)
    passages = [sentence(100 + i, 30) for i in range(5)]
    rows = [(i, " ".join([sentence(i, 20), rnd.choice(passages), sentence(i + 500, 10)])) for i in range(60)]
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(make(rows)).collect()}
    seen = set()
    for i, t in rows:
        words = t.split()
        own = [tuple(words[p:p + 13]) for p in range(len(words) - 12)]
        gone = {p + k for p, w in enumerate(own) if w in seen for k in range(13)}
        assert got[i] == " ".join(w for p, w in enumerate(words) if p not in gone)
        seen.update(own)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for n in range(len(rows)):
        groups.setdefault(find(n), []).append(n)
    out = []
    for members in groups.values():
        ids = [rows[n][0] for n in members if rows[n][0] is not None]
        low = min(ids) if ids else None
        out += [(key(rows[n][0]), len(sets[n]), key(low), key(rows[n][0]) == key(low)) for n in members]
    return sorted(out)


def mutated(words, rnd, share):
    return " ".join(w if rnd.random() > share else f"m{rnd.randrange(10**6)}" for w in words)


def test_near_duplicates(make, odd, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = random.Random(4)
    rows = list(odd)
    for g in range(6):
        words = sentence(g * 13 + 3, 120).split()
        rows += [(100 + 20 * g + c, mutated(words, rnd, rnd.choice([0, 0.01, 0.02, 0.04, 0.08]))) for c in range(20)]
    rows += [(300, "Same Four Words here"), (301, "same four words HERE"), (302, "same four words")]
    got = sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(make(rows)).collect())
    assert got == brute_components(rows)
    assert neardup.near_duplicates(make([])).count() == 0


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 800, dtype=np.uint64)
    other = np.concatenate([base[:600], rnd.integers(0, 2**63, 200, dtype=np.uint64)])
    agree = (neardup.signature(np.unique(base)) == neardup.signature(np.unique(other))).mean()
    assert abs(agree - 0.6) < 0.2


def test_components(spark):
    from riskpanel.llm.common import shared_folder
    rnd = random.Random(3)
    pairs = [(bytes([a]), bytes([b])) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(70))] + [(bytes([200 + i]), bytes([201 + i])) for i in range(40)]
    got = {r["node"][0]: r["root"][0] for r in neardup.components(spark.createDataFrame(pairs, "a binary, b binary"), shared_folder(spark), "t").collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a[0]), find(b[0])))
        root[y] = x
    assert all(got.get(x[0], x[0]) == find(x[0]) for p in pairs for x in p)


def brute_contamination(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    windows = {}
    for item, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p:p + 13]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        named = sorted(str(x) for x in found if x is not None)
        out.append((key(i), len(w), len(hit), len(named), ",".join(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark, make, odd):
    items = [(1, sentence(5, 30)), (2, sentence(6, 13)), (10, "Tiny: four-word item"), (3, None), (4, "!!"), (5, sentence(5, 30)), (None, sentence(8, 20)), (6, "be " * 20)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    rows = odd + [(20, sentence(1, 9) + " " + sentence(5, 30).upper()), (21, " ".join(sentence(5, 30).split()[4:20])), (22, " ".join(sentence(5, 30).split()[4:16])),
                  (23, "a TINY four word; item. " + sentence(9, 200)), (24, sentence(8, 20)), (25, "be " * 60 + sentence(6, 13))]
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in contamination.contamination(make(rows), bench).collect())
    assert got == brute_contamination(rows, items)
    assert contamination.contamination(make([]), bench).count() == 0
    assert {r["n_hit"] for r in contamination.contamination(make(rows), bench.limit(0)).collect()} == {0}


def brute_counts(text):
    words = (text or "").split()
    grams = {}
    for p in range(len(words) - 4):
        grams.setdefault(tuple(words[p:p + 5]), []).append(p)
    again = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(5)}
    kept = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(kept) - len(set(kept)), len(again)


def test_line_rules(make, odd):
    rows = odd + [(20, "dup line here\nother #1|\ndup line here\n\n\n"), (21, "be " * 30), (22, "a b c d e f a b c d e g"), (23, sentence(3, 50) + " x\n" + sentence(3, 50))]
    rows += [(100 + i, "Common   LINE number 7 of this host with quite some words in it\n" + ("" if i % 2 else sentence(i, 25))) for i in range(60)]
    out = lines.line_rules(make(rows)).collect()
    assert len(out) == len(rows)
    want = sorted((key(i), *brute_counts(t)) for i, t in rows)
    assert sorted((key(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["depleted"])
    assert lines.line_rules(make([])).count() == 0


def brute_lines(rows, hosts, line_docs, line_share):
    """(doc_id, text left, depleted) of every row."""
    def norm(line):
        return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")

    have, all_docs = {}, {}
    for n, ((i, t), h) in enumerate(zip(rows, hosts)):
        who = (n,) if i is None else (i, t)
        if (t or "").split():
            all_docs.setdefault(h, set()).add(who)
        for x in {norm(x) for x in (t or "").split("\n")} - {""}:
            have.setdefault((h, x), set()).add(who)
    common = {k for k, v in have.items() if len(v) >= line_docs and len(v) >= line_share * len(all_docs[k[0]])}
    out = []
    for (i, t), h in zip(rows, hosts):
        left = None if t is None else "\n".join(x for x in t.split("\n") if (h, norm(x)) not in common)
        n, rest = len((t or "").split()), len((left or "").split())
        out.append((key(i), left, rest, rest < n and (rest < 10 or rest < 0.1 * n)))
    return out


def test_lines_by_brute_force(make, odd):
    rnd = random.Random(9)
    shared = [f"Shared  LINE {i} of the site\twith {'some more ' * (i % 4)}words" for i in range(6)]
    page = "a page that is copied\n" + sentence(31, 25) + "\n" + sentence(32, 25)
    rows = odd + [(100 + i, page) for i in range(25)] + [(None, page)] * 3 + [(100, page)] * 30
    rows += [(200 + i, "\n".join([shared[rnd.randrange(6)] for _ in range(rnd.randrange(5))] + [sentence(rnd.randrange(10**6), rnd.randrange(20)), ""])) for i in range(150)]
    rows += [(400 + i, "few copies\n" + sentence(41, 30)) for i in range(12)]
    docs = make(rows, source={i: None if i is None else f"h{i % 2}" for i, _ in rows})
    hosts = ["" if i is None else f"h{i % 2}" for i, _ in rows]
    want = brute_lines(rows, hosts, 8, 0.05)
    got = lines.line_rules(docs, 8, 0.05).collect()
    assert sorted((key(r["doc_id"]), r["words_left"], r["depleted"]) for r in got) == sorted((i, n, gone) for i, _, n, gone in want)
    assert any(gone for *_, gone in want) and any(n and not gone and left != t for (_, left, n, gone), (_, t) in zip(want, rows))
    cut = lines.remove_lines(docs, 8, 0.05)
    assert cut.schema.names == docs.schema.names and lines.remove_lines(make([])).count() == 0
    assert sorted((key(r["doc_id"]), r["text"] or "", r["words"]) for r in cut.collect()) == sorted((i, left or "", "x") for i, left, _, gone in want if not gone)


def test_depleted_documents(make):
    same = "common line number 7 of this host with quite some words in it"
    rows = [(i, f"{same}\nshort tail {'w' * (i + 1)}") for i in range(30)] + [(50 + i, f"{same}\n{sentence(i, 30)}") for i in range(30)] + [(90, same)]
    out = {r["doc_id"]: r["depleted"] for r in lines.line_rules(make(rows)).collect()}
    assert all(out[i] for i in range(30)) and out[90] and not any(out[50 + i] for i in range(30))
    other = {r["doc_id"]: r["depleted"] for r in lines.line_rules(make(rows, source={i: f"h{i % 4}" for i, _ in rows})).collect()}
    assert not any(other.values())


def test_shards(make):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "y" * 40)] * 60 + [(500, "z" * 900), (None, None), (None, "q")]
    out = sharding.assign_shards(make(rows), 600).collect()
    assert len(out) == len(rows) and sorted((key(r["doc_id"]), r["bytes"]) for r in out) == sorted((key(i), len(t or "")) for i, t in rows)
    shards = {}
    for r in out:
        assert len(r["shard"]) == r["depth"]
        shards.setdefault(r["shard"], []).append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name, own in shards.items():
        size = sum(r["bytes"] for r in own)
        assert {r["shard_bytes"] for r in own} == {size} and (size <= 600 or len(own) == 1)
        if name:  # split only because the bucket above was too large
            assert sum(r["bytes"] for n, rs in shards.items() if n.startswith(name[:-1]) for r in rs) > 600
    assert sharding.assign_shards(make([]), 600).count() == 0
    assert {r["shard"] for r in sharding.assign_shards(make(rows), 10**6).collect()} == {""}


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql()))
def test_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, folder)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_pipeline(spark, make, tmp_path):
    import corpus_pipeline as C
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    passage = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    rnd = random.Random(8)
    near = sentence(77, 100).split()
    rows = [(i, sentence(i, 80)) for i in range(40)] + [(50, " ".join(near)), (51, mutated(near, rnd, 0.01)), (52, sentence(60, 40) + " " + passage),
            (53, "###$$$ " * 60), (54, sentence(70, 60) + " mail a.b@c.example.com"), (55, None), (56, "THE!! BIG!! DOG!! " * 30)]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = docs
    for name, work in C.STAGES:
        before, stage = stage, work(spark, stage, str(tmp_path))
        if name != C.STAGES[-1][0]:
            assert set(stage.columns) == set(docs.columns)
    got = {r["doc_id"]: r for r in C.run(spark, str(tmp_path)).collect()}
    assert got.keys() == {r["doc_id"] for r in stage.collect()}
    assert not {53, 55, 56, 52, 51} & got.keys() and {50, 54} < got.keys()
    want = re.sub(r"a\.b@c\.example\.com", "<EMAIL>", dict(rows)[54])
    assert got[54]["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_rows_of_one_hash_are_shards_of_their_own(make, monkeypatch):
    """40 rows of one key share 16 row prefixes: buckets stay over the limit with all bits used."""
    monkeypatch.setattr(sharding, "KEY_BITS", 4)
    monkeypatch.setattr(sharding, "ROW_BITS", 4)
    monkeypatch.setattr(sharding, "BITS", 8)
    rows = sharding.assign_shards(make([(1, "x" * 100)] * 40 + [(2, "y" * 10)]), limit=150).collect()
    assert sorted(r.bytes for r in rows) == [10] + [100] * 40
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.bytes)
        assert len(r.shard) == r.depth
    assert all(sum(held[r.shard]) == r.shard_bytes <= 150 for r in rows) and len(held) >= 40
    assert not any(a != b and b.startswith(a) for a in held for b in held)


def test_written_shards_keep_all_rows(spark, make, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(200)] + [(7, "y" * 40)] * 30 + [(None, None), (None, "q"), (500, "z" * 900)]
    sharding.write_shards(make(rows), str(tmp_path / "shards"), 600)  # has a column `shard`
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((key(r["doc_id"]), r["text"] or "", r["shard"]) for r in back.collect()) == sorted((key(i), t or "", "x") for i, t in rows)
    sizes = {}
    for r in back.collect():
        sizes.setdefault(r["shard_"], []).append(len(r["text"] or ""))
    assert len(sizes) > 5 and all(sum(v) <= 600 or len(v) == 1 for v in sizes.values())
    empty = str(tmp_path / "none")
    sharding.write_shards(make([]), empty, 600)
    assert spark.read.schema(make([]).schema).parquet(empty).count() == 0


def test_near_duplicates_refuse_lower_thresholds(make):
    with pytest.raises(ValueError):
        neardup.near_duplicates(make([]), 74)


def test_recall_near_the_threshold(make):
    """Pairs between 75 and 80 percent, one pair a group."""
    rnd, rows = random.Random(12), []
    while len(rows) < 400:
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(100, 300))]
        other = list(words)
        for at in rnd.sample(range(len(other)), max(1, int(len(other) * 0.028))):
            other[at] = f"m{rnd.randrange(10**6)}"
        a, b = ({tuple(w[p:p + 5]) for p in range(len(w) - 4)} for w in (words, other))
        if 75 <= 100 * len(a & b) / len(a | b) <= 80:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = neardup.near_duplicates(make(rows)).filter("not kept").count()
    assert found >= 0.99 * len(rows) / 2


def test_without_any_clash(make):
    from riskpanel.llm.common import without
    docs = make([(1, "a"), (None, "b"), (3, None)]).withColumnRenamed("words", "gone_id").withColumnRenamed("node", "gone_key_").withColumnRenamed("ids", "GONE_KEY")
    gone = docs.filter("doc_id is null").selectExpr("doc_id", "xxhash64(text) as text_key")
    left = without(docs, gone)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]
