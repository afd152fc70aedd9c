"""Filter interactions, source divergence and SimHash groups against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskpanel.llm import divergence, interaction, simhash
from riskpanel.llm.common import looked_up, shared_folder
from tests.llm.conftest import sentence

LARGEST = 1 << 63


def number(i):
    return LARGEST if i is None else i


def test_galloping_merges():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(60), rnd.randrange(0, 50))) for _ in range(rnd.randrange(1, 5))]
        assert interaction.union(lists) == sorted(set().union(*lists))
        assert interaction.difference(lists[0], lists[-1]) == sorted(set(lists[0]) - set(lists[-1]))
        bound = rnd.randrange(70)
        assert interaction.gallop(lists[0], 0, bound) == sum(x < bound for x in lists[0])
    same = list(range(100))
    assert interaction.union([same, same, same]) == same and interaction.union([]) == [] and interaction.union([[], [3]]) == [3]


def brute_interactions(rows, marks):
    """rows: (doc_id, text, part)"""
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", LARGEST), number(i))
    parts = {}
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {n for n, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
                                  ("D", bool(re.search(r"[#$%&*|]", t))), ("E", number(i) > least[t])) if bad}
        good, toxic = marks.get(i, (0, 0)) if i is not None else (0, 0)
        parts.setdefault(part or "", []).append((fails, good == 1, toxic == 1))
    out = []
    for part, docs in parts.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d in docs if f in d[0] and not before & d[0]]
                removed[order, f] = len(gone)
                out.append([part, order, k + 1, sum(not (before | {f}) & d[0] for d in docs), len(gone), sum(f in d[0] and bool(before & d[0]) for d in docs),
                            sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        for row in out:
            if row[0] == part:
                row[9] = sum(n for (_, g), n in removed.items() if g == row[9])
    return sorted(map(tuple, out))


INTERACTION = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("size", [7, interaction.SEGMENT])
def test_interactions(spark, make, odd, monkeypatch, size):
    monkeypatch.setattr(interaction.postings, "__defaults__", (size,))
    rnd = random.Random(5)
    rows = [(i, t, rnd.choice(["en", None, "de"])) for i, t in odd]
    for i in range(100, 160):
        text = sentence(i % 25, rnd.choice([20, 99, 100, 101, 150])) + rnd.choice(["", " 10% off", " X" * 60, "é" * 30])
        rows.append((i, text, rnd.choice(["en", "fr", None, ""])))
    rows += [(None, "same text", "en")] * 5 + [(500, "same text", "en"), (500, "same text", "en"), (501, "same text", "de"), (120, "a second row of one id", "fr")]
    rows += [(600, "CAPS " + "a" * 35, "it"), (601, "CAPS " + "a" * 36, "it"), (602, "clean words " + " ".join(f"w{i}" for i in range(150)), "nl")]
    marks = {i: (rnd.choice([0, 1]), rnd.choice([0, 1])) for i in range(100, 150)}
    marks |= {500: (1, 0), 501: (0, 1)}
    docs = None
    for lang in {r[2] for r in rows}:
        some = make([r[:2] for r in rows if r[2] == lang], lang=lang).withColumns({"part": F.lit("x"), "mask": F.lit(1), "good": F.lit(7), "first_id": F.lit(0)})
        docs = some if docs is None else docs.unionByName(some)
    labels = spark.createDataFrame([(i, *m, "x") for i, m in marks.items()] + [(None, 1, 1, "x"), (100, 0, 0, "x"), (101, None, None, "x")],
                                   "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r[c] for c in INTERACTION) for r in interaction.interactions(docs, labels).collect())
    assert got == brute_interactions(rows, marks)
    assert interaction.interactions(make([]), labels).count() == 0
    none = sorted(tuple(r[c] for c in INTERACTION) for r in interaction.interactions(docs, labels.limit(0)).collect())
    assert none == brute_interactions(rows, {})


def test_postings_are_sorted_lists(make, spark):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    failed = interaction.failures(make([(i, "few words #" if i % 2 else sentence(i, 200)) for i in range(30)]), labels)
    rows = interaction.postings(failed, 5, 8).collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(30)) and all(len(r["ids"]) <= 8 for r in rows)
    assert all(list(r["ids"]) == sorted(r["ids"]) for r in rows)
    assert sorted(r["ids"][p] for r in rows for p in r["failing"][3]) == list(range(1, 30, 2))
    assert [r["ids"][p] for r in rows for p in r["good"]] == [3]


def brute_divergence(rows):
    """rows: (text, lang, source)"""
    held, groups, out = {}, set(), []
    for t, lang, source in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))
        groups.add((lang or "", source or ""))
        held.setdefault(lang or "", []).append((source or "", found))
    for lang, docs in held.items():
        df, total = Counter(), Counter()
        for _, found in docs:
            df.update(found.keys())
            total.update(found)
        kept = [t for t, n in df.items() if n >= 3]

        def probabilities(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        sources = sorted(s for x, s in groups if x == lang)
        counts = {s: sum((f for o, f in docs if o == s), Counter()) for s in sources}
        p, q = {s: probabilities(counts[s]) for s in sources}, probabilities(total)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            words = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", words, 200)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [3, divergence.BUCKET])
def test_divergence(make, odd, monkeypatch, bucket):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    rnd = random.Random(7)
    rows = [(t, rnd.choice(["en", None]), rnd.choice(["s1", "s2", None])) for _, t in odd]
    for i in range(150):
        text = " ".join(rnd.choice(["river", "Boat", "été", "naïve", "x1y2", "日本", "don't", f"w{rnd.randrange(40)}", chr(97 + rnd.randrange(26)) * 3]) for _ in range(rnd.randrange(0, 60)))
        rows.append((text, rnd.choice(["en", "fr"]), f"s{rnd.randrange(9)}"))
    rows += [("alone in its language", "zz", "s1"), ("another one", "zz", "s2"), (" ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "de", "a")] + [
        (" ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "de", "b")] * 3 + [("12 34", "de", "c"), ("long" * 30000, "de", "c")]
    docs = None
    for lang in {r[1] for r in rows}:
        for source in {r[2] for r in rows if r[1] == lang}:
            some = make([(None, t) for t, x, s in rows if (x, s) == (lang, source)], lang=lang, source=source).withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(0)})
            docs = some if docs is None else docs.unionByName(some)
    columns = ("lang", "source", "part", "item", "value", "rank")
    got = sorted(tuple(r[c] for c in columns) for r in divergence.divergence(docs).collect())
    assert got == brute_divergence(rows)
    assert divergence.divergence(make([])).count() == 0


def test_terms_are_counted_across_flushes(make, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 5)
    texts = [f"a b c {chr(97 + i % 7)} éé" for i in range(40)]
    batches = [pa.record_batch({"lang": ["x"] * 10, "source": ["s"] * 10, "text": texts[k:k + 10]}) for k in range(0, 40, 10)]
    n, docs, groups = Counter(), Counter(), 0
    for batch in divergence._count(iter(batches)):
        for row in batch.to_pylist():
            groups += row["term"] is None
            n[row["term"]] += row["n"]
            docs[row["term"]] += row["documents"]
    assert groups > 3 and n.pop(None) == docs.pop(None) == 0
    assert n == sum((Counter(t.split()) for t in texts), Counter()) and docs == Counter(w for t in texts for w in set(t.split()))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[p:p + 3]).encode(), seed=42).intdigest() for p in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(values))]


def test_simhash(make, odd, spark):
    rnd = random.Random(6)
    rows = list(odd) + [(700, "one two"), (701, "ONE\tTwo"), (702, "one"), (703, "É é É")]
    for g in range(8):
        words = sentence(g * 11 + 3, 400).split()
        for c in range(6):
            changed = list(words)
            for _ in range(c):
                changed[rnd.randrange(len(changed))] = f"m{rnd.randrange(1000)}"
            rows.append((100 + 10 * g + c, " ".join(changed)))
    values = [brute_fingerprint(t) for _, t in rows]
    root = brute_groups(values, 2)
    low = {r: min((rows[n][0] for n in range(len(rows)) if root[n] == r and rows[n][0] is not None), default=None) for r in root}
    want = sorted((number(i), f"{v:016x}", number(low[r])) for (i, _), v, r in zip(rows, values, root))
    got = simhash.simhash_groups(make(rows))
    assert sorted((number(r["doc_id"]), r["fingerprint"], number(r["component_id"])) for r in got.collect()) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some links between different fingerprints
    assert simhash.simhash_groups(make([])).count() == 0
    # the hash is the one that Spark has under this name
    assert spark.sql("select xxhash64('one two')").first()[0] % (1 << 64) == simhash._HASH(b"one two")


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_tiles_find_every_link(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "ROWS", 3)
    rnd = random.Random(radius)
    values = {0, (1 << 64) - 1, 1, 1 << 63}
    for _ in range(12):
        value = rnd.getrandbits(64)
        for _ in range(25):
            values.add(value)
            for _ in range(rnd.randrange(1, 5)):
                value ^= 1 << rnd.randrange(64)
    values |= {v >> 22 << 22 | rnd.getrandbits(22) for v in list(values)[:60] for _ in range(3)}
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "node long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes, radius, shared_folder(spark)).collect()]
    assert all(a != b and (a ^ b).bit_count() <= radius for a, b in found)
    at = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(at[a])] = find(at[b])
    same = {}
    for x, r in enumerate(brute_groups(values, radius)):
        same.setdefault(r, set()).add(find(x))
    assert all(len(s) == 1 for s in same.values()) and len({*map(find, range(len(values)))}) == len(same)


def test_lookup_splits_hot_keys(spark, tmp_path):
    spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('k', id % 1500) end as k").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    out = {r["id"]: r["low"] for r in looked_up(rows, found, "k", 3000).collect()}
    assert len(out) == 3000 and out[0] == 0 and out[2997] == 0 and out[1] is None and out[1502] == 2 and out[1501] is None
