import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import components, exact_dedup, simhash

DOCS = "doc_id long, text string, fp string, kept string"  # two columns whose names the operators use themselves


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(4000))
TEXTS = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + "."), (8, LONG), (None, "a b c d"), (9, "a b c d "), (9, "a b c d "), (None, "alone")]


def test_groups_match_brute_force(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, TEXTS)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    want = []
    for i, t in TEXTS:
        same = [j for j, u in TEXTS if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep or keep is None))
    assert got == sorted(want, key=repr)


def test_one_of_each_text_stays(spark):
    d = docs(spark, TEXTS)
    rows = exact_dedup.deduplicated(d).collect()
    assert rows[0].__fields__ == d.columns
    assert sorted((r["text"] or "") for r in rows) == sorted({t or "" for _, t in TEXTS})
    assert exact_dedup.deduplicated(d.limit(0)).count() == 0 and exact_dedup.exact_dedup(d.limit(0)).count() == 0


def test_chunks_rebuild_the_text(spark):
    for t in (LONG, "x" * 20000, "é中🙂 " * 3000, "", "a"):
        parts = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0]
        assert "".join(parts) == t and all(len(p) <= exact_dedup.MAX_CHUNK for p in parts)


def test_chunks_find_each_other_after_an_edit(spark):
    r = random.Random(2)
    text = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(9000))
    a, b = spark.createDataFrame([(text,), ("Zz " + text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert len(a["c"]) > 10 and len(set(a["c"]) & set(b["c"])) >= len(a["c"]) - 2


def test_ambiguous_identifiers_fall_back_to_the_whole_text(spark, monkeypatch):
    d = docs(spark, [(1, "same size one"), (2, "same size two"), (3, "same size two")])
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c: F.struct(F.lit(0).cast("long").alias("h"), F.octet_length(c).alias("n")))
    assert exact_dedup.ambiguous_ids(d).count() == 1
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(d).collect()} == {(1, 1, 1), (2, 3, 2), (3, 3, 2)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    """Smallest index reachable over links of at most RADIUS bits."""
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= simhash.RADIUS).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints_and_groups_match_brute_force(spark):
    base = LONG.split()
    rows = [(i, " ".join(base[: 900 + i])) for i in range(40)] + [(100, "ÀB c"), (101, "Àb C"), (102, None), (103, ""), (104, "one"), (104, "one"), (105, "w\x0bx\x0cy z")]
    got = {r["doc_id"]: r for r in simhash.near_groups(docs(spark, rows)).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in fps.items())
    ids = sorted(fps)
    assert [got[i]["component_id"] for i in ids] == [ids[k] for k in reach([fps[i] for i in ids])]
    assert simhash.near_groups(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard,n", [(8, 10), (4096, 10), (4096, 1 << 26)])
def test_links_connect_what_is_near(spark, monkeypatch, shard, n):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fps = {int(centres[i % 4]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for i in range(160)}
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), signed(x)) for x in fps], "id long, f0 long")
    edges = simhash.links(nodes, simhash.pigeonhole_keys(n), simhash.RADIUS).collect()
    assert all((r["u"] ^ r["v"]) & (2**64 - 1) for r in edges)
    at, root = {signed(x): i for i, x in enumerate(fps)}, list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        x, y = find(at[r["u"]]), find(at[r["v"]])
        assert bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 64
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == reach(fps)


def test_both_trees_find_the_same(spark):
    rng = np.random.default_rng(5)
    c = int(rng.integers(0, 2**63))
    fps = np.array([c ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(45)], np.uint64)

    def classes(links):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(fps))]

    hits = []
    fps = fps.reshape(-1, 1)
    simhash.BKTree(np.arange(len(fps))).walk(fps, np.arange(len(fps)), 3, lambda n, h: hits.extend((int(n), int(x)) for x in h))
    assert classes(simhash.shard_links(fps, None)) == classes(hits) == reach(fps[:, 0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long"), 80).collect()))
    assert got == {i: 0 for i in range(1, 31)} | {k: 100 for k in range(101, 140)}
    assert components.components(spark.createDataFrame([], "u long, v long"), 0).count() == 0


def test_near_copies_go_and_clean_texts_stay(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 9)))
    rows, copies = [], set()
    for i in range(60):
        base = [word() for _ in range(r.randint(80, 600))]
        rows.append((10 * i, " ".join(base)))
        if i % 3 == 0:  # two words in a hundred exchanged: most five-word shingles stay
            edited = [word() if r.random() < 0.015 else w for w in base]
            rows.append((10 * i + 1, " ".join(edited)))
            copies.add(10 * i + 1)
        if i % 5 == 0:  # half of the words are new
            rows.append((10 * i + 2, " ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)])))
    d = docs(spark, rows + [(None, rows[0][1])])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    texts = dict(rows)
    alike = {i for i in copies if len(shingles(texts[i]) & shingles(texts[i - 1])) / len(shingles(texts[i]) | shingles(texts[i - 1])) >= 0.8}
    stay = {x["doc_id"] for x in simhash.one_of_each(d).collect()}
    gone = set(texts) - stay
    assert None in stay and gone <= copies and len(gone & alike) >= 0.9 * len(alike) and alike
    assert simhash.one_of_each(d).columns == d.columns and simhash.one_of_each(d.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_go_each_for_itself(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(3, " ".join(base)), (7, " ".join([*base, "more"])), (7, "another text " * 9), (7, " ".join(base[:-1] + ["end"])), (8, None), (None, " ".join(base))]
    stay = sorted(map(repr, ((x["doc_id"], x["text"]) for x in simhash.one_of_each(docs(spark, rows)).collect())))
    assert stay == sorted(map(repr, (rows[0], rows[2], rows[4], rows[5])))
    pair = simhash.one_of_each(docs(spark, [(4, rows[0][1]), (4, rows[1][1])]))
    assert pair.count() == 1


def test_similar_sets_connect_as_by_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, np.uint64)
    for n in (2, 40, 150):
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.08, 0.12]), rng.integers(0, 2**63, 60, np.uint64), base)) for _ in range(n)]
        sets += [sets[0], np.array([0], np.uint64), np.array([0], np.uint64), base[:5], base[:4]]
        plain = [set(x.tolist()) for x in sets]
        near = [(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if i < j and len(a & b) * 5 >= len(a | b) * 4]

        def groups(edges):
            at = list(range(len(plain)))
            for a, b in edges:
                at = [at[a] if x == at[b] else x for x in at]
            return sorted(map(tuple, ([i for i, x in enumerate(at) if x == k] for k in set(at))))

        for found in (simhash.many_similar(sets), simhash.few_similar(plain)):
            assert set(map(tuple, map(sorted, found))) <= set(near) and len(found) < len(plain)
            assert groups(found) == groups(near)


@pytest.mark.parametrize("chunk", [1024, 50])
def test_pairs_that_share_a_template_are_found(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(9)
    words = lambda n: ["".join(r.choices("etaoinshrdlu", k=8)) for _ in range(n)]
    template, rows = words(418), []
    for i in range(150):  # similarity 0.85 in a pair, 0.72 across pairs
        pair = words(41)
        rows += [(2 * i + k, " ".join(template + pair + words(41))) for k in (0, 1)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_pairs_about_the_threshold(spark):
    r = random.Random(10)
    words = lambda n: ["".join(r.choices("etaoinshrdlu", k=8)) for _ in range(n)]
    rows, want = [], {}
    for i in range(600):  # 504 words give 500 shingles, of which all but the last few are common
        common = (446, 439)[i % 2]
        head = words(common + 4)
        rows += [(2 * i + k, " ".join(head + words(500 - common))) for k in (0, 1)]
        want[i] = common / (1000 - common) >= 0.8
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs(spark, rows)).collect()}
    linked = {i for i in want if got[2 * i + 1] == 2 * i}
    assert linked <= {i for i in want if want[i]} and len(linked) >= 0.9 * sum(want.values())
    assert set(got.values()) <= {i for i, _ in rows} and all(got[2 * i] == 2 * i for i in want)
