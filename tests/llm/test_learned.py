import functools
import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import language, mixing, pii

DOCS = "doc_id long, text string, lang string, source string, score double, taken long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 7) for r in rows], DOCS)


def corpus(n=160):
    r = random.Random(1)
    kinds = {"xx": "baba keke lolo mimi", "yy": "zuz zaz wow xix", "zz": "đà ầnh ộc ươm"}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(kinds))
        syllables = re.findall("..", kinds[lang].replace(" ", ""))
        rows.append((i, " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(40)), lang, "s"))
    return rows


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language.padded([b"hello", b"ab", b"zzz"])
    target, weight = np.array([[0.7, 0.3, 0], [0, 1, 0], [0.2, 0.2, 0.6]])[None], np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(x, mask.astype(float), target, weight)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old, e = v[at], 1e-3
        v[at] = old + e
        up = net.gradients(x, mask.astype(float), target, weight)[0]
        v[at] = old - e
        down = net.gradients(x, mask.astype(float), target, weight)[0]
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-5)


def test_language_of_held_out_documents(spark):
    rows = corpus() + [(500, None, "xx", "s"), (501, "", "xx", "s"), (502, "12 !? 3", "yy", "s"), (503, "baba " * 20000, None, "s"), (None, "zuz zaz", "yy", None), (1, "zuz zaz wow", "yy", "s")]
    d = docs(spark, rows)
    got = [r.asDict() for r in language.identified(d).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502)) and by[503]["lang_pred"] == "xx"
    held = [(i, lang) for i, _, lang, _ in corpus() if i != 1 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(by[i]["held_out"] for i, _ in held)
    assert sum(by[i]["lang_pred"] == lang for i, lang in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language.accepted(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(by) - {500, 501, 502}
    assert language.identified(d.limit(0)).count() == 0


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    rows = corpus()
    turned = [(i, t if zlib.crc32(str(i).encode()) % 5 else "qqqq", lang if zlib.crc32(str(i).encode()) % 5 else "ww", "other") for i, t, lang, _ in rows]
    a, b = language.train(language.sample(docs(spark, rows))), language.train(language.sample(docs(spark, turned)))
    assert a.languages == b.languages and all((a.p[k] == b.p[k]).all() for k in a.p)


def test_unlabelled_tables_give_unknown(spark):
    d = docs(spark, [(1, "abc", None, None), (2, "12", None, None)])
    assert language.identified(d).first()["lang_pred"] == "und"
    assert [r["doc_id"] for r in language.accepted(d).collect()] == [1]


def test_windows_read_like_whole_documents(spark, monkeypatch):
    rows = corpus()
    net = language.train(language.sample(docs(spark, rows)))
    texts = [t * 9 for _, t, _, _ in rows[:12]] + ["", "a", "12", None]
    best, score = language.documents(net, texts)
    monkeypatch.setattr(language, "WINDOW", 10**6)  # one window holds a document: no context is cut
    whole, sure = language.documents(net, texts)
    assert (best == whole).all() and np.abs(score - sure).max() < 0.01 and (best[-4:] == [-1, best[-3], -1, -1]).all()
    monkeypatch.undo()
    monkeypatch.setattr(language, "ROWS", 3)  # nor do batches matter
    assert np.allclose(language.documents(net, texts)[1], score, atol=1e-5)


def test_windows_cover_every_position_once():
    data = bytes(range(256)) * 5
    for n in (0, 1, 447, 448, 449, 1000):
        parts = language.windows(data[:n])
        assert b"".join(p[lead : lead + own] for p, lead, own in parts) == data[:n]


def test_both_readings_agree():
    net = language.Network(["a", "b", "c"], np.random.default_rng(3))
    x, mask = language.padded([b"hello there", b"ab", b"zzz z"])
    for d in "fb":
        assert np.allclose(net.states(x, mask, d)[0], net.read(x, mask, d), atol=1e-6)
    y, _ = net.probabilities(x, mask, True)
    got = net.pooled([(b"hello there", 2, 7), (b"ab", 0, 2), (b"zzz z", 1, 3)])
    assert np.allclose(got, [y[2:9, 0].sum(axis=0), y[:2, 1].sum(axis=0), y[1:4, 2].sum(axis=0)], atol=1e-5)


def test_the_least_score_follows_the_number_of_languages():
    assert language.least_score(4) == 0.4 and language.least_score(100) < 0.02


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    find = lambda p: [(m.span(), m[0]) for m in re.finditer(p, text)]
    return {
        "email": [s for s, _ in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [s for s, x in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in x.split("."))],
        "card": [s for s, x in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(x)) <= 19 and luhn(digits(x))],
        "phone": [s for s, x in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(x)) <= 15],
    }


@pytest.mark.parametrize("letters", ["a1.@-_%+ 2é", "0123456789 -+().", "12.. 0", "٣1@a.b² "])
def test_base_spans_match_the_patterns(letters):
    r = random.Random(2)
    for _ in range(5000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(s) == brute(s), s


PERSONAL = "Write to jo.doe@mail.org or call +1 (743) 555-3824 now. Later: 743-555-3824. Card 4111 1111 1111 1111, again 4111.1111.1111.1111. Host 10.0.0.256 is no host, 10.0.0.25 is. Order 1234567890123456."


@functools.lru_cache(maxsize=1)
def field():
    r = random.Random(7)
    texts = []
    for i in range(400):
        phone = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        items = r.sample([phone, f"user{i}@site{i % 9}.net", f"{r.randint(1, 255)}.{r.randint(0, 255)}.1.9", "4111 1111 1111 1111", str(r.randint(10**15, 10**16 - 1))], 5)
        texts.append(" ".join(x for item in items for x in (*r.choices(["and", "the", "of", "from", "alpha", "beta"], k=4), item)))
    return pii.train(texts)


def test_linked_mentions_become_spans_and_strangers_do_not():
    f = field()
    base, every = pii.found([PERSONAL], f)[0]
    added = {PERSONAL[a:b] for k in pii.KINDS for a, b in set(every[k]) - set(base[k])}
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
    assert any("743-555-3824" in x for x in added) and not any("1234567890123456" in x for x in added)
    clean = "A plain text of the year 1984 with 2.0 versions, section 3.1.2 and 1,000,000 words."
    assert pii.joined(pii.found([clean], f)[0][1]) == ""


def test_planted_mentions_in_other_forms():
    f, r, cases = field(), random.Random(4), []
    for i in range(300):
        words = [r.choice(["and", "the", "of", "from", "alpha", "beta"]) for _ in range(60)]
        known, stranger = (f"{r.randint(200, 999)}555{r.randint(0, 9999):04}" for _ in range(2))
        form = lambda d: r.choice("-. ").join([d[:3], d[3:6], d[6:]])
        again, other = form(known), form(stranger)
        text = " ".join([*words[:20], f"+1 ({known[:3]}) {known[3:6]}-{known[6:]}", *words[20:40], again, *words[40:50], other, *words[50:]])
        cases.append((text, again))
    added = []
    for (text, _), (base, every) in zip(cases, pii.found([t for t, _ in cases], f)):
        added.append({text[a:b] for k in pii.KINDS for a, b in set(every[k]) - set(base[k])})
    right = sum(again in x for (_, again), x in zip(cases, added))
    assert right >= 0.9 * len(cases) and right >= 0.9 * sum(map(len, added))


def test_evidence_reaches_every_repeat():
    number = "743-555-3824"
    text = f"call +1 (743) 555-3824 now " + f"and {number} of " * 40
    base, every = pii.found([text], field())[0]
    assert len(set(every["phone"]) - set(base["phone"])) == 40


def test_numbers_beside_others_are_found():
    f = field()
    text = "the 4111111111111111 1234567890123456 and from +1 (843) 555-7672 170.106.47.218 of"
    base, every = pii.found([text], f)[0]
    added = {(k, text[a:b]) for k in pii.KINDS for a, b in set(every[k]) - set(base[k])}
    assert ("card", "4111111111111111") in added and not any("1234567890123456" in x for _, x in added)


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(0)
    f = pii.Field()
    f.unary, f.pair = rng.normal(size=f.unary.shape), rng.normal(size=f.pair.shape)
    rows, links = [[0, 3], [0, 7], [0, 12]], np.array([[0, 1, 0], [1, 2, 0]])
    u = f.scores(rows)
    k = u.shape[1]
    p = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + f.pair[0][:, :, None] + f.pair[0][None])
    p /= p.sum()
    old, pii.DAMPING = pii.DAMPING, 0.0
    got, both = f.beliefs(rows, links)
    pii.DAMPING = old
    assert np.allclose(got, [p.sum(axis=(1, 2)), p.sum(axis=(0, 2)), p.sum(axis=(0, 1))], atol=1e-6) and np.allclose(both[0], p.sum(axis=2), atol=1e-6) and k == 5


def test_personal_data_over_rows(spark):
    rows = [(1, PERSONAL, "en", "s"), (2, None, None, None), (2, "", "en", "s"), (3, "a@b.co " * 3000, "en", "s"), (None, "no digits here", "en", "s")]
    got = pii.identified(docs(spark, rows)).collect()
    assert len(got) == 5
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    assert next(r for r in got if r["doc_id"] == 3)["n_email"] == 3000
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (2, None))
    assert pii.identified(docs(spark, rows).limit(0)).count() == 0


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 8, 0], [5, 2, 1]) == pytest.approx([0, 8, 0]) and mixing.targets([], []) == []
    many = mixing.targets([1, 2, 3, 400], [5, 2, 1, 5])
    assert sum(many) == pytest.approx(406) and many[:3] == [3, 6, 9]


@pytest.mark.parametrize("words,target", [(1, 3.0), (700, 350.0), (5000, 4999.0), (1023, 1024.0), (100_000, 123_456.0), (7, 0.2)])
def test_a_source_gives_exactly_its_words(words, target):
    p = mixing.planned(3, words, target)
    sizes = []
    order = [mixing.places(p["n"], 3, epoch, np.arange(p["n"])) for epoch in range(p["draws"] // p["n"] + 1)] if p["n"] else []
    assert all(sorted(x) == list(range(p["n"])) for x in order)
    for d in range(p["draws"]):
        epoch, at = divmod(d, p["n"])
        block = int(np.flatnonzero(order[epoch] == at)[0])
        full = min((block + 1) * mixing.BLOCK_WORDS, words) - block * mixing.BLOCK_WORDS
        sizes.append(p["last"] if p["last"] is not None and d == p["draws"] - 1 else full)
    assert sum(sizes) == round(target) and min(sizes, default=1) > 0


def quotas(tree, draws, shards):
    q = np.zeros((len(draws), shards), int)
    for i, n in enumerate(draws):
        found = [tree.shard(i, d) for d in range(n)]
        assert found == sorted(found)  # consecutive ranges
        for x in found:
            q[i, x] += 1
    return q


def test_splitting_tree_keeps_quotas_and_shard_sizes(monkeypatch):
    draws = [100, 7, 0, 53, 1]
    for shards in (1, 5, 16):
        q = quotas(mixing.Tree(draws, shards), draws, shards)
        assert q.sum(axis=1).tolist() == draws and q.sum(axis=0).max() - q.sum(axis=0).min() <= 4
    monkeypatch.setattr(mixing, "TREE_NODES", 3)  # forgetting changes nothing
    assert (quotas(mixing.Tree(draws, 16), draws, 16) == q).all() and (quotas(mixing.Tree(draws, 16, 12), draws, 16) != q).any()


def test_splits_are_hypergeometric():
    first = np.array([mixing.Tree([30, 10, 20], 2, seed).held(2, mixing.Tree([30, 10, 20], 2).leaf(0)) for seed in range(3000)])
    assert first.mean() == pytest.approx(15, abs=0.15) and first.var() == pytest.approx(30 * 30 / 60 * 30 / 60 * 30 / 59, rel=0.1)


def test_many_sources_and_large_numbers():
    draws = [10**10 + i for i in range(5000)]
    tree = mixing.Tree(draws, 1 << 24)
    assert tree.shard(0, 0) >= 0 and tree.shard(4999, draws[-1] - 1) < 1 << 24 and tree.shard(2500, 0) < tree.shard(2500, draws[2500] - 1)
    p = mixing.places(10**12 + 7, 1, 2, np.arange(1000))
    assert len(set(p.tolist())) == 1000 and p.min() >= 0 and p.max() < 10**12 + 7


def test_the_mix_is_what_the_shards_hold(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(700 + i)), "en", "ab"[i % 2]) for i in range(40)]
    d = docs(spark, rows)
    mixed = mixing.mix(d, 8)
    got = mixing.shard_rows(mixed).collect()
    # Brute force: every draw by its definition.
    words = [sum(700 + i for i in range(40) if i % 2 == s) for s in (0, 1)]
    plans = [mixing.planned(s, w, t) for s, (w, t) in enumerate(zip(words, mixing.targets(words, [5, 2])))]
    tree, want = mixing.Tree([p["draws"] for p in plans], 8), {}
    for s, p in enumerate(plans):
        for epoch in range(-(-p["draws"] // p["n"])):
            for block, place in enumerate(mixing.places(p["n"], s, epoch, np.arange(p["n"])).tolist()):
                if epoch * p["n"] + place < p["draws"]:
                    want[s, epoch, block] = tree.shard(s, epoch * p["n"] + place)
    assert {("ab".index(r["source_key"][1]), r["epoch"], r["block"]): r["shard"] for r in got} == want
    for s in range(8):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(1, sum(r["shard"] == s for r in got) + 1))
    q = np.bincount([r["shard"] for r in got], minlength=8)
    one = {r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.taken(d).collect()}
    assert q.max() - q.min() <= 12 and sum(t for t, _ in one.values()) == sum(words)
    assert all(sum(int(x.split(":")[2]) for x in s.split(",") if s) == t for t, s in one.values())
    monkeypatch.setattr(mixing, "SEED", 12)
    assert {r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.taken(d).collect()} != one


def test_mix_over_rows(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 30, 3000])) if i % 11 else None, "en", r.choice(["a", "a", "a", "b", "é", None])) for i in range(150)] + [(3, "x y z", "en", "b"), (3, "x y z", "en", "b")]
    d = docs(spark, rows)
    got = mixing.taken(d).toPandas()
    again = mixing.taken(d.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    goal = {(w, t) for w, t in zip(got["source_size"], got["target"])}
    assert got["taken"].sum() == sum(round(t) for _, t in goal)
    mixed = mixing.materialise(d)
    assert mixed.columns == d.columns
    words = {}
    for x in mixed.collect():
        words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(x["text"].split())
    assert {i: n for i, n in got.groupby("doc_id")["taken"].sum().items() if n} == words
    assert mixing.taken(d.limit(0)).count() == 0 and mixing.materialise(d.limit(0)).count() == 0
