import collections
import hashlib
import os

import pytest

from strandlake.llm import language, mixing, simhash, url_filter

URLS = [
    "http://www.Example.com/en/a?b#c", "https://example.com/en", "http://example.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://notnet/fr/", None, "", "no scheme", "://", "http://a.com", "http://a.com?x/en/",
    "http://b.com/" + "long/" * 3000, "http://EXAMPLE.COM./en/x", "http://www.example.com/en/x", "http://w.www.example.com/en/x", "http://com/", "a://b://c.net/es/", "http://x..net/fr/y",
]


def judged(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("limit", [0, 20_000])
def test_rules_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rules = (*url_filter.RULES, ("block", "example.com", "/en"), ("allow", "x", ""))
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(URLS * 2)}
    assert url_filter.url_filter(df.limit(0), url_filter.rule_table(spark)).count() == 0
    none = url_filter.url_filter(df, url_filter.rule_table(spark, ()))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(URLS) * 2


def test_native_plans_hold_no_python(spark):
    from strandlake.llm import exact_dedup

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "a")], "page_id long, url string")
    for df in (exact_dedup.exact_dedup(docs), url_filter.url_filter(pages, url_filter.rule_table(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in C.run(spark, SF).select("doc_id", "decoded_sha256").collect())

    # The first three stages with dictionaries, the mix with its own operator.
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(docs).collect()}
    left = {r["doc_id"]: r for r in docs.collect() if pred[r["doc_id"]][0] != "und" and pred[r["doc_id"]][1] >= 0.4}
    last = {}
    for i in sorted(left):
        last[left[i]["text"] or ""] = i
    left = {i: left[i] for i in last.values()}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs.filter(docs.doc_id.isin(list(left)))).collect()}
    left = {i: r for i, r in left.items() if groups[i] == i}
    mixed = mixing.materialise(spark.createDataFrame(list(left.values()), docs.schema))
    want = collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert got == want and len(C.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_odd_rows(spark):
    import corpus_pipeline as C

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the of and " * 50, "en", None, 5), (2, "the of and " * 50, "en", None, 5), (3, "der und die " * 9000, "de", "b", 1), (4, "die der das", "de", "b", 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "tokens":
                assert out.columns == docs.columns and n <= max(len(some), 3 * len(some))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_warc", "op8_exact_dedup", "op9_url_filter"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from strandlake.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(res.fetchall(), key=repr) == sorted((tuple(r[c] for c in cols) for r in Q.queries()[name](spark, SF).collect()), key=repr)
