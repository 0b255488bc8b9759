import itertools
import os
import shutil
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.llm.helpers import store
from vigil.llm import queries, url_rules


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def plain_given(host, path):
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x", "http://example.org/en/1?q=1", "http://example.org/en/2", "http://badexample.org/es/", "http://a.com/fr/", "http://a.com/de/#x", "http://a.com/en/", "x://b.net?://c.com/de/", "HTTP://U:P@É.com:80/de/a", "http://org", "http://org/", "a://b://c/d"]


def test_hosts_paths_and_given_rules(spark, tmp_path):
    rows = list(enumerate(URLS)) + [(None, URLS[4]), (5, URLS[5])]
    store(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    sf = store(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string"), tmp_path, "pages")
    key = lambda r: str(tuple(r))
    expected = [(i, *(hp := plain_parts(u)), (g := plain_given(*hp))[0], g[1] or "allow") for i, u in rows]
    assert sorted(map(tuple, queries.op2_url_rules(spark, sf).collect()), key=key) == sorted(expected, key=key)
    empty = store(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path / "e", "pages")
    store(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path / "e", "labels")
    assert queries.op2_url_rules(spark, empty).count() == 0


def plain_limit(wrong, seen, z=url_rules.SURE):
    """The least share under which ``wrong`` of ``seen`` lies within z standard errors, by bisection."""
    low, high = 0.0, wrong / seen
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if wrong / seen - mid <= z * (mid * (1 - mid) / seen) ** 0.5 else (mid, high)
    return high


def site(n=400):
    pages = [(i, f"https://{'spam' if i % 5 == 0 else 'good'}.example.net/{'a' if i % 2 else 'b'}/{i}?k{i % 4}=1") for i in range(n)]
    bad = {i: (i % 10 == 0) or i % 7 == 3 and i % 2 == 1 for i in range(n - 40)}
    return pages, bad


@pytest.mark.parametrize("most_items,most_rules", [(12, 50_000), (1, 0)])
def test_mined_rules_equal_counting(spark, most_items, most_rules):
    pages, bad = site()
    df = spark.createDataFrame(pages, "page_id long, url string")
    df = df.select("*", *(F.lit("clash").alias(c) for c in ("rule", "_tokens", "_given", "tokens", "given", "own", "_own", "_first")))
    labels = spark.createDataFrame(list(bad.items()) + [(1, None)], "page_id long, bad boolean")
    found = url_rules.judge(df, labels, most_items=most_items, most_rules=most_rules)
    assert set(found.columns) == {*df.columns, "host", "path", "mined", "verdict"}
    out = {r.page_id: r for r in found.collect()}
    assert all(r._tokens == r._given == r.own == r.tokens == "clash" for r in out.values()) and len(out) == len(pages)
    own = {r.page_id: set(r.tokens) for r in url_rules.parts(df.select("page_id", "url"), "url").collect()}
    seen, wrong = Counter(), Counter()
    for i, is_bad in bad.items():
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(own[i]), n):
                seen[c] += 1
                wrong[c] += is_bad
    cut = url_rules.LIFT * sum(bad.values()) / len(bad)
    rules = {c: x for c in seen if wrong[c] >= 20 and (x := plain_limit(wrong[c], seen[c])) >= cut}
    assert {len(c) for c in rules if not any(set(r) < set(c) for r in rules)} >= {2, 3} or {len(c) for c in rules} >= {2}
    least = {c: x for c, x in rules.items() if not any(set(r) < set(c) for r in rules)}
    best = lambda i: min(((len(c), -round(x, 9), " & ".join(c)) for c, x in least.items() if set(c) <= own[i]), default=(0, 0, None))[2]
    assert all(out[i].mined == best(i) and (out[i].verdict == "block") == (best(i) is not None) for i in own)
    assert any(r.verdict == "block" for r in out.values()) and any(r.verdict == "allow" for r in out.values())


def test_tokens_of_hosts(spark):
    url = "https://m.casino-win.Example.com/a_b/12?q=1"
    found = url_rules.parts(spark.createDataFrame([(url,), ("x://casino-/",)], "url string"), "url").collect()
    assert set(found[0].tokens) == {"scheme:https", "host:m.casino-win.example.com", "top:com", "domain:example.com", "label:m", "label:casino-win", "label:example",
                                    "word:casino", "word:win", "path:a", "path:b", "path:#", "key:q"}
    assert set(found[1].tokens) == {"scheme:x", "host:casino-", "top:casino-", "word:casino"}


def test_one_wide_page_leaves_growth_on(spark, monkeypatch):
    """A page of 200 tokens that all are frequent: FP-growth mines, by classes, the rules that counting finds."""
    wide = [f"t{i}" for i in range(200)]
    rows = [([*wide[i % 20 :: 20], "x"], i % 20 in (3, 4) or i % 9 == 0) for i in range(600)] + [(wide, True)]
    used = []
    fit = url_rules.FPGrowth.fit
    monkeypatch.setattr(url_rules.FPGrowth, "fit", lambda self, df: used.append(df.count()) or fit(self, df))
    pages = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    found = {tuple(r.tokens): r.confidence for r in url_rules.mined(pages, least=3, support=0, lift=3.0).collect()}
    seen, wrong = Counter(), Counter()
    for own, is_bad in rows:
        for n in (1, 2, 3):
            if len(own) == 200:  # its combinations that no other page has are below the support
                sets = (c for k in range(20) for c in itertools.combinations(sorted(wide[k::20]), n))
            else:
                sets = itertools.combinations(sorted(own), n)
            for c in sets:
                seen[c] += 1
                wrong[c] += is_bad
    cut = 3.0 * sum(b for _, b in rows) / len(rows)
    rules = {c: x for c in seen if wrong[c] >= 3 and (x := plain_limit(wrong[c], seen[c])) >= cut}
    least = {c: x for c, x in rules.items() if not any(set(r) < set(c) for r in rules)}
    assert used and set(found) == set(least) and all(abs(found[c] - least[c]) < 1e-9 for c in least) and least


def test_sql_agrees_where_mined_rules_decide(spark, tmp_path):
    pages, bad = site()
    rows = [(1000 + i, u.split("?")[0] + (".html" if i % 3 else "/"), "h") for i, u in pages] + [(5000 + i, u, "h") for i, u in enumerate(URLS)]
    store(spark.createDataFrame([(i, int(not b), int(i % 50 == 0)) for i, b in bad.items()] + [(3, None, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    sf = store(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), tmp_path, "pages")
    for name in ("labels", "pages"):  # DuckDB reads the files of a folder by a pattern
        duckdb.sql(f"COPY (SELECT * FROM '{sf}/{name}.parquet/*.parquet') TO '{tmp_path}/{name}-1.parquet'")
        shutil.rmtree(f"{sf}/{name}.parquet")
        os.rename(f"{tmp_path}/{name}-1.parquet", f"{sf}/{name}.parquet")
    oracle.same(spark, sf, queries.op2_url_rules, queries.oracle_sql()["op2_url_rules"])
    verdicts = Counter((r.rule, r.verdict) for r in queries.op2_url_rules(spark, sf).collect())
    assert verdicts[None, "block"] > 20 and verdicts[None, "allow"] > 20


def test_many_equal_and_almost_equal_long_urls(spark):
    long = "/".join(f"part{i}" for i in range(60))
    wide = [(1000 + i, "https://w.net/?" + "&".join(f"key{j}=1" for j in range(30) if (i * 7 + j) % 9)) for i in range(80)]
    pages = [(i, f"https://a.net/{long}") for i in range(40)] + [(100 + i, f"https://b.net/{long}") for i in range(60)] + wide
    labels = [(i, i < 100 or i % 4 == 0) for i, _ in pages]
    began = time.time()
    out = url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), least=15, lift=1.2).collect()
    assert time.time() - began < 60
    assert all(r.verdict == "block" for r in out if r.page_id < 100)
