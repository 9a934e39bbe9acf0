import re

import numpy as np
import pytest

from tidewater.llm.urls import RULES, judge

CASES = [None, "", "no scheme/en/", "http://", "HTTP://A.COM", "http://A.Com/", "http://example.com/en/x", "https://www.EXAMPLE.com/en/?q=1", "http://notexample.com/en/x", "http://a.net/es/1#t", "http://net/fr/", "http://a.net/ES/", "x://y://z/p?q#r", "http://a.net?es/", "http://a.org/" + "9" * 20000, "http://a.org#f/com/"]


def expect(url):
    m = re.match(r"([^/?#]*)([^?#]*)", (url or "").partition("://")[2])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    path, best = m[2], None
    for _, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    got = {x["page_id"]: x for x in judge(frame(spark, CASES + CASES)).collect()}
    assert len(got) == 2 * len(CASES)
    for i, u in enumerate(CASES + CASES):
        host, path, rule = expect(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        if rule:
            assert got[i]["verdict"] == dict((r, v) for v, r in RULES)[rule]
        assert got[i]["verdict"] in ("allow", "block") and 0 <= got[i]["score"] <= 1


def test_trees_learn_the_labels(spark):
    rng = np.random.default_rng(0)
    urls = []
    for i in range(600):
        bad = i % 2
        body = "".join(rng.choice(list("0123456789"), 30)) if bad else "-".join(rng.choice(["news", "sport", "art"], 3))
        urls.append(f"http://a{i % 7}.{'net' if i % 3 else 'org'}/{'es' if bad and i % 3 else 'xx'}/{body}" if bad else f"http://a{i % 7}.{'com' if i % 3 else 'org'}/xx/{body}")
    got = judge(frame(spark, urls)).toPandas().sort_values("page_id").reset_index(drop=True)
    unlisted = got[got["rule"].isna()]
    assert len(unlisted) > 100 and ((unlisted.verdict == "block") == (unlisted.page_id % 2 == 1)).mean() > 0.95


@pytest.mark.parametrize("urls", [[], [None], ["http://x.org/"]])
def test_edges(spark, urls):
    assert [x["verdict"] for x in judge(frame(spark, urls)).collect()] == ["allow"] * len(urls)
