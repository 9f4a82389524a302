import re

import pytest

from case_insights.llm.urlrules import CURATED, judge_urls, match_rules, mine_rules

URLS = [
    None, "", "no scheme/en/", "http://", "http://Example.COM/en/1", "http://www.example.com/en/1?q=://x/",
    "https://a.b.example.com/en/x#y", "http://example.com/en", "http://example.com", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/1", "http://net/es/2", "ftp://x.org/EN/1?A=b&c=d",
    "http://xcom/", "http://É.com/a b/\n?x", "://com/", "http://a.com?x=/en/", "http://a.com#/",
] + [f"http://h{i}.example.com/en/{i}" for i in range(30)] + [f"http://h{i}.com/de/{i}" for i in range(30)]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in CURATED if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame(
        [(i, u, "h", "t", 0.1) for i, u in [*enumerate(URLS), (None, "http://x.org/en/1"), (4, URLS[4])]],
        "page_id long, url string, host string, tokens string, confidence double",
    )
    return judge_urls(pages).collect()


def test_curated_rules(judged):
    assert len(judged) == len(URLS) + 2
    for r in judged:
        url = "http://x.org/en/1" if r.page_id is None else URLS[r.page_id]
        host, path, rule, verdict = expected(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
        assert (r.mined is None) or verdict is None


def test_mined_rules_decide_the_rest(judged):
    by_url = {URLS[r.page_id]: r for r in judged if r.page_id is not None}
    assert by_url["http://notexample.com/en/1"].rule == "com/"
    assert by_url["http://x.net/de/1"].mined


def test_rules_match_brute_force(spark):
    # b and c are sure alone, so no longer rule with them stays; a is not
    sets = [["a"], ["a", "b"], ["b", "c"], ["a", "b", "c"], ["c"], []] * 3 + [["a", "d"]]
    labelled = [(s, "block" if {"a", "b"} <= set(s) or "c" in s else "allow") for s in sets]
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules = mine_rules(frame, 0.05, 0.9).collect()
    counts = {}
    for r in rules:
        fits = [v for s, v in labelled if set(r.tokens) <= set(s)]
        share = fits.count(r.verdict) / len(fits)
        assert share == pytest.approx(r.confidence) and share >= 0.9
        counts[tuple(r.tokens), r.verdict] = share
    assert {t for t, _ in counts} == {("b",), ("c",), ("d",)}
    found = {tuple(r.tokens): r for r in match_rules(frame, spark.createDataFrame(rules)).collect()}
    for s in sets:
        fits = [(r.confidence, r.support, len(r.tokens), r.tokens, r.verdict) for r in rules if set(r.tokens) <= set(s)]
        if fits:
            best = max(fits)
            assert (found[tuple(s)].mined, found[tuple(s)].mined_verdict) == (best[3], best[4])
        else:
            assert tuple(s) not in found


def test_without_labels_all_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    assert [(r.rule, r.verdict, r.mined) for r in judge_urls(pages).collect()] == [(None, "allow", None)] * 2
    assert judge_urls(pages.limit(0)).collect() == []
