import math

import numpy as np
import pytest
from casetriage.llm.queries import URL_RULES, op10_url_filter
from casetriage.llm.urls import BLOCK_WORDS, SEEN, Rule, Segmenter, feature, filter_urls, split_names, word_counts, word_model

from edge import SF_SMALL



def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = ["http://Example.COM/en/1", "https://www.example.com/en/2?x#y", "http://a.example.com/fr/", "http://com", "http://com?x=/", "ftp://x.net/es/1",
        "http://evilexample.com/en/", "http://xnet/es/", "http://a.net/fr/#://b.com/", None, "", "no scheme", "://", "x://://y/z", "http://A.net/ES/",
        "http://thecat.org/de/ÜBER?q", "http://ads-track.org/1", "http://notcom/", "http://a.com:80/x", "http://u@b.net/es/\nline"]


def table(spark, urls):
    rows = [(i, u, f"<p class='adsthe'>the cat sat on the mat over {i}</p>" if i % 3 else None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as path", "2 as rule", "3 as w")


def brute_bayes(rows, segmenter):
    """Plain naive Bayes over the same words."""
    counts, pages = np.zeros((2, 1 << 16)), np.zeros(2)
    for w in BLOCK_WORDS:
        counts[1, feature("h:" + w)] += SEEN
    for host, path in rows:
        r = ruled(host, path)
        if r:
            side = int(r.verdict == "block")
            pages[side] += 1
            for t in segmenter.tokens(host, path):
                counts[side, feature(t)] += 1
    seen = (counts.sum(0) > 0).sum() + 1
    out = []
    for host, path in rows:
        odds = math.log(pages[1] / pages[0])
        for t in segmenter.tokens(host, path):
            f = feature(t)
            odds += math.log((counts[1, f] + 1) / (counts[1].sum() + seen)) - math.log((counts[0, f] + 1) / (counts[0].sum() + seen))
        out.append(odds)
    return out


def test_rules_hosts_and_paths(spark):
    for r in filter_urls(table(spark, URLS), URL_RULES).collect():
        host, path = parsed(URLS[r.page_id])
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), URLS[r.page_id]
        assert r.verdict == (rule.verdict if rule else "block" if r.block_odds > 0 else "allow")


def test_whole_table_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in op10_url_filter(spark, SF_SMALL).collect()}
    rows = sorted((r.page_id, *parsed(r.url)) for r in pages.collect())
    from casetriage.llm.urls import word_model
    want = brute_bayes([(h, p) for _, h, p in rows], word_model(pages, "html"))
    assert len(got) == len(rows)
    for (i, h, p), odds in zip(rows, want):
        assert (got[i].host, got[i].path) == (h, p) and abs(got[i].block_odds - odds) < 1e-9


def test_viterbi_finds_the_cheapest_split():
    s = Segmenter({"the": 100, "cat": 30, "thecat": 1, "sat": 20, "a": 50, "at": 10, "s": 1})
    assert s.split("thecatsat") == ("the", "cat", "sat")
    assert s.split("theqqcat") == ("the", "qq", "cat")
    assert s.split("") == ()

    def cost(parts):
        return sum(s.cost.get(p, s.unknown + s.letter * (len(p) - 1)) for p in parts)

    def all_splits(t):
        return [[]] if not t else [[t[:i], *rest] for i in range(1, len(t) + 1) for rest in all_splits(t[i:])]
    for t in ("thecatsata", "satthex", "aaatcat", "zzthe"):
        assert abs(cost(s.split(t)) - min(cost(p) for p in all_splits(t))) < 1e-9


def test_all_words_count_however_many_there_are(spark):
    # 60,000 other words are as frequent as the two in the name, or more
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)]
    html = [" ".join(words[i:i + 500] * 3) for i in range(0, len(words), 500)] + ["grünerwald meerblick " * 2]
    rows = [(i, f"http://grünerwaldmeerblick.a{i}.net/x{i}", h) for i, h in enumerate(html)]
    counts = word_counts(spark.createDataFrame(rows, "page_id long, url string, html string"), "html")
    names = spark.createDataFrame([("grünerwaldmeerblick",), ("#4",), ("qqq",)], "name string")
    got = {r.name: r.parts for r in split_names(names, counts).collect()}
    assert got == {"grünerwaldmeerblick": ["grünerwald", "meerblick"], "#4": ["#4"], "qqq": got["qqq"]}
    whole = word_model(spark.createDataFrame(rows, "page_id long, url string, html string"), "html")
    assert {w: -math.log(2 / (60_000 * 3 + 4 + SEEN * len(BLOCK_WORDS) + 1 - sum(3 for w in BLOCK_WORDS if w in words)))
            for w in ("grünerwald", "meerblick")}.items() <= whole.cost.items()
    assert got["qqq"] == list(whole.split("qqq"))


@pytest.mark.parametrize("frequent", [0, 5, 40])
def test_joined_names_have_the_same_odds(spark, frequent):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html")
    pages = pages.union(table(spark, URLS).selectExpr("-1 - page_id", "url", "html"))
    want = {r.page_id: r for r in filter_urls(pages, URL_RULES).collect()}
    got = filter_urls(pages, URL_RULES, frequent=frequent).collect()
    assert len(got) == len(want) == pages.count()
    assert all(r == want[r.page_id] for r in got)


def test_one_kind_of_rule_or_none_and_empty_table(spark):
    t = table(spark, URLS)
    assert {r.verdict for r in filter_urls(t, [Rule("allow", "com", "/")]).collect()} == {"allow"}
    assert {r.verdict for r in filter_urls(t, []).collect()} == {"allow"}
    assert filter_urls(table(spark, []), URL_RULES).collect() == []
