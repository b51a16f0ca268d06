import random
import re
from collections import defaultdict

import numpy as np
import pytest

from casetriage.llm.jaccard import bands_of, jaccard_components, signatures

from edge import LONG, documents


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if i * den >= num * (len(sets[a]) + len(sets[b]) - i):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_equals_brute_force_on_edited_texts(spark, k, num, den):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts[len(texts)] = " ".join(t)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert got(jaccard_components(docs, words=k, threshold=(num, den))) == brute(texts, k, num, den)


def test_chain_of_links_and_a_hub(spark):
    """Neighbours of a chain link, its ends don't; copies of a hub link by the hub only."""
    words = [f"c{i}" for i in range(140)]
    chain = {i: " ".join(words[4 * i:4 * i + 100]) for i in range(10)}
    hub = [f"h{i}" for i in range(120)]
    star = {100: " ".join(hub)}
    for j in range(1, 12):
        t = list(hub)
        t[9 * j], t[9 * j + 4] = f"x{j}", f"y{j}"
        star[100 + j] = " ".join(t)
    texts = chain | star
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert got(jaccard_components(docs, words=4, threshold=(85, 100))) == brute(texts, 4, 85, 100)


def test_signatures_meet_for_every_pair_within_the_difference():
    rng, cache = np.random.default_rng(3), {}
    for n in [1, 2, 5, 6, 7, 8, 11, 19, 33, 70, 150, 600, 2500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, int(0.176 * n)) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[:n - drop // 2], rng.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common * 100 >= 85 * (len(a) + len(b) - common) and common < len(a) + len(b) - common:
                assert np.intersect1d(signatures(a, 85, 100, cache), signatures(b, 85, 100, cache)).size


def test_bands_cover_both_sizes():
    cache = {}
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            diff = (a + b) * 15 // 185
            if diff >= 1:
                own = {i: x for i, x in bands_of(a, 85, 100, cache)}
                assert any(i in own and own[i].diff >= diff for i, _ in bands_of(b, 85, 100, cache)), (a, b)


def test_edge_rows(spark):
    rows = jaccard_components(documents(spark), words=4, threshold=(85, 100)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == by[2] == [(11, 1)]
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert by[9] == [(1, 9), (1, 9)] and by[8] == [(1, 8)]
    assert by[7] == [(len(shingles(LONG, 4)), 7)]
    assert sorted(by[None]) == [(0, None), (5, None)]


def test_empty_table(spark):
    assert jaccard_components(documents(spark, [])).collect() == []


def test_hubs_spare_pairs(spark, monkeypatch):
    """What the leaders leave apart is compared with the members of most links before all pairs are."""
    import casetriage.llm.jaccard as J
    rng = random.Random(11)
    base = [f"h{i}" for i in range(150)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    docs, seen, close = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {}, J._close_pairs

    def counted(*a):
        seen[J.HUB_ROUNDS] = seen.get(J.HUB_ROUNDS, 0) + (pairs := close(*a)).count()
        return pairs
    monkeypatch.setattr(J, "_close_pairs", counted)
    monkeypatch.setattr(J, "HUB_ROUNDS", 1)
    want = got(jaccard_components(docs, words=5, threshold=(80, 100)))
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    assert got(jaccard_components(docs, words=5, threshold=(80, 100))) == want == brute(dict(rows), 5, 80, 100)
    assert 2 * seen[1] < seen[0], seen
