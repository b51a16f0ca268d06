import random
import re

import numpy as np
import pytest
import xxhash

from casetriage.llm.queries import op13_simhash
from casetriage.llm.simhash import fingerprint_links, shingle_bits, simhash_components

from edge import LONG, ROWS, SF_SMALL, documents


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    values = sorted(values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute(rows):
    """(id, text) rows to sorted (id, fingerprint, component)."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = roots({f for _, f in prints})
    low = {}
    for i, f in prints:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", low.get(root[f])) for i, f in prints), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edge_rows(spark):
    assert got(simhash_components(documents(spark))) == brute([(r[0], r[1]) for r in ROWS])


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_simhash(spark, SF_SMALL)) == brute(rows)


def test_empty_table(spark):
    assert simhash_components(documents(spark, [])).collect() == []


def test_long_text_in_pieces(monkeypatch):
    import casetriage.llm.simhash as m
    bits, n = shingle_bits(LONG.encode(), 3)
    monkeypatch.setattr(m, "PIECE_BYTES", 50)
    cut, same = m.shingle_bits(LONG.encode(), 3)
    assert n == same == 160_001 - 2 and (bits == cut).all()
    assert m.shingle_bits(b"a" * 200 + b" b", 3)[1] == 1


def cluster(rng, n, bits):
    """Different numbers around one centre that differ from it in a few of ``bits`` places."""
    centre, out = rng.getrandbits(64), set()
    while len(out) < n:
        x = centre
        for b in rng.sample(bits, rng.randint(0, min(7, len(bits)))):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("members", [2, 40, 4096])
def test_links_join_all_within_two_bits(spark, members):
    """Whatever a variant compares at once, the links join the same fingerprints; small bounds cut variants again and again."""
    rng = random.Random(7)
    values = {0, 1, 3, 2**64 - 1} | {rng.getrandbits(64) for _ in range(200)}
    values |= cluster(rng, 150, list(range(64))) | cluster(rng, 150, list(range(40, 52))) | cluster(rng, 100, [0, 1, 2, 3, 20, 33, 47, 63])
    for x in list(values)[:120]:
        values.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in values], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in fingerprint_links(spark, fps, members).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == roots(values)


def test_a_variant_emits_a_forest(spark):
    """Links grow with the fingerprints, not with the pairs of a variant."""
    values = [(i << 8) for i in range(256)]  # all share the variants of the upper half
    links = fingerprint_links(spark, spark.createDataFrame([(v,) for v in values], "fp long"))
    assert links.count() <= 64 * len(values)


def test_a_hot_fingerprint_is_joined_apart(spark):
    """A third of all rows are copies of one text."""
    rows = [(i, "one two three four five") for i in range(1000, 1500)] + [(i, f"w{i} x{i} y{i} z{i}") for i in range(1000)]
    rows.append((3, "one two three four five"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(simhash_components(docs)) == brute(rows)
