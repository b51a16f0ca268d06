import random
import zlib
from collections import defaultdict

import pytest
from casetriage.llm.queries import op7_bin_packing
from casetriage.llm.sharding import BinTree, best_fit_decreasing, packed, shard_documents

from edge import SF_MID, documents


def plain_best_fit(items, capacity):
    free, out = [], {}
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        fits = [(f, i) for i, f in enumerate(free) if f >= size]
        i = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(max(capacity, size))
        free[i] -= size
        out[item] = i
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_by_tree_equals_a_scan(seed):
    rng = random.Random(seed)
    items = [(rng.choice([rng.randint(1, 100), 7, 50]), i) for i in range(rng.randint(0, 300))]
    assert best_fit_decreasing(items, 100) == plain_best_fit(items, 100)


def test_tree_stays_balanced_and_ordered():
    rng, tree, keys = random.Random(4), None, set()
    for _ in range(3000):
        k = (rng.randint(0, 500), rng.randint(0, 50))
        if k in keys:
            tree = BinTree.without(tree, k)
            keys.remove(k)
        else:
            tree = BinTree.put(tree, k)
            keys.add(k)
    assert tree.height < 2 * len(keys).bit_length()
    for size in range(0, 520, 13):
        assert BinTree.tightest(tree, size) == min((k for k in keys if k[0] >= size), default=None)


def test_packed_is_tight():
    rng = random.Random(9)
    items = [(rng.randint(1, 50), i) for i in range(2000)]
    sums = defaultdict(int)
    for i, b in packed(items, 24).items():
        sums[b] += items[i][0]
    assert len(sums) <= 24 and max(sums.values()) <= 1.01 * sum(s for s, _ in items) / 24


def test_law_of_equal_bytes(spark):
    rows = op7_bin_packing(spark, SF_MID).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    shards, of, total, largest = defaultdict(list), {}, defaultdict(int), defaultdict(int)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert of.setdefault(docs[r.doc_id], r.shard) == r.shard  # equal texts together
        shards[r.shard].append(r.slot)
        total[r.shard] += r["size"]
        largest[docs[r.doc_id]] += r["size"]
    assert set(shards) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    mean = sum(total.values()) / 24
    assert max(total.values()) <= max(1.02 * mean, max(largest.values()))


def loads(items, place, bins=24):
    out = [0] * bins
    for size, item in items:
        out[place[item]] += size
    return sorted(out)


@pytest.mark.parametrize("big", [[1 / 3], [2 / 24], [0.9], [0.3, 0.2, 0.1], [1.2 / 24]])
def test_bins_beside_groups_above_the_mean_are_near_equal(big):
    rng = random.Random(3)
    small = [(rng.randint(1, 50), i) for i in range(5000)]
    rest = sum(s for s, _ in small)
    items = small + [(int(rest / (1 - sum(big)) * b), f"big{i}") for i, b in enumerate(big)]
    got, mean = loads(items, packed(items, 24)), rest / (24 - len(big))
    assert got[-len(big):] == sorted(s for s, _ in items[len(small):])
    assert 0.98 * mean <= got[0] and got[-len(big) - 1] <= 1.02 * mean


def test_large_equal_groups_leave_no_bin_empty():
    items = [(100, i) for i in range(30)]
    assert loads(items, packed(items, 24)) == [100] * 18 + [200] * 6
    assert loads([(5, "a")], packed([(5, "a")], 24)) == [0] * 23 + [5]


def test_a_group_of_a_third_of_the_bytes_has_a_shard_alone(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    copies = docs.selectExpr("sum(octet_length(text) + 8) as b").first().b // 2 // 1008
    hot = spark.range(copies).selectExpr("-1 - id as doc_id", "repeat('hot copies', 100) as text")
    shards, of = defaultdict(int), set()
    for r in shard_documents(docs.union(hot), shards=24).collect():
        shards[r.shard] += r["size"]
        if r.doc_id < 0:
            of.add(r.shard)
    assert len(of) == 1 and len(shards) == 24 and shards.pop(of.pop()) == copies * 1008
    mean = sum(shards.values()) / 23
    assert 0.98 * mean <= min(shards.values()) and max(shards.values()) <= 1.02 * mean


def test_fixed_capacity_and_edge_rows(spark):
    rows = shard_documents(documents(spark), capacity=2_000_000).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[3]["size"] == by[4]["size"] == 8 and by[3].shard == by[4].shard and by[3].text_crc32 == 0
    assert {r.shard for r in rows} == {0}
    slots = sorted(r.slot for r in rows)
    assert slots == list(range(13))
    assert len({r.shard for r in shard_documents(documents(spark), capacity=500).collect()}) == 2


def test_empty_table(spark):
    assert shard_documents(documents(spark, []), shards=24).collect() == []
