import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from casetriage.llm.manifest import ABC, abc, climbed, merkle_manifest
from casetriage.llm.queries import op11_merkle_manifest

from edge import SF_SMALL, documents

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    for level in levels[:-1]:
        lo = i - i % 8
        yield level[lo:i], level[i + 1:lo + 8]
        i //= 8


def lowered(text):
    return None if text is None else text.translate(str.maketrans(ABC, abc))


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(levels_of([leaf_of(r) for r in by[lang]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for j, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            path = [*path_of(trees[j], i), *path_of(top, j)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf_of((*r[:4], lowered(r[4]))) if hit else leaf_of(r)
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out.append((r[0], leaf_of(r), trees[j][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def manifest(docs, local):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle_manifest(docs, COLUMNS, "doc_id", "lang", {"text": F.translate("text", ABC, abc)}, hit, local=local)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert got(op11_merkle_manifest(spark, SF_SMALL)) == brute([tuple(r) for r in docs.select(*COLUMNS).collect()])


@pytest.mark.parametrize("local", [0, 1, 2])
def test_rounds_of_any_number(spark, local):
    """Trees of every shape: one leaf, full runs, a last run of one, and up to four rounds above the blocks."""
    rows = [(1000 * t + i, None, f"t{t}", i, f"Text {i}") for t, n in enumerate([1, 7, 8, 9, 64, 65, 73, 513, 577, 130]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert got(manifest(docs, local)) == brute(rows)


def test_many_trees(spark):
    rows = [(i, "s", f"lang {i % 97}" if i % 97 else None, i, "A" * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest(docs, 3)) == brute(rows)


def test_every_node_of_a_round_gets_all_siblings(spark):
    """The exchange alone: every node ends with the root and its own siblings, short last subtrees included."""
    for n in [1, 2, 8, 9, 10, 64, 66, 71, 130]:
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        nodes = spark.createDataFrame([("t", i, n, x) for i, x in enumerate(leaves)], "tree string, pos long, size long, node string")
        rows = climbed(spark, nodes).collect()
        assert len(rows) == n and {r.root for r in rows} == {levels[-1][0]}
        for r in rows:
            assert list(zip(r.before, r.after)) == [("".join(b), "".join(a)) for b, a in path_of(levels, r.pos)]


def test_edge_rows(spark):
    docs = documents(spark).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.col("n"))
    docs = docs.withColumns({"tree": F.lit(1), "pos": F.lit("x"), "node": F.lit(2), "block": F.lit(3), "_p": F.lit(4), "leaf": F.lit(5), "size": F.lit(6)})
    assert got(manifest(docs, 3)) == brute([tuple(r) for r in docs.select(*COLUMNS).collect()])


def test_empty_table(spark):
    docs = documents(spark, []).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    assert got(manifest(docs, 3)) == []
