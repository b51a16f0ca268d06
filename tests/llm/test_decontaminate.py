import random
import re

from casetriage.llm.decontaminate import decontaminate

from edge import documents


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(text, bench):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == b[i:i + n]:
                    hit.update(range(p, p + n))
                    items.add(item)
    return len(w), len(hit), sorted(str(i) for i in items if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)


def check(spark, docs, bench):
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as h", "2 as w", "'q' as wid")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(d, b).collect())
    assert got == sorted((i, *brute(t, bench)) for i, t in docs)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "and", "a"] * 3 + [f"v{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(13, 40)))) for i in range(15)]
    bench += [(20, "only three words"), (21, "rare"), (22, ""), (23, None), (24, "seven words are not a whole window"), (25, bench[0][1]), (None, bench[1][1]), (0, bench[0][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            src = words(rng.choice(bench)[1])
            lo = rng.randint(0, max(0, len(src) - 5))
            at = rng.randint(0, len(w))
            w[at:at] = src[lo:lo + rng.randint(5, 30)]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(w).replace("the", "THE")))
    check(spark, docs, bench)


def test_overlapping_windows_count_once(spark):
    item = " ".join(f"t{i}" for i in range(20))
    check(spark, [(1, item), (2, f"{item} and {item}"), (3, "x " * 300 + item), (4, "ÉT0 " + item.upper()), (5, None), (6, "")], [(7, item)])


def test_a_repetitive_item(spark):
    check(spark, [(1, "ha " * 40), (2, "ha " * 12), (3, "ha " * 13)], [(1, "ha " * 30)])


def test_edge_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "jumps over the lazy dog")], "item_id long, text string")
    rows = decontaminate(documents(spark), some).collect()
    assert len(rows) == 13 and {r.doc_id for r in rows if r.contaminated} == {1, 2}
    assert not any(r.contaminated for r in decontaminate(documents(spark), none).collect())
    assert decontaminate(documents(spark, []), some).collect() == []
