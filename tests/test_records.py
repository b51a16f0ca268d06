"""Multi-line CSV read by many tasks gives the rows of the one-task read, wherever the blocks are cut."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from casetriage.sources import readers as RD
from casetriage.sources.records import read_records


@pytest.fixture()
def blocks(spark):
    """Sets the size of a block."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def of(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def files(tmp_path, end="\r\n"):
    rng = random.Random(1)
    value = lambda: "".join(rng.choice(["a", "b ", "ü", '"', ",", "\n", "\n\n", "1"]) for _ in range(rng.randint(0, 12)))
    out = []
    for name, cols in (("jan", ["id", "x", "y", "z"]), ("feb", ["id", "z", "x", "y"]), ("mar", ["id", "x", "y", "z"]), ("empty", ["id", "x", "y", "z"])):
        path = tmp_path / f"{name}.csv"
        with open(path, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(cols)
            for i in range(0 if name == "empty" else 60):
                row = [f"{name}{i}", value(), "v" + value(), "w" + value()]
                row = row[:rng.choice([4, 4, 4, 3, 2])] + ["more"] * rng.choice([0, 0, 0, 1])
                w.writerow(row)
            if name == "mar":
                w.writerow(["long", "\n".join(f'line {i} "quoted"' for i in range(400)), "v", "w"])
        out.append(str(path))
    return out


@pytest.mark.parametrize("size", [40, 333, 5000, 1 << 20])
@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_equals_the_one_task_read(spark, tmp_path, blocks, size, end):
    paths = files(tmp_path, end)
    keep = ["file_seq", "id", "x", "y", "z", "was_repaired", "record_status"]
    want = RD.read_monthly(spark, paths, repair_at=2).orderBy("file_seq", "row_seq").select(*keep).collect()
    blocks(size)
    df = RD.read_monthly(spark, paths, repair_at=2, many_tasks=True)
    assert df.orderBy("file_seq", "row_seq").select(*keep).collect() == want
    assert df.select("file_seq", "row_seq").distinct().count() == len(want)


def test_a_file_is_cut(spark, tmp_path, blocks):
    """The long value alone spans many blocks; its file is read by many tasks."""
    path = files(tmp_path)[2]
    blocks(200)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    rows = read_records(spark, [path]).orderBy("at").collect()
    assert len(rows) == 62 and rows[0].at == 0 and rows[-1].record.count("\n") == 399


def test_a_quote_that_never_ends(spark, tmp_path, blocks):
    path = tmp_path / "open.csv"
    path.write_text('id,x\n1,a\n2,"b\n3,c\n4,d\n')
    for size in (5, 1000):
        blocks(size)
        rows = read_records(spark, [str(path)]).orderBy("at").select("record").collect()
        assert [r.record for r in rows] == ["id,x", "1,a", '2,"b\n3,c\n4,d']


def test_blank_lines_and_order(spark, tmp_path, blocks):
    path = tmp_path / "blank.csv"
    path.write_text("id\n\n1\n  \t\n2\n\n")
    blocks(3)
    rows = read_records(spark, [str(path)]).orderBy("at").collect()
    assert [r.record for r in rows] == ["id", "1", "2"] and all(a.at < b.at for a, b in zip(rows, rows[1:]))
