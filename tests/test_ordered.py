"""Tables in order, packed on their way."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from listwarden.operators.ordered import _packing, sorted_table


def test_packed_rows_come_in_order(spark, tmp_path):
    r = random.Random(3)
    # negative, repeated and null values, null and empty texts, and columns of other types
    rows = [(r.choice([None, -2**62, 5, 5, *range(-900, 900)]), r.choice(["", None, "é" * at]), [at], at % 3 == 0)
            for at in range(700)]
    df = spark.createDataFrame(rows, "id long, text string, list array<int>, `a b.c` boolean").repartition(5)
    for part_rows in (7, 100, 10_000):
        got = sorted_table(df, "id", part_rows)
        assert got.schema == df.schema
        path = f"{tmp_path}/{part_rows}"
        got.write.parquet(path)
        placed = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
        found = [row[:4] for row in sorted(placed.collect(), key=lambda row: (row.file_path, row.row_index))]
        assert [row[0] for row in found] == [row.id for row in df.orderBy("id").collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, (tuple(row) for row in df.collect())))
    assert sorted_table(df.filter("id = 10000"), "id").count() == 0
    assert sorted_table(df.filter("id is null"), "id", 1).count() == df.filter("id is null").count()


def test_blocks_are_bounded_and_compressed():
    """A task packs what it holds when that reaches its bound, and keeps rows of all parts apart."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(2000)]
    batches = [pa.record_batch({"id": pa.array(range(at, at + 100)), "text": texts[at:at + 100]})
               for at in range(0, 2000, 100)]
    packed = list(_packing("id", [499, 1499], 1_000_000)(iter(batches)))
    size = sum(batch.nbytes for batch in batches)
    assert 3 < len(packed) < 12 and sum(batch.nbytes for batch in packed) < size / 2
    ids = {0: [], 1: [], 2: []}
    for batch in packed:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("rows")):
            ids[part] += pa.ipc.open_stream(block.as_buffer()).read_all().column("id").to_pylist()
    assert ids == {0: list(range(500)), 1: list(range(500, 1500)), 2: list(range(1500, 2000))}


def test_texts_cross_no_shuffle_row_by_row(spark, sf_dir, monkeypatch):
    """The ordered write of the listings deals out blocks, not rows with texts."""
    from fixtures import queries as registered

    plans = []

    def kept(df, by):
        plans.append(df)
        return sorted_table(df, by)

    monkeypatch.setattr(registered, "sorted_table", kept)
    got = queries()["generated_row_ids"](spark, sf_dir)
    stored = plans[0]
    plan = sorted_table(stored, "row_id")._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert sum("REPARTITION_BY_NUM" in line for line in wide) == 1
    assert not any("rangepartitioning" in line or "xxhash64" in line for line in wide)
    assert got.select(F.max("line") + 1).first()[0] == stored.count()
