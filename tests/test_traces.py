"""Hot functions where totals come out a little different each time that they are computed, as sums of doubles do on a cluster."""

from graphloom.operators import traces


def uneven(batches):
    import time

    import pyarrow as pa

    for b in batches:
        shift = time.time_ns() % 1_000_003  # another one in each computation
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([float(i.as_py() * 7919 % 100 + shift) for i in b.column("name")]), pa.array([1] * len(b), pa.int64())], ["name", "mean_ms", "n"])


def test_bound_and_totals_come_of_one_computation(spark):
    times = spark.range(0, 100, 1, 1).withColumnRenamed("id", "name").mapInArrow(uneven, "name long, mean_ms double, n long")
    for _ in range(3):
        assert sum(r.hot for r in traces.hot_functions(times).collect()) == 10
