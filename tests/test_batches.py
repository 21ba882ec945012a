from pyspark.sql import functions as F

from skyloom.operators import spatial, tessellation
from skyloom.sources import storage

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_wide_rows_go_to_python_a_few_at_a_time(spark):
    """Pairs of blocks went to Python ten thousand at a time, at 16 KB each."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    before = spark.conf.get(KEY)
    seen = [r["n"] for r in storage.saved(spark.range(100, numPartitions=2).mapInArrow(sizes, "n long"), 7).collect()]
    assert sum(seen) == 100 and max(seen) == 7
    assert spark.conf.get(KEY) == before
    assert max(r["n"] for r in storage.saved(spark.range(100, numPartitions=2).mapInArrow(sizes, "n long")).collect()) == 50


def test_pair_counts_and_cells_bound_what_python_holds(spark, monkeypatch):
    asked = []

    def recorded(df, at_once=None):
        asked.append((at_once, "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()))
        return storage.saved(df, at_once)

    monkeypatch.setattr(spatial, "saved", recorded)
    monkeypatch.setattr(tessellation, "saved", recorded)
    monkeypatch.setattr(spatial, "BLOCK", 16)
    points = spark.range(300).select(F.lit("a").alias("g"), F.col("id").alias("source_id"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 103).cast("double").alias("y"))
    counts = spatial.pair_counts(points, [0.0, 20.0, 200.0], ["g"])
    assert counts.agg(F.sum("n_pairs")).first()[0] == 300 * 299 // 2
    assert tessellation.voronoi_cells(points, ["g"]).count() == 300
    python = [at_once for at_once, used in asked if used]
    assert len(python) >= 2 and set(python) == {spatial.PAIRS_AT_ONCE, tessellation.CELLS_AT_ONCE}
