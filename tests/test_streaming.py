import numpy as np

from riftline.operators.windows import metric_derivative
from riftline.streaming.statistic import streaming_statistic


def test_stream_equals_batch(spark, tmp_path):
    x, w = np.random.default_rng(0).normal(size=60), 5
    schema = "series_id string, ts long, x double"
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source) if (tmp_path / "in").mkdir() is None else None
    query = streaming_statistic(stream, w, {"a": 0.5}).writeStream.format("memory").queryName("stat").outputMode("append").start()
    for lo, hi in ((0, 3), (3, 30), (30, 31), (31, 60)):
        rows = [("a", t, float(x[t])) for t in range(lo, hi)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    query.stop()
    got = {r.t: r.g for r in spark.table("stat").collect()}
    series = spark.createDataFrame([("a", t, float(v), 60) for t, v in enumerate(x)], "series_id string, t long, x double, n long")
    want = {r.t: r.g for r in metric_derivative(series, w).collect()}
    assert set(got) == set(range(60 - w + 1))
    assert all(abs(got[t] - want[t]) < 1e-8 for t in got if t < 60 - w)
    assert all(r.above == (r.g > 0.5) for r in spark.table("stat").collect())
