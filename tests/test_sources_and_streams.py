"""Sources, payload banks, profiling and continuous scoring."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnspark.functions.vectors import quantised_vector
from tarnspark.operators import profiling
from tarnspark.operators.index import Constant, Exact
from tarnspark.operators.requests import parsed
from tarnspark.sources import references as R
from tarnspark.sources import synthetic
from tarnspark.storage import new_path, numbered
from tarnspark.streaming.scoring import score_bodies, score_stream, stream_bodies, verdict_files


@pytest.fixture(scope="module")
def reference_file(tmp_path_factory):
    rng = random.Random(4)
    rows = [{"vector": [round(rng.random(), 4) for _ in range(14)], "label": rng.choice(["fraud", "legit"]), "note": [1, {"x": 2}]} for _ in range(60)]
    rows[3] = {"label": "fraud", "vector": [0.5] * 20}
    rows[4] = {"vector": [0.25, -1], "label": None}
    rows[5] = {"label": "Fraud"}
    path = tmp_path_factory.mktemp("refs") / "references.json.gz"
    with gzip.open(path, "wt") as f:
        json.dump(rows, f)
    return str(path), rows


def test_reference_set(spark, reference_file):
    path, rows = reference_file
    got = {r["ref_id"]: r for r in R.read_references(spark, path, expected=59).collect()}
    assert sorted(got) == list(range(60))
    for k, r in enumerate(rows):
        v = (r.get("vector") or [])[:14]
        assert got[k]["vector"] == pytest.approx(v + [0.0] * (14 - len(v)))
        assert got[k]["is_fraud"] == (r.get("label") == "fraud")
    refs = R.read_references(spark, path)
    assert [r["ref_id"] for r in R.first_references(refs, 10).collect()] == list(range(10))
    for n in (0, 61):
        with pytest.raises(ValueError):
            R.first_references(refs, n)
    assert R.quantised_references(refs).filter("ref_id = 3").first()["vec"] == [5000] * 14


def test_payload_bank(spark, tmp_path):
    bodies = synthetic.requests(spark, 50).select("body")
    R.write_payloads(bodies, str(tmp_path / "bank"))
    back = R.read_payloads(spark, str(tmp_path / "bank"))
    assert sorted(r["body"] for r in back.collect()) == sorted(r["body"] for r in bodies.collect())
    with pytest.raises(ValueError):
        R.read_payloads(spark, str(tmp_path / "bank"), max_rows=49)
    with pytest.raises(ValueError):
        R.read_payloads(spark, str(tmp_path / "bank"), max_bytes=100)
    drawn = R.choose_payloads(spark, "sample", str(tmp_path / "bank"), 200)
    assert drawn.count() == 200 and drawn.select("body").distinct().count() <= 50
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, R.choose_payloads(spark, "sample", str(tmp_path / "bank"), 200).collect()))
    assert R.choose_payloads(spark, "sample", str(tmp_path / "missing"), 7).count() == 7
    assert R.load_payloads(spark, str(tmp_path / "missing")).count() == 16
    with pytest.raises(ValueError):  # beyond the limits: not replaced by templates
        R.load_payloads(spark, str(tmp_path / "bank"), max_rows=49)
    fixed = parsed(R.templates(spark)).filter("ok")
    assert fixed.count() == 16 and fixed.filter("j.last_transaction is null").count() == 3
    size = profiling.payload_sizes(bodies).first()
    lengths = [len(r["body"].encode()) for r in bodies.collect()]
    assert tuple(size) == (50, min(lengths), max(lengths), sum(lengths))


def test_percentiles_by_rank(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice([1, 1, 1, 5, 9, rng.randint(0, 1000)])) for k in range(999)] + [(2000, "c", None), (2001, "d", 7)]
    df = spark.createDataFrame(rows, "seq long, stage string, x long").repartition(4)
    got = {r["stage"]: r for r in profiling.percentiles(df, ["stage"], "x").collect()}
    for s in "abd":
        v = sorted(x for _, g, x in rows if g == s and x is not None)
        assert [got[s][n] for n in profiling.PERCENTILES] == [v[int(len(v) * p)] for p in profiling.PERCENTILES.values()] and got[s]["max_value"] == v[-1]
    assert "c" not in got and profiling.percentiles(df.filter("stage = 'z'"), [], "x").first()["n"] is None
    windows = profiling.count_windows(df.filter("seq < 999"), "seq", 100, "x").collect()
    assert sorted(r["n"] for r in windows) == [99] + [100] * 9


@pytest.mark.parametrize("n,spread", [(1000, 30), (1000, 100_000), (7, 2), (201, 1)])
def test_latency_against_work(spark, n, spread):
    rng = random.Random(n + spread)
    rows = [(k, rng.randint(0, spread), rng.randint(1, 9)) for k in range(n)]
    order = [w for _, _, w in sorted(rows, key=lambda r: (r[1], r[0]))]
    fast, slow = sorted(order[: n // 2]), sorted(order[int(n * 0.99) :])
    r = profiling.latency_against_work(spark.createDataFrame(rows, "id long, d long, w long"), "d", "w", "id").first()
    assert (r["fast_n"], r["fast_total"], r["fast_median"]) == (len(fast), sum(fast), fast[len(fast) // 2])
    assert (r["slow_n"], r["slow_total"], r["slow_median"]) == (len(slow), sum(slow), slow[len(slow) // 2])


def test_stream_equals_batch(spark, tmp_path):
    bodies = synthetic.requests(spark, 60).select("id", "body").unionByName(spark.createDataFrame([(900, "{"), (901, None)], "id long, body string"))
    refs = spark.range(200).select(F.col("id").alias("ref_id"), quantised_vector(F.array(*[(F.pmod(F.xxhash64("id", F.lit(d)), F.lit(10001)) / 10000.0) for d in range(14)])).alias("vec"), (F.col("id") % 2 == 0).alias("is_fraud"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    bodies.repartition(5).write.json(folder)
    score_stream(stream_bodies(spark, folder, 2), Exact(refs), verdict_files(out), new_path(spark, "progress")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{out}/*").select("id", "fraud_count", "fraud_score", "approved").collect()))
    assert got == sorted(map(tuple, score_bodies(bodies, Exact(refs)).collect())) and len(got) == 62
    assert [r[1:] for r in got if r[0] >= 900] == [(3, 0.6, False)] * 2
    assert {r["fraud_count"] for r in score_bodies(bodies.filter("id < 900"), Constant()).collect()} == {2}


def test_perturbed_queries(spark):
    refs = spark.createDataFrame([(k, [k] * 14, True) for k in range(20)], "ref_id long, vec array<int>, is_fraud boolean")
    q = synthetic.perturbed_queries(refs, 64).collect()
    assert len(q) == 64 and all(len(r["vec"]) == 14 for r in q)
    near = [r["vec"] for r in q if r["id"] % 16]
    assert all(-400 < x < 400 for v in near for x in v)


def test_numbered_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("_n")).repartition(5)
    rows, n = numbered(df, "k", "at")
    assert n == 1000 and rows.columns == ["k", "_n", "at"] and rows.filter("k = at").count() == 1000


def test_work_percentiles(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(100)], "visits long, checks long")
    got = {r["stage"]: r for r in profiling.work_percentiles(df).collect()}
    assert set(got) == {"visits", "checks", "work"} and got["visits"]["p50"] == 50 and got["checks"]["max_value"] == 4
    assert got["work"]["p99"] == sorted(k + k % 5 for k in range(100))[99]
    none = df.withColumn("checks", F.lit(-1).cast("long"))
    assert [r["stage"] for r in profiling.work_percentiles(none).collect()] == ["visits"]


def test_buckets_rise_with_values(spark):
    rng = random.Random(9)
    values = sorted({s * (rng.getrandbits(rng.randint(1, 60)) + d) for _ in range(3000) for s in (1, -1) for d in (0, 1)} | {2**k + d for k in range(60) for d in (-1, 0, 1)})
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", profiling.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) < len(values)
    x = spark.createDataFrame([(v,) for v in values], "v long")
    r = profiling.percentiles(x, [], "v").first()
    assert [r[n] for n in profiling.PERCENTILES] == [values[int(len(values) * p)] for p in profiling.PERCENTILES.values()]
