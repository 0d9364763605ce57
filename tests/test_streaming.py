"""Streams against their batch operators, across restarts and repeated batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievewall.operators import delivery, limits
from sievewall.streaming import budgets, verdicts

EVENT = "vendor string, ord long, ts timestamp, amount long, kind string, reservation string"


def budget_events():
    """Three vendors over three months: reservations, releases of known, unknown and earlier ones, and amounts that are none."""
    rng, rows, at = random.Random(5), [], datetime(2026, 1, 20)
    for ord in range(240):
        at += timedelta(hours=rng.randrange(1, 12))
        vendor = rng.choice(["a", "b", "c"])
        if rng.random() < 0.3:
            rows.append((vendor, ord, at, None, "release", f"r{rng.randrange(ord + 1)}"))
        else:
            rows.append((vendor, ord, at, rng.choice([5, 20, 60, -1, None, 0]), rng.choice(["reserve", None]), rng.choice([f"r{ord}", f"r{ord}", None])))
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, budgets.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def test_budget_stream_equals_batch_across_restarts(rocks, tmp_path):
    spark, rows = rocks, budget_events()
    wanted = sorted(tuple(r) for r in limits.budget_decisions(spark.createDataFrame(rows, EVENT), 150).collect())
    assert {r[2] for r in wanted} == {"allowed", "throttled", "released", "ignored", "error"}
    for part in range(4):
        own = rows[part * 60 : part * 60 + 60]
        spark.createDataFrame(own, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        # Each part is a run of its own: what it knows of the parts before is what the state store kept.
        query = budgets.budget_stream(stream, 150).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("vendor", "ord", "decision", "granted", "used").collect()) == wanted


def judged(docs):
    """Verdicts with nothing but the deterministic layers to ask."""
    from sievewall.operators.verdicts import layer_map, screened

    base = screened(docs)
    return base.select("doc_id", F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("pass")).alias("reason"), layer_map(F.col("unicode_reason"), F.col("encoded_reason"), F.col("secret_reason"), F.col("blobs")).alias("layers"), "clean", "text")


def test_a_batch_is_in_each_sink_once_whatever_is_cut_off(spark, tmp_path):
    texts = [(i, "ghp_" + "a1B2" * 9 + f" {i}" if i % 3 == 0 else f"plain {i}") for i in range(30)] + [(None, "ghp_" + "a1B2" * 9), (7, "ghp_" + "c1B2" * 9)]
    for part in range(4):
        spark.createDataFrame(texts[part * 8 : part * 8 + 8], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    folder, state, ts = str(tmp_path / "out"), str(tmp_path / "state"), F.timestamp_seconds(F.lit(0))
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    calls, real = [], verdicts.write_batch

    def failing(rows, path, batch):
        """The process ends between the two sinks of the third batch."""
        calls.append((path.rsplit("/", 1)[1], batch))
        if calls.count((verdicts.DELIVERED, 2)) == 1 and calls[-1] == (verdicts.DELIVERED, 2):
            raise RuntimeError("cut off")
        real(rows, path, batch)

    verdicts.write_batch = failing
    try:
        query = verdicts.screened_stream(stream(), judged, folder, state, ts=ts)
        with pytest.raises(Exception, match="cut off"):
            query.awaitTermination()
        verdicts.screened_stream(stream(), judged, folder, state, ts=ts).awaitTermination()
    finally:
        verdicts.write_batch = real
    assert calls.count((verdicts.QUARANTINED, 2)) == 2
    # A batch that comes once more adds nothing either.
    verdicts.batch_writer(judged, folder, ts=ts)(spark.createDataFrame(texts[:8], "doc_id long, text string"), 0)
    kept = verdicts.sink_rows(spark, folder, verdicts.QUARANTINED, "report_id string, report_text string").select("report_id", "report_text").collect()
    gone = sorted((str(i) if i is not None else "~", t) for i, t in texts if t.startswith("ghp_"))
    assert sorted((r.report_id or "~", r.report_text) for r in kept) == gone
    passed = verdicts.sink_rows(spark, folder, verdicts.DELIVERED, "doc_id long, content string").collect()
    assert sorted(r.doc_id for r in passed) == sorted(i for i, t in texts if not t.startswith("ghp_")) and all("plain" in r.content for r in passed)
    whole = judged(spark.createDataFrame(texts, "doc_id long, text string"))
    assert delivery.quarantined(whole, ts).count() == len(kept)
