"""Events of adverts from a file stream that is stopped and goes on, beside plain batch operators."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from listingspark.operators import history
from listingspark.streaming.state import listing_events

SCHEMA = "source string, external_id string, prix double, seen timestamp, ttl int"
DAY0 = dt.datetime(2026, 1, 1)


def observations(seed=3, n=60, days=40):
    """Adverts seen every few days until they vanish, with prices that fall now and then; some without a price, one far later."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        price, end = 1000.0 * (i + 5), r.randint(2, days)
        for d in range(r.randint(0, 3), end, 2):
            price = price * 0.9 if r.random() < 0.2 else price * 1.05 if r.random() < 0.1 else price
            out.append(("ab"[i % 2], str(i), None if r.random() < 0.1 else round(price, 2), DAY0 + dt.timedelta(days=d, minutes=i), 5 if i % 2 else 9))
    return sorted(out, key=lambda x: x[3])


def run(spark, tmp_path, rows, name):
    """One more file, read by a query that starts from the checkpoint and ends when it has read all."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
    events = listing_events(stream, ["source", "external_id"], price="prix", at="seen", ttl_days=F.col("ttl"))
    events.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(300)


def test_stream_that_goes_on_equals_batch(spark, tmp_path):
    rows = observations()
    last = [("a", "tail", 1.0, DAY0 + dt.timedelta(days=90), 300)]
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :], last, [("a", "tail", 1.0, DAY0 + dt.timedelta(days=90, minutes=1), 300)])):
        run(spark, tmp_path, part, k)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    # batch: drops between neighbouring prices, last times seen
    batch = spark.createDataFrame(rows, SCHEMA)
    signals = {r["external_id"]: r for r in history.price_signals(batch.filter("prix is not null"), ["source", "external_id"], "prix", "seen").collect()}
    got: dict = {}
    for e in out:
        got.setdefault(e["external_id"], []).append(e)
    assert set(got) == {r[1] for r in rows} | {"tail"}
    gone = 0
    for i, events in got.items():
        if i == "tail":
            assert [e["kind"] for e in events] == ["new"]
            continue
        own = [r for r in rows if r[1] == i]
        # an advert that isn't seen for its days to live may have expired and come back: here none has such a gap
        drops = [e for e in events if e["kind"] == "drop"]
        want = signals.get(i)  # none of an advert that never had a price
        assert len(drops) == (want["n_drops"] if want else 0) and (not drops or max(e["at"] for e in drops) == want["last_drop"])
        assert sum(e["kind"] == "new" for e in events) == 1
        expired = [e for e in events if e["kind"] == "expired"]
        assert len(expired) == 1 and expired[0]["at"] == own[-1][3] + dt.timedelta(days=own[-1][4]) and expired[0]["n_drops"] == len(drops) and expired[0]["most"] == max((r[2] for r in own if r[2]), default=None)
        gone += 1
    assert gone == len({r[1] for r in rows}) and sum(len(v) for v in got.values()) > 100
    # as of the last time, the adverts that the timers let go are those that batch calls inactive by staleness
    as_of = F.lit(DAY0 + dt.timedelta(days=90)).cast("timestamp")
    listings = batch.groupBy("source", "external_id").agg(F.max("seen").alias("last_seen_at")).withColumns({"active": F.lit(True), "url": F.lit("u")})
    active = history.activity(listings, spark.createDataFrame([], "source string, url string"), as_of, ttl_days={"a": 9, "b": 5})
    assert {r["external_id"] for r in active.filter("not active").collect()} == set(got) - {"tail"}
