"""Keyed state on a stream of price observations: drops as they come, adverts that are no longer seen by timers.

Each advert's state is one small row. Rows of a micro-batch are taken in the order of their time; what is older than the
state's last row changes no price. An advert expires when the watermark passes its last observation by its time to live: then its
timer fires, and the state goes. State and offsets are in the checkpoint, so a stream that is stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of an advert: first, highest and last price, number of drops, times of the last drop and observation, days to live.
STATE = T.StructType([T.StructField(n, t) for n, t in (("first_price", T.DoubleType()), ("most", T.DoubleType()), ("price", T.DoubleType()), ("n_drops", T.LongType()), ("last_drop", T.TimestampType()), ("last_seen", T.TimestampType()), ("ttl", T.IntegerType()))])
EVENT = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("at", T.TimestampType()), ("price", T.DoubleType()), ("before", T.DoubleType()), ("first_price", T.DoubleType()), ("most", T.DoubleType()), ("n_drops", T.LongType()))])


def listing_events(observed: DataFrame, keys: list[str], *, price: str, at: str, ttl_days: Column, delay: str = "1 day") -> DataFrame:
    """Events of each advert of a stream of observations: ``new`` (first seen, or seen again after it expired), ``drop`` (a lower
    price than before) and ``expired`` (not seen for its days to live).

    Returns the keys, kind, at (the observation's time; of an expiry, when it fell due), price, before (the price before), first_price,
    most (the highest so far) and n_drops. ttl_days: whole days by a column of the stream, from 1; the last row's counts.
    delay: how late rows may come; later ones are dropped by the watermark. Rows without a time are left out, rows without
    a price count as seen; of rows of equal time the higher price comes first. Null keys are a key of their own."""
    kinds = {f.name: f.dataType for f in observed.schema}
    output = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], *EVENT])
    rows = observed.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(price).cast("double").alias("_price"), F.greatest(F.coalesce(ttl_days.cast("int"), F.lit(1)), F.lit(1)).alias("_ttl"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, out = [f.name for f in STATE], []
        now = dict(zip(names, state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            # the timer is set at the due time, so the watermark that fires it tells no more than that it has passed
            due = pd.Timestamp(now["last_seen"]) + pd.Timedelta(days=now["ttl"])
            out.append(("expired", due, now["price"], None, now["first_price"], now["most"], now["n_drops"]))
            state.remove()
        else:
            seen = pd.concat(list(batches)).sort_values(["_at", "_price"], ascending=[True, False])
            ttl = 1
            for moment, value, ttl in zip(seen["_at"], seen["_price"], seen["_ttl"], strict=True):  # noqa: B007
                value = None if pd.isna(value) else float(value)
                if now is None:
                    now = {"first_price": value, "most": value, "price": value, "n_drops": 0, "last_drop": None, "last_seen": moment, "ttl": 1}
                    out.append(("new", moment, value, None, value, value, 0))
                    continue
                if pd.Timestamp(moment) < pd.Timestamp(now["last_seen"]):
                    continue
                now["last_seen"] = moment
                if value is None:
                    continue
                before = now["price"]
                now["first_price"] = value if now["first_price"] is None else now["first_price"]
                now["most"] = value if now["most"] is None else max(now["most"], value)
                now["price"] = value
                if before is not None and value < before:
                    now["n_drops"], now["last_drop"] = now["n_drops"] + 1, moment
                    out.append(("drop", moment, value, before, now["first_price"], now["most"], now["n_drops"]))
            now["ttl"] = int(ttl)
            state.update(tuple(now[n] for n in names))
            due = int((pd.Timestamp(now["last_seen"]) + pd.Timedelta(days=now["ttl"])).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=EVENT.names)
            for i, k in enumerate(keys):
                frame.insert(i, k, [key[i]] * len(out))
            yield frame

    return rows.withWatermark("_at", delay).groupBy(*keys).applyInPandasWithState(step, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)
