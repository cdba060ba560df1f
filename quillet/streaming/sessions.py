"""Sessions of progressive filters: the chips of each session as keyed state of a stream.

An event adds a chip (a query), removes the chip at a place, or clears them all; blank chips and places that
aren't there change nothing. The state of a session is its chips in order and when it was last used. What they
keep of a catalogue is a batch plan over all sessions at once (``survivors``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vectors as v
from ..operators.quantiles import grouped_quantiles
from ..plans.durable import written

EVENT = "session string, ts timestamp, seq long, op string, query string, place int"
CHANGE = "session string, seq long, chips array<string>, expired boolean"


class Chips(StatefulProcessor):
    """Emits a session's chips after each batch of its events; forgets a session that was idle for so long."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chips", "chips array<string>, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["seq", "ts"], kind="stable")
        chips, used = self.state.get() if self.state.exists() else ([], 0)
        chips = list(chips)
        for e in events.itertuples():
            if e.op == "add" and isinstance(e.query, str) and e.query.strip():
                chips.append(e.query)
            elif e.op == "remove" and pd.notna(e.place) and 0 <= e.place < len(chips):
                del chips[int(e.place)]
            elif e.op == "clear":
                chips = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        used = max(int(used), int(events["ts"].max().timestamp() * 1000))
        self.handle.registerTimer(used + self.idle_ms)
        self.state.update((chips, used))
        yield pd.DataFrame({"session": [key[0]], "seq": [int(events["seq"].max())], "chips": [chips], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"session": [key[0]], "seq": pd.array([None], "Int64"), "chips": [[]], "expired": [True]})

    def close(self) -> None:
        pass


def chips(events: DataFrame, idle: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """(session, seq, chips, expired) of a stream of EVENT rows, in the order of ``seq`` within a batch. Rows
    without a session or a time take no part. It needs the state store that
    ``quillet.session`` sets."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    usable = events.where("session is not null and ts is not null and seq is not null").withWatermark("ts", late)
    return usable.groupBy("session").transformWithStateInPandas(Chips(idle_ms), CHANGE, "Update", "EventTime")


def run_chips(events: DataFrame, out: str, checkpoint: str, **how) -> None:
    """Runs what there is and stops; changes are written by the batch's number, so that one that runs again
    replaces its own rows. Started again with the same checkpoint it goes on where it was."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    chips(events, **how).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(changes: DataFrame) -> DataFrame:
    """(session, chips): the last state of each session in the written changes; expired ones have none."""
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("batch"), F.desc("expired")))
    return changes.withColumn("quillet_r", last).where("quillet_r = 1").select("session", "chips")


def survivors(rows: DataFrame, chains: DataFrame, id_col: str = "id", vec_col: str = "embedding", p: float = 0.7) -> DataFrame:
    """(session, id, score) of chains(session, step, vec): each step filters what the one before has kept of
    ``rows`` in its session, as the semantic filter does; scores are those of the last step. Steps count from 1
    without gaps. All sessions go through a step together."""
    catalogue = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("quillet_vec"))
    chains = written(chains.select("session", "step", F.col("vec").alias("quillet_q")))
    out = alive = None
    for step in range(1, (chains.agg(F.max("step")).first()[0] or 0) + 1):
        asked = chains.where(F.col("step") == step).drop("step")
        # The first step is the stated queries against all rows; later ones see what is left.
        met = catalogue.crossJoin(asked) if alive is None else alive.join(asked, "session").join(catalogue, "id")
        raw = written(met.select("session", "id", v.cosine(F.col("quillet_vec"), F.col("quillet_q")).alias("raw")))
        ends = raw.groupBy("session").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
        scaled = raw.join(ends, "session").select("session", "id", v.min_max(F.col("raw"), F.col("low"), F.col("high")).alias("ns"))
        scaled = scaled.withColumn("score", F.round("ns", 4))
        cut = grouped_quantiles(scaled, ["session"], "ns", [p]).select("session", F.col("value").alias("cut"))
        # Rounding may leave none above the quantile: then the best row stays alone.
        best = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "id"))
        over = F.max((F.col("score") >= F.col("cut")).cast("int")).over(Window.partitionBy("session"))
        kept = scaled.join(cut, "session").withColumn("quillet_any", over).withColumn("quillet_best", best)
        kept = written(kept.where(F.when(F.col("quillet_any") == 1, F.col("score") >= F.col("cut")).otherwise(F.col("quillet_best") == 1)).select("session", "id", "score"))
        if out is not None:
            out = out.join(asked.select("session"), "session", "left_anti").unionByName(kept)
        else:
            out = kept
        alive = kept.select("session", "id")
    return out if out is not None else rows.sparkSession.createDataFrame([], "session string, id long, score double")
