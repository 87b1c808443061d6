"""The round barrier as a stream: a game's next round opens when all agents of the rounds before it are there.

State a game: the agents seen in each round that is not whole yet, and the first such round. Calls may come in any order and
more than once. Each time the first open round moves, and once when the game begins, a row is sent on; if a patience is given, a game of which nothing
is heard for so long gives a row marked as stalled, by a timer of processing time, and may go on later. State and timers
live in the checkpoint, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPENED = "item_id long, family string, next_round long, stalled boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RoundBarrier(StatefulProcessor):
    def __init__(self, agents: int, patience_ms: int | None) -> None:
        self.agents, self.patience_ms = agents, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a game, as each state that is asked or told is a round trip: the first open round, and the agents of it and
        # of later ones as a list of pairs in JSON.
        self.game = handle.getValueState("game", "open long, held string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.game.get()
        before = known[0] if known else 0
        seen = {(at, agent) for at, agent in json.loads(known[1])} if known else set()
        seen.update((int(call.round), call.agent_id) for call in rows if call.round is not None and call.round >= before and call.agent_id is not None)
        held = Counter(at for at, _ in seen)
        now = before
        while held[now] >= self.agents:
            now += 1
        self.game.update((now, json.dumps(sorted(x for x in seen if x[0] >= now))))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        if not known or now != before:
            yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, self.game.get()[0], True)

    def _row(self, key, now: int, stalled: bool) -> Row:
        return Row(item_id=key[0], family=key[1], next_round=now, stalled=stalled)

    def close(self) -> None:
        pass


def opened_rounds(calls: DataFrame, agents: int, patience_ms: int | None = None) -> DataFrame:
    """A stream of (item_id, family, next_round, stalled) from a stream of calls (item_id, family, agent_id, round). Without
    `patience_ms` no game stalls; with it a query goes on for ever, as timers may always be due, so it must not be one of what is
    available now."""
    calls.sparkSession.conf.set(_PROVIDER, _ROCKS)
    keyed = calls.select(F.col("item_id").cast("long"), "family", "agent_id", F.col("round").cast("long"))
    return keyed.groupBy("item_id", "family").transformWithState(RoundBarrier(agents, patience_ms), OPENED, "Update", "None" if patience_ms is None else "ProcessingTime")


def replayed(calls: DataFrame, path: str, agents: int, batches: int = 4, stop_after: int | None = None) -> DataFrame:
    """The first open round of each game, after `calls` has been dealt at random to `batches` files under path and read as a
    stream, a file a batch. With `stop_after`, the stream fails at the end of that many batches and goes on from its checkpoint."""
    spark = calls.sparkSession
    given = calls.select("item_id", "family", "agent_id", "round")
    deal = F.pmod(F.xxhash64("item_id", "agent_id", "round"), F.lit(batches))
    given.withColumn("deal", deal).repartition(batches, "deal").write.partitionBy("deal").parquet(f"{path}/in")
    left = stop_after

    def keep(batch: DataFrame, n: int) -> None:
        # A batch that is run again writes over what it wrote.
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        if left is not None and n == left - 1:
            raise RuntimeError("stopped as asked")

    def run() -> None:
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        opened_rounds(stream, agents).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    kept = spark.conf.get(_PROVIDER, None)
    try:
        try:
            run()
        except StreamingQueryException as stopped:
            if left is None or "stopped as asked" not in str(stopped):
                raise
            left = None
            run()
    finally:
        if kept:
            spark.conf.set(_PROVIDER, kept)
        else:
            spark.conf.unset(_PROVIDER)
    return spark.read.schema(OPENED).parquet(f"{path}/out").groupBy("item_id", "family").agg(F.max("next_round").alias("next_round"))
