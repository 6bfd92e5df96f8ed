"""Bulk bodies on a stream, flushed when so many documents are held or the first of them has waited so long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagesieve.schemas import Options
from pagesieve.sinks.bulk import bulk_lines

FLUSHED = "shard int, number long, documents int, reason string, body string"


class CountOrTime(StatefulProcessor):
    """Holds the lines of a shard; a body goes out at ``most`` documents, or ``seconds`` after the first of them came."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.wait = most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "value string")
        self.about = handle.getValueState("about", "held int, number long, timer long")

    def _body(self, key, number: int, lines: list[str], reason: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], number, len(lines), reason, "\n".join(lines) + "\n")], columns=["shard", "number", "documents", "reason", "body"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, number, timer = self.about.get() if self.about.exists() else (0, 0, -1)
        new = pd.concat(list(rows)).sort_values(["o", "k"], kind="stable")["value"].tolist()
        if held + len(new) < self.most:
            self.lines.appendList([(line,) for line in new])
            held += len(new)
        else:
            lines = [*(line for (line,) in (self.lines.get() if held else ())), *new]
            while len(lines) >= self.most:
                yield self._body(key, number, lines[: self.most], "count")
                lines, number = lines[self.most :], number + 1
            if timer >= 0:
                self.handle.deleteTimer(timer)
                timer = -1
            self.lines.clear()
            held = len(lines)
            if held:
                self.lines.put([(line,) for line in lines])
        if held and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(timer)
        self.about.update((held, number, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, number, _ = self.about.get()
        if held:
            yield self._body(key, number, [line for (line,) in self.lines.get()], "time")
        self.lines.clear()
        self.about.update((0, number + bool(held), -1))

    def close(self) -> None:
        pass


def bulk_bodies(documents: DataFrame, most: int, seconds: float, shards: int, options: Options = Options()) -> DataFrame:
    """``(shard, number, documents, reason, body)`` of a stream of documents: bulk requests of at most ``most`` documents each.

    A body has the documents in the order they came, by micro-batch and within it by order and key. Documents of one ``_id`` share a
    shard, so a later one follows an earlier one; each shard holds less than ``most`` documents. A body is numbered within its shard,
    and a micro-batch run again gives the same bodies. Start the query with ``streaming.first.start_stateful`` and a processing-time
    trigger, which is how often waiting is looked at.
    """
    shard = F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("shard")
    lines = bulk_lines(documents, options, shard, F.col(options.order_by).alias("o"), F.col(options.key).alias("k"))
    return lines.groupBy("shard").transformWithStateInPandas(CountOrTime(most, seconds), FLUSHED, outputMode="append", timeMode="processingTime")
