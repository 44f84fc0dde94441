"""Postings and calls as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlode.operators.dedup import prepare
from postlode.operators.joins import unseen
from postlode.state import PostingTable


def track(stream: DataFrame, table: PostingTable, on_new: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert every row of a stream of postings with ``_seq``; rows whose key the table lacks go to ``on_new`` first.

    ``on_new`` gets the rows and the batch's number and must overwrite by that number: a batch
    that failed between it and the upsert comes again. Seen keys are the table's, so no state grows.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = prepare(batch)
        on_new(unseen(rows, table.known_keys()), number)
        table.upsert(rows)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def monthly_calls(calls: DataFrame) -> DataFrame:
    """``month, provider, used`` of a stream of (provider, ts): state is one row a month and provider. For update mode."""
    return calls.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "provider").agg(F.count("*").alias("used"))


def guarded_calls(calls: DataFrame, limits: dict[str, int], block_ratio: float = 0.95) -> DataFrame:
    """``event_id, provider`` of a stream of calls (event_id, provider, ts) that the monthly guard lets through.

    State is a provider's month and its calls so far; the first call of another month begins anew.
    Calls of a batch are taken in order of time; a batch must not hold calls before those of an earlier one. A
    provider without limit is never blocked.
    """
    most = {p: int(n * block_ratio) for p, n in limits.items()}

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        month, used = state.get if state.exists else ("", 0)
        rows = pd.concat([b[["event_id", "ts"]] for b in batches]).sort_values(["ts", "event_id"])
        months = rows.ts.dt.strftime("%Y-%m")
        place = rows.groupby(months).cumcount() + 1 + (months == month) * used
        last = months.iloc[-1]
        state.update((last, int((months == last).sum()) + (used if last == month else 0)))
        some = rows[place <= most[key[0]]] if key[0] in most else rows
        yield pd.DataFrame({"event_id": some.event_id, "provider": key[0]})

    return calls.groupBy("provider").applyInPandasWithState(
        count, "event_id long, provider string", "month string, used long", "append", GroupStateTimeout.NoTimeout
    )
