"""What a polite client would have made of a stored log of fetches: answers to conditional requests, and its breaker.

Nothing is fetched. A log has a row a request: ``seq`` and ``at`` (its order: by time, then number), ``url``,
``status`` (null: no answer came) and what came back. Windows are taken over a chunk of time of a key and
chunks are carried over by sums and maxima of theirs, so that an address or host with a third of
all requests is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_SECONDS = 3600


def _chunked(log: DataFrame, seconds: int) -> DataFrame:
    return log.withColumns({"_chunk": F.floor(F.col("at").cast("timestamp").cast("double") / seconds), "_order": F.struct("at", "seq")})


def answered(log: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``log`` with ``answer``: the number of the request whose response a request is answered with.

    A response of status 200 with an ``etag`` or ``last_modified`` is stored for its url until the next such one;
    304 is answered by the stored one, if there is one, and everything else by itself.
    """
    rows = _chunked(log, seconds)
    kept = (F.col("status") == 200) & (F.concat(F.coalesce("etag", F.lit("")), F.coalesce("last_modified", F.lit(""))) != "")
    stored = F.when(kept, F.col("seq"))
    narrow = rows.select("url", "_chunk", "_order", "seq", stored.alias("stored"), (F.col("status") == 304).alias("unchanged"))
    ends = narrow.filter("stored is not null").groupBy("url", "_chunk").agg(F.max_by("stored", "_order").alias("end"))
    all_chunks = narrow.select("url", "_chunk").distinct().join(ends, ["url", "_chunk"], "left")
    before = Window.partitionBy("url").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_chunks.select("url", "_chunk", F.last("end", ignorenulls=True).over(before).alias("carry"))
    within = Window.partitionBy("url", "_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    asked = narrow.withColumn("here", F.last("stored", ignorenulls=True).over(within)).filter("unchanged").join(carried, ["url", "_chunk"])
    found = asked.select("seq", F.coalesce("here", "carry", "seq").alias("_answer"))
    return log.join(found, "seq", "left").withColumn("answer", F.coalesce("_answer", "seq")).drop("_answer")


def responses(log: DataFrame, *fields: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``seq, answer`` and ``fields`` (status, body, ...) of the response that each request is answered with."""
    of = log.select(F.col("seq").alias("answer"), *fields)
    return answered(log, seconds).select("seq", "answer").join(of, "answer").select("seq", "answer", *fields)


def failed(status: Column) -> Column:
    """No answer, or an error's status."""
    return F.coalesce(status >= 400, F.lit(True))


def blocked(log: DataFrame, threshold: int = 5, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``log`` (with ``run`` and ``host``) and ``blocked``: whether the breaker would have held a request back.

    A host's breaker opens with its ``threshold``-th failure in a row and stays open for the rest of the run, as
    nothing that could succeed is sent any more. Runs of failures are islands between successes; one that
    begins in an earlier chunk goes on with the failures at the end of that.
    """
    key = ["run", "host"]
    rows = _chunked(log, seconds).withColumn("_bad", failed(F.col("status")))
    narrow = rows.select(*key, "_chunk", "_order", "_bad")
    upto = Window.partitionBy(*key, "_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    islands = narrow.withColumn("island", F.count_if(~F.col("_bad")).over(upto))
    sizes = islands.groupBy(*key, "_chunk", "island").agg(F.count_if("_bad").alias("bad"))
    ends = sizes.groupBy(*key, "_chunk").agg(F.max_by("bad", "island").alias("bad"), (F.max("island") > 0).alias("broken"))
    chunks = Window.partitionBy(*key).orderBy("_chunk")
    parted = ends.withColumn("since", F.count_if("broken").over(chunks))
    going = Window.partitionBy(*key, "since").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    # failures in a row at a chunk's end, then what the next chunk begins with
    at_end = parted.withColumn("row", F.sum("bad").over(going))
    carried = at_end.select(*key, "_chunk", F.coalesce(F.lag("row").over(chunks), F.lit(0)).alias("carry"))
    nth = Window.partitionBy(*key, "_chunk", "island").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    counted = islands.withColumn("n", F.count_if("_bad").over(nth)).filter("_bad").join(carried, [*key, "_chunk"])
    in_row = F.col("n") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0)
    opened = counted.filter(in_row >= threshold).groupBy(*key).agg(F.min("_order").alias("opened"))
    marked = rows.join(opened, key, "left").withColumn("blocked", F.coalesce(F.col("_order") > F.col("opened"), F.lit(False)))
    return marked.drop("_chunk", "_order", "_bad", "opened")
