import datetime
import random

import pytest

from postlode.operators import fetchlog

START = datetime.datetime(2025, 3, 1)
SCHEMA = "seq long, at timestamp, url string, run string, host string, status int, etag string, last_modified string, body string"


def made(seed, n, bad):
    rng, rows, at = random.Random(seed), [], START
    for seq in range(n):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 60, 1500, 5000]))
        host = rng.choice(["a", "a", "a", "b"])
        status = rng.choice([500, None, 404] if rng.random() < bad else [200, 304, 302])
        rows.append((seq, at, f"http://{host}/{rng.randrange(3)}", f"r{seq * 2 // n}", host, status, rng.choice([None, "", "e"]), rng.choice([None, "m"]), f"b{seq}"))
    return rows


def replay(rows, threshold):
    """Request by request, as a client meets them."""
    cache, fails, open_, out = {}, {}, set(), {}
    for seq, _, url, run, host, status, etag, modified, body in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (run, host)
        answer = cache.get(url, seq) if status == 304 else seq
        if status == 200 and (etag or modified):
            cache[url] = seq
        out[seq] = (answer, key in open_)
        fails[key] = fails.get(key, 0) + 1 if status is None or status >= 400 else 0
        if fails[key] >= threshold:
            open_.add(key)
    return out


@pytest.mark.parametrize("seed,bad,seconds", [(1, 0.5, 3600), (2, 0.6, 60), (3, 0.7, 10**9), (4, 0.5, 1)])
def test_log_is_answered_as_request_by_request(spark, seed, bad, seconds):
    rows = made(seed, 300, bad)
    random.Random(seed).shuffle(rows)
    log, want = spark.createDataFrame(rows, SCHEMA), replay(rows, 4)
    got = fetchlog.responses(log, "body", seconds=seconds).collect()
    assert {r.seq: r.answer for r in got} == {k: v[0] for k, v in want.items()} and all(r.body == f"b{r.answer}" for r in got)
    held = {r.seq: r.blocked for r in fetchlog.blocked(log, 4, seconds).collect()}
    # once open, a breaker stays so, whatever the log has afterwards
    assert held == {k: v[1] for k, v in want.items()} and 0 < sum(held.values()) < len(held)


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert fetchlog.responses(log, "status").collect() == [] and fetchlog.blocked(log).collect() == []
