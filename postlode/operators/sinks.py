"""Exports of ranked postings and of a run's small state files."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions.text import console_safe
from postlode.operators.order import top
from postlode.operators.reports import CSV_COLUMNS

#: Search answers that a capture writes at most: their number is a run's quota.
MOST_CAPTURES = 1_000


def write_csv(ranked: DataFrame, path: str, order: str = "_seq") -> None:
    """CSV of the export's columns, best first, as part files in order, each with a head; an empty table gives the head alone (K1)."""
    best = ranked.orderBy(F.desc("relevance_score"), F.asc(order))
    best.select(*CSV_COLUMNS).write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="")


def _store(spark: SparkSession, path: str):
    """(file system, path) of an address in any store that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file under another name, then move it in place of what was there."""
    fs, to = _store(spark, path)
    _, own = _store(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(own, to):
        raise OSError(f"cannot move {own} to {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_slugs(slugs: DataFrame, path: str, providers: tuple[str, ...] = ("greenhouse", "lever", "ashby", "workable")) -> None:
    """``provider, slugs`` as a YAML file: a list of sorted names a provider, in fixed order."""
    held = {r.provider: sorted(r.slugs) for r in slugs.filter(F.col("provider").isin(*providers)).collect()}
    lines = [f"{p}:\n" + "".join(f"  - {json.dumps(x, ensure_ascii=False)}\n" for x in held.get(p, [])) for p in providers]
    write_bytes(slugs.sparkSession, path, "\n".join(lines).encode())


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    """``provider, slugs`` of such a file; a missing file and empty sections give none."""
    import yaml

    fs, at = _store(spark, path)
    data = yaml.safe_load(read_bytes(spark, path)) if fs.exists(at) else None
    rows = [(str(p), [str(x).strip() for x in v if str(x).strip()]) for p, v in (data or {}).items() if isinstance(v, list)]
    return spark.createDataFrame(rows, "provider string, slugs array<string>")


def write_usage(usage: DataFrame, path: str, month: str) -> None:
    """One month's counts (``month, provider, used``) as a JSON file that replaces the last (K9)."""
    counts = {r.provider: r.used for r in usage.filter(F.col("month") == month).select("provider", "used").orderBy("provider").collect()}
    write_bytes(usage.sparkSession, path, json.dumps({"month": month, "counts": counts}).encode())


def read_usage(spark: SparkSession, path: str, month: str) -> DataFrame:
    """``month, provider, used`` of such a file; none where it is missing, damaged or of another month."""
    fs, at = _store(spark, path)
    try:
        data = json.loads(read_bytes(spark, path)) if fs.exists(at) else {}
    except ValueError:
        data = {}
    counts = data.get("counts") if isinstance(data, dict) and data.get("month") == month else None
    rows = [(month, str(k), int(v)) for k, v in counts.items()] if isinstance(counts, dict) else []
    return spark.createDataFrame(rows, "month string, provider string, used bigint")


def write_captures(answers: DataFrame, folder: str) -> None:
    """Search answers (``place, query, data``: JSON text) as one file each, named by place and query (K8)."""
    rows = answers.select("place", "query", "data").orderBy("place").limit(MOST_CAPTURES + 1).collect()
    if len(rows) > MOST_CAPTURES:
        raise ValueError(f"over {MOST_CAPTURES} answers")
    for r in rows:
        safe = re.sub(r"[^a-z0-9]+", "_", r["query"].lower()).strip("_")[:60]
        content = json.dumps({"query": r["query"], "data": json.loads(r.data)}, ensure_ascii=False, indent=2)
        write_bytes(answers.sparkSession, f"{folder}/{r.place:02d}_{safe}.json", content.encode())


def top_lines(ranked: DataFrame, count: int = 5) -> list[str]:
    """A console's lines of the best postings: place, score, title, company, location in ASCII."""
    shown = [console_safe(F.col(c)).alias(c) for c in ("job_title", "company_name", "location")]
    rows = top(ranked, count).select("relevance_score", *shown).collect()
    return [f"{i}. {r.relevance_score:3d}  " + " | ".join(r[1:]) for i, r in enumerate(rows, 1)]


def write_sheets(ranked: DataFrame) -> bool:
    """The online spreadsheet is not connected: nothing is written (K4)."""
    return False


def write_notes(ranked: DataFrame) -> bool:
    """The online notebook is not connected: nothing is written (K5)."""
    return False
