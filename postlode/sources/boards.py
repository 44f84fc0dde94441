"""Boards that publish their postings as JSON, as rows of the posting schema with ``_file`` and ``_at``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.functions import classify
from postlode.functions.text import html_to_text, prettify_slug, strip_white
from postlode.schema import conform, text_blob
from postlode.sources.payload import field, files, first, inner, listed, objects, stem

PAGES = 5


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    return conform(df.select("_file", "_at", *[c.alias(n) for n, c in columns.items()]), "_file", "_at")


def relevant(df: DataFrame, text: Column | None = None) -> DataFrame:
    return df.filter(classify.is_relevant(F.lower(text_blob() if text is None else text)))


def _pay() -> Column:
    low, high = field("salary_min"), field("salary_max")
    return (
        F.when(field("salary") != "", field("salary"))
        .when((low != "") & (high != ""), F.concat(low, F.lit("-"), high))
        .when(low != "", F.concat(low, F.lit("+")))
        .otherwise("")
    )


def remoteok(spark: SparkSession, path: str) -> DataFrame:
    """A flat array; elements without a position are notices."""
    rows = objects(files(spark, path)).filter(F.map_contains_key("_o", F.lit("position")))
    about = F.when(field("description") != "", field("description")).otherwise(listed("tags", " "))
    return relevant(
        mapped(
            rows,
            job_title=field("position"), company_name=field("company"), location=first(field("location"), F.lit("Remote")),
            remote_type=F.lit("remote"), region=F.lit("worldwide"), source_platform=F.lit("remoteok"), job_url=first(field("url"), field("apply_url")),
            date_posted=field("date"), job_description=html_to_text(about), required_skills=listed("tags"), salary=_pay(),
        )
    )


def remotive(spark: SparkSession, path: str) -> DataFrame:
    """One file a search, in name order; each address once across searches."""
    about = html_to_text(field("description"))
    startup = F.lower(about).rlike("startup|early-stage|saas|yc")
    rows = mapped(
        objects(files(spark, path), "jobs"),
        job_title=field("title"), company_name=field("company_name"), location=first(field("candidate_required_location"), F.lit("Remote")),
        remote_type=F.lit("remote"), region=F.lit("worldwide"), source_platform=F.lit("remotive"), job_url=field("url"), date_posted=field("publication_date"),
        job_description=about, required_skills=listed("tags"), salary=field("salary"), is_startup_likely=startup,
    )
    turn = F.row_number().over(Window.partitionBy("job_url").orderBy("_file", "_at"))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def arbeitnow(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a general board, the first five files (S3)."""
    place = field("location")
    german = F.lower(place).rlike("germany|berlin")
    return relevant(
        mapped(
            objects(files(spark, path).orderBy("_file").limit(PAGES), "data"),
            job_title=field("title"), company_name=field("company_name"), location=place, remote_type=F.when(field("remote") != "", "remote").otherwise("unknown"),
            region=F.lit("europe"), country=F.when(german, "germany").otherwise(""), source_platform=F.lit("arbeitnow"), job_url=field("url"),
            date_posted=field("created_at"), job_description=html_to_text(field("description")), required_skills=listed("tags"),
        )
    )


def workingnomads(spark: SparkSession, path: str) -> DataFrame:
    """A flat array whose titles decide."""
    title = strip_white(field("title"))
    rows = relevant(objects(files(spark, path)), title)
    return mapped(
        rows,
        job_title=F.substring(title, 1, 160), company_name=first(F.substring(strip_white(field("company_name")), 1, 80), F.lit("Unknown")),
        location=first(strip_white(field("location")), F.lit("Remote")), remote_type=F.lit("remote"), source_platform=F.lit("workingnomads"), source_type=F.lit("feed"),
        job_url=field("url"), date_posted=field("pub_date"), job_description=html_to_text(field("description")), required_skills=F.substring(listed("tags"), 1, 300),
    )


def _company_board(rows: DataFrame, provider: str, title: Column, **columns: Column) -> DataFrame:
    """Rows whose titles are searched for; the file's name is the company's slug."""
    slug = stem(F.col("_file"))
    fixed = {"company_name": prettify_slug(slug), "source_platform": F.concat(F.lit(provider + ":"), slug), "source_type": F.lit("ats_api")}
    return mapped(rows.filter(classify.is_board_title(F.lower(title))), job_title=title, **{**fixed, **columns})


def greenhouse(spark: SparkSession, path: str) -> DataFrame:
    return _company_board(
        objects(files(spark, path), "jobs"), "greenhouse", field("title"), location=field("name", inner("location")),
        job_url=field("absolute_url"), date_posted=field("updated_at"), job_description=html_to_text(field("content"), limit=7000),
    )


def lever(spark: SparkSession, path: str) -> DataFrame:
    about = inner("categories")
    parts = (field("commitment", about), field("team", about), html_to_text(field("description"), limit=7000))
    return _company_board(
        objects(files(spark, path)), "lever", field("text"), location=field("location", about), job_url=first(field("hostedUrl"), field("applyUrl")),
        date_posted=field("createdAt"), job_description=F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]),
    )


def ashby(spark: SparkSession, path: str) -> DataFrame:
    return _company_board(
        objects(files(spark, path), "jobs"), "ashby", field("title"), location=field("location"), remote_type=F.when(field("isRemote") != "", "remote").otherwise("unknown"),
        job_url=first(field("jobUrl"), field("applyUrl")), date_posted=field("publishedAt"),
        job_description=first(field("descriptionPlain"), html_to_text(field("descriptionHtml"), limit=7000)),
    )


def workable(spark: SparkSession, path: str) -> DataFrame:
    named = files(spark, path).withColumn("_name", F.coalesce(F.get_json_object("body", "$.name"), F.lit("")))
    work = F.lower(field("workplace_type"))
    remote = F.when((field("telecommuting") != "") | work.contains("remote"), "remote").when(work.contains("hybrid"), "hybrid").otherwise("unknown")
    place = F.concat_ws(" ", F.nullif(field("city"), F.lit("")), F.nullif(field("country"), F.lit("")))
    return _company_board(
        objects(named, "jobs"), "workable", field("title"), company_name=first(F.col("_name"), prettify_slug(stem(F.col("_file")))),
        location=first(place, field("location")), remote_type=remote, job_url=first(field("url"), field("application_url")),
        date_posted=first(field("published_on"), field("created_at")), job_description=html_to_text(field("description"), limit=7000),
    )


#: Company boards in the order in which a run reads them.
COMPANY_BOARDS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable}


def ats(spark: SparkSession, path: str, slugs: dict[str, list[str]] | None = None) -> DataFrame:
    """All company boards, of which ``path`` has a folder each: boards in fixed order, companies as ``slugs`` lists them (else by name), so that a limit cuts them together."""
    parts = []
    for place, (name, read) in enumerate(COMPANY_BOARDS.items()):
        if slugs is not None and not slugs.get(name):
            continue
        rows, company = read(spark, f"{path}/{name}"), stem(F.col("_file"))
        if slugs is not None:
            listed = F.array_position(F.array(*[F.lit(s) for s in slugs[name]]), company)
            rows = rows.filter(listed > 0).withColumn("_file", F.concat(F.lit(f"{place} "), F.lpad(listed.cast("string"), 9, "0")))
        else:
            rows = rows.withColumn("_file", F.concat(F.lit(f"{place} "), "_file"))
        parts.append(rows)
    none = spark.createDataFrame([], "_o map<string,string>, _file string, _at int")
    return reduce(DataFrame.unionByName, parts, mapped(none))
