"""Views of the driver's tables as postings.

The tables hold invented prose without posting vocabulary, so each document is laid under one
of a few literal templates (title, company, place, pay, wording), which exercise the
classifiers; its whole text stays in the description. Addresses repeat and carry tracking
parameters, so that repeats arise. The SQL twin of the view is made from the same templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.schema import conform

#: title, company, location, salary, wording
TEMPLATES: tuple[tuple[str, str, str, str, str], ...] = (
    ("Junior AI Automation Specialist (m/w/d)", "FlowWerk GmbH", "Remote Germany", "52.000 EUR year", "Build n8n workflows with LLM tooling, 35 hours per week. Early-stage startup, team of 12."),
    ("AI Automation Specialist (m/f/d)", "FlowWerk GmbH", "Remote Germany", "", "Build n8n workflows and AI agents for a SaaS product."),
    ("Senior DevOps Engineer", "Müller & Söhne AG", "München, Germany", "70.000 EUR year", "Lead our platform team, 7+ years required, onsite in the office."),
    ("Workflow Automation Engineer", "Unknown", "Hybrid Berlin", "4.500 EUR monthly", "Zapier, Make.com and REST API integrations, 40 hours weekly."),
    ("Werkstudent KI Automatisierung", "Straßenbau Köln", "Köln", "", "Unterstütze uns mit KI Agenten, 20 Stunden pro Woche."),
    ("Account Executive", "SAP SE", "Zurich, Switzerland", "90 k eur year", "Enterprise sales of AI software, 10+ years."),
    ("Prompt Engineer", "Delta Labs Ltd", "Cairo, Egypt", "20,000 EGP month", "LLM and RAG prototypes for clients."),
    ("n8n Automation Specialist", "Été Conseil", "Paris, France", "45.000 EUR year", "Freelance and permanent, 51-200 employees."),
    ("Applied AI Engineer", "Northwind Inc", "London, UK", "", "Agentic AI systems. 1,200 employees worldwide."),
    ("Graphic Designer", "BrandSpark", "Anywhere", "", "Marketing visuals with AI tools, no workflow ownership."),
    ("Инженер по автоматизации ИИ", "Вектор", "удаленно", "", "Стажировка, работа из дома, без опыта."),
    ("QA Automation Engineer", "TestSuite GmbH", "Vienna, Austria", "3.900 EUR month", "Selenium, Cypress and playwright testing. 500+ employees."),
    ("MCP Integration Engineer", "Agent Stack", "Remote Europe", "56.000 EUR year", "Model Context Protocol connectors, 36 hours per week, graduate programme."),
    ("MCP  Integration\tEngineer", "Agent Stack", "Remote Europe", "", "Model Context Protocol connectors and more of the same."),
    ("AI Solutions Engineer", "Lakh Systems", "Pune, India", "12 lakhs", "Customer projects with OpenAI."),
    ("Data Entry Clerk", "Konzern Holding", "Madrid, Spain", "", "Typing all day. Corporation with 25,000+ people."),
    ("Trainee Operations", "Kleinbetrieb", "Hamburg", "", "Mittelstand company, internal CRM automation, trainee position."),
    ("LLM Engineer", "Siemens", "Munich", "65,000 eur year", "Vector database and embeddings, 38 hours, work from home possible."),
    ("RevOps Automation Specialist", "Gtm.io", "Amsterdam, Netherlands", "", "B2B revops with Airtable and Notion, 2+ years."),
    ("Internship AI Workflow", "", "Singapore", "", "Internship with AI workflow tasks, team size 8."),
    ("Praktikum KI Automatisierung", "Größer Werke", "Stuttgart / remote", "", "Praktikum mit Zapier, Homeoffice möglich, 32 std. pro Woche."),
    ("Site Reliability Engineer", "Cloudflare", "Toronto, Canada", "", "SRE for AI infrastructure, staff level, 5-10 people."),
    ("No-Code AI Automation Specialist", "Tiny Startup", "Worldwide", "54k eur year", "Startup, y combinator backed, seed stage, 36 h / week."),
    ("Customer Support Agent", "HelpNow LLC", "Manila, Philippines", "", "Customer support for SaaS, remote worldwide."),
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; one whose splits leave half the cores idle (a small file may be a single row group) is dealt over all."""
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return read.repartition(cores) if 2 * read.rdd.getNumPartitions() <= cores else read


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings before cleaning, in ``_seq`` order (the document's id)."""
    rows = [(i, *t) for i, t in enumerate(TEMPLATES)]
    names = ["_k", "job_title", "company_name", "location", "salary", "_wording"]
    templates = F.broadcast(spark.createDataFrame(rows, names))  # literal, two dozen rows
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    number = (F.col("doc_id") - F.col("doc_id") % 3).cast("string")
    host = F.when(F.col("doc_id") % 2 == 0, "https://Jobs.Example.com").otherwise("https://jobs.example.com")
    tail = F.when(F.col("doc_id") % 7 == 0, "/?utm_source=feed&id=5#top").when(F.col("doc_id") % 7 == 1, "?id=5&ref=x").otherwise("?id=5")
    url = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(host, F.lit("/Post/"), number, tail))
    joined = docs.join(templates, docs.doc_id % len(TEMPLATES) == templates["_k"])
    return joined.select(
        F.col("doc_id").alias("_seq"),
        "job_title",
        "company_name",
        "location",
        "salary",
        F.concat_ws(" ", "_wording", F.coalesce("text", F.lit(""))).alias("job_description"),
        url.alias("job_url"),
        F.col("source").alias("source_platform"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the posting schema with ``_seq``."""
    return conform(raw_postings(spark, sf_dir), "_seq", now="2025-01-01T00:00:00+00:00")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings made of whole documents: the first words as title, the source as company (each fifth unknown)."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    # only the words that a title may take, so that no text is searched to its end
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,5}", 0)
    words = F.regexp_extract_all(head, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = documents(spark, sf_dir).select(
        i.alias("_seq"),
        F.array_join(F.slice(words, F.lit(1), (3 + i % 3).cast("int")), " ").alias("job_title"),
        F.when(i % 5 == 0, "Unknown").otherwise(F.col("source")).alias("company_name"),
        F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(" EUR"))).otherwise("").alias("salary"),
        text.alias("job_description"),
    )
    return conform(rows, "_seq", now="2025-01-01T00:00:00+00:00")
