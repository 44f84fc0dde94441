"""Six literal postings that exercise a run from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.schema import conform

_NAMES = "job_title company_name location country region remote_type seniority is_startup_likely salary job_url job_description required_skills".split()
_SITE = "https://mock-jobs.local/"

#: The rows, in the order of ``_NAMES``.
ROWS = (
    ("Junior AI Automation Specialist", "FlowPilot AI", "Remote Germany", "germany", "dach", "remote", "junior", True, "50.000 EUR year", _SITE + "flowpilot-ai-automation-specialist",
     "Build workflow automation with AI agents, n8n, webhooks, APIs, and MCP server integrations. Junior role, 0-2 years experience, 50.000 EUR year, 36 hours per week.",
     "AI agents, n8n, MCP server, APIs, workflow automation"),
    ("MCP Integration Engineer", "AgentStack Labs", "Hybrid Berlin", "germany", "dach", "hybrid", "entry_level", True, "56.000 EUR year", _SITE + "agentstack-mcp-integration-engineer",
     "Implement Model Context Protocol connectors, agentic systems, LLM tooling, and internal AI workflows. Entry level candidates welcome. Compensation 56.000 EUR year, 35 hours weekly.",
     "Model Context Protocol, LLM, agentic systems, Python, APIs"),
    ("Senior QA Automation Engineer", "TestSuite GmbH", "Onsite Munich", "germany", "dach", "onsite", "senior", False, "70.000 EUR year", _SITE + "testsuite-senior-qa-automation",
     "Senior QA automation role with Selenium, Cypress, Playwright testing, and 7+ years experience.",
     "Selenium, Cypress, QA automation"),
    ("AI Workflow Specialist", "OpsCraft", "Remote Europe", "", "europe", "remote", "junior", False, "", _SITE + "opscraft-ai-workflow-specialist",
     "Design AI workflow automation for operations teams using Zapier, Make.com, OpenAI, RAG, and CRM integrations. Junior applicants welcome. Salary not listed. Full-time 40 hours per week.",
     "OpenAI, Zapier, Make.com, RAG, CRM automation"),
    ("Graphic Designer - AI Content", "BrandSpark", "Remote", "", "worldwide", "remote", "unknown", False, "", _SITE + "brandspark-graphic-designer-ai",
     "Create marketing visuals with AI tools. No automation, agent, MCP, or workflow engineering ownership.",
     "Graphic design, AI image tools, marketing"),
    ("AI Automation Engineer", "ScaleCorp Enterprise", "Remote Europe", "", "europe", "remote", "junior", False, "50.000 EUR year", _SITE + "scalecorp-ai-automation-engineer",
     "Join our enterprise automation team building AI agents, n8n workflows, LLM tooling, and MCP server integrations. We are a team of 2,500 employees. Junior friendly, 50.000 EUR year, 35 hours per week.",
     "AI agents, n8n, MCP server, workflow automation"),
)


def mock(spark: SparkSession, path: str = "") -> DataFrame:
    """The literal rows; ``path`` is not read."""
    kinds = ", ".join(f"{n} {'boolean' if n == 'is_startup_likely' else 'string'}" for n in _NAMES)
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], f"{kinds}, _at int").coalesce(1)
    told = {"language": F.lit("en"), "source_platform": F.lit("mock_websites"), "source_type": F.lit("mock"), "_file": F.lit("")}
    return conform(rows.withColumns(told), "_file", "_at")
