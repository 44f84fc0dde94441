"""Vocabulary of the engine: term lists, hint tables and limits.

Everything here is a fixed value that results depend on; term lists are defaults of
``TargetingProfile``, which can be overridden for each run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# ---- Fixed values: terms that mark titles, skills, seniority and ways of working ----

TARGET_TITLES = (
    "junior applied ai engineer", "applied ai engineer", "ai automation engineer", "ai automation specialist",
    "junior ai automation specialist", "agentic ai engineer", "ai agents engineer", "ai agent engineer",
    "llm automation engineer", "llm engineer", "no-code automation engineer", "no-code ai automation specialist",
    "low-code automation engineer", "low-code ai automation specialist", "n8n automation specialist",
    "junior n8n specialist", "make.com automation engineer", "zapier automation specialist",
    "workflow automation engineer", "junior workflow automation specialist", "ai workflow specialist",
    "gtm engineer ai", "gtm automation engineer ai", "ai solutions engineer", "junior ai solutions specialist",
    "forward deployed ai engineer", "ai implementation specialist", "ai enablement specialist",
    "ai process automation specialist", "ai operations engineer", "business process automation specialist ai",
    "ai agents specialist", "junior ai agent engineer", "agentic systems engineer", "llm automation specialist",
    "mcp server developer", "mcp integration engineer", "ai tooling engineer", "revops automation specialist",
    "sales automation specialist ai", "operations automation specialist", "technical solutions engineer ai",
    "junior ki engineer", "ki automatisierung", "workflow automatisierung", "no-code automatisierung",
    "low-code automatisierung", "ki agenten", "ki lösungen", "werkstudent ki automatisierung",
    "praktikum ki automatisierung", "berufseinsteiger ki", "младший инженер ии", "начинающий инженер ии",
    "инженер по автоматизации ии", "специалист по автоматизации ии", "инженер llm", "инженер ai agents",
    "специалист n8n", "специалист make.com", "специалист zapier",
)

JUNIOR_TERMS = (
    "junior", "entry level", "entry-level", "internship", "intern", "associate", "graduate", "trainee",
    "working student", "early career", "new grad", "beginner", "0-1 years", "0-2 years", "1+ years", "2+ years",
    "werkstudent", "werkstudentin", "praktikum", "praktikant", "praktikantin", "berufseinsteiger",
    "berufseinsteigerin", "einstiegsposition", "absolvent", "absolventin", "0-1 jahre", "0-2 jahre", "1+ jahre",
    "2+ jahre", "младший", "начинающий", "стажер", "стажёр", "стажировка", "выпускник", "без опыта",
    "начальный уровень",
)

SENIOR_TERMS = (
    "senior", "staff", "principal", "lead", "manager", "director", "head of", "vp", "5+ years", "6+ years",
    "7+ years", "8+ years", "10+ years", "leiter", "leitung", "direktor", "teamlead", "teamleiter", "5+ jahre",
    "6+ jahre", "7+ jahre", "10+ jahre", "старший", "ведущий", "руководитель", "менеджер", "директор", "глава", "лид",
    "тимлид", "5+ лет", "6+ лет", "7+ лет", "10+ лет",
)

REMOTE_TERMS = (
    "fully remote", "remote-first", "remote friendly", "worldwide remote", "remote europe", "remote germany",
    "remote dach", "remote", "work from home", "distributed team", "homeoffice", "home-office", "fernarbeit",
    "ortsunabhängig", "deutschlandweit remote", "europaweit remote", "удаленно", "удалённо", "работа из дома",
    "дистанционно", "полностью удаленно", "полностью удалённо", "удаленная работа", "удалённая работа",
)

HYBRID_TERMS = (
    "hybrid", "partly remote", "teilweise remote", "гибрид",
)

AUTOMATION_TERMS = (
    "automation", "workflow automation", "mcp server", "model context protocol", "business process automation",
    "operations automation", "no-code", "low-code", "n8n", "make.com", "zapier", "airtable", "notion",
    "google sheets", "webhooks", "rest api", "integrations", "crm automation", "sales automation",
    "marketing automation", "gtm automation", "automatisierung", "автоматизация",
)

AI_TERMS = (
    "ai", "artificial intelligence", "ki", "ии", "llm", "large language models", "gpt", "openai", "claude",
    "anthropic", "gemini", "mistral", "llama", "langchain", "langgraph", "mcp server", "model context protocol",
    "rag", "embeddings", "vector database", "prompt engineering", "ai agents", "agentic ai", "autonomous agents",
)

ENGINEERING_TERMS = (
    "python", "javascript", "typescript", "sql", "fastapi", "node.js", "git", "docker", "aws", "gcp", "azure",
    "ci/cd", "scraping", "data pipelines", "api", "apis",
)

STARTUP_TERMS = (
    "startup", "early-stage", "early stage", "saas", "b2b", "gtm", "revops", "y combinator", "yc",
)

QA_TERMS = (
    "qa automation", "test automation", "selenium", "cypress", "playwright testing",
)

ROLE_TITLE_TERMS = (
    "engineer", "automation", "automatisierung", "workflow", "solutions", "solution", "implementation", "consultant",
    "specialist", "operations", "llm", "agent", "agents", "n8n", "make.com", "zapier", "no-code", "low-code",
    "ki-umsetzer", "ai enablement", "ai automation specialist", "ai workflow", "mcp server", "model context protocol",
    "ai tooling", "revops", "gtm",
)

UNRELATED_TITLE_TERMS = (
    "grafikdesigner", "graphic designer", "marketing coordinator", "customer support", "customer operations",
    "writing specialist", "kundensupport", "kundenbetreuung", "administrative support", "data entry",
    "robotics automation", "industrial automation", "plc automation", "factory automation", "building automation",
    "marketing automation manager",
)

OFF_TARGET_TITLE_TERMS = (
    "web developer", "web development", "wordpress", "devops", "sre", "site reliability", "account executive",
    "account manager", "business development", "sales representative", "sales development", "graphic", "ux designer",
    "ui designer", "product designer", "recruiter", "talent acquisition", "billing", "bookkeeper", "accountant",
    "payroll", "customer service", "customer success", "customer support", "product support", "support specialist",
    "virtual assistant",
)

EXTRA_AI_TERMS = ("machine learning", "ml", "agentic", "mcp", "model context protocol")

AUTOMATION_TOOL_TERMS = (
    "n8n", "zapier", "make.com", "no-code", "low-code", "no code", "low code", "workflow automation",
    "process automation", "rpa", "robotic process automation", "ai automation", "ki automatisierung",
    "workflow automatisierung",
)

BOARD_TITLE_TERMS = (
    "ai", "ml", "machine learning", "applied ai", "llm", "gpt", "agent", "agents", "agentic", "automation",
    "automatisierung", "workflow", "n8n", "zapier", "make.com", "no-code", "low-code", "rpa", "mcp", "integration",
    "solutions engineer", "forward deployed",
)

GERMAN_HINTS = (
    " der ", " die ", " das ", " und ", " für ", " mit ", "werkstudent", "praktikum", "berufseinsteiger", "ki ",
)

# ---- Fixed values: places ----

REGION_HINTS = {
    "dach": ("germany", "deutschland", "austria", "österreich", "switzerland", "schweiz", "dach", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "düsseldorf", "stuttgart", "vienna", "wien", "zurich", "zürich"),
    "europe": ("europe", "europa", "eu", "netherlands", "amsterdam", "spain", "portugal", "france", "paris", "italy", "poland", "warsaw", "czech republic", "prague", "estonia", "lithuania", "latvia", "sweden", "finland", "denmark", "norway", "uk", "united kingdom", "london", "ireland", "dublin"),
    "america": ("usa", "united states", "canada", "north america", "latin america", "south america", "mexico", "brazil", "argentina"),
    "asia": ("asia", "singapore", "india", "japan", "korea", "thailand", "vietnam", "philippines", "indonesia", "uae", "dubai"),
    "worldwide": ("worldwide", "global", "anywhere", "remote worldwide", "remote emea"),
}

COUNTRY_HINTS = {
    "germany": ("germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "düsseldorf", "stuttgart", "germering"),
    "austria": ("austria", "österreich", "vienna", "wien"),
    "switzerland": ("switzerland", "schweiz", "zurich", "zürich"),
    "usa": ("usa", "united states", "new york", "san francisco"),
    "canada": ("canada", "toronto", "vancouver"),
    "brazil": ("brazil", "brasil", "cabedelo", "são paulo", "sao paulo", "rio de janeiro"),
    "egypt": ("egypt", "cairo"),
    "philippines": ("philippines", "manila"),
    "united kingdom": ("united kingdom", "uk", "london", "england"),
    "spain": ("spain", "madrid", "barcelona"),
    "portugal": ("portugal", "lisbon", "porto"),
    "france": ("france", "paris"),
    "netherlands": ("netherlands", "amsterdam"),
}

#: City as shown: country, region.
CITY_HINTS = {
    "Berlin": ("germany", "dach"),
    "Munich": ("germany", "dach"),
    "München": ("germany", "dach"),
    "Hamburg": ("germany", "dach"),
    "Frankfurt": ("germany", "dach"),
    "Cologne": ("germany", "dach"),
    "Köln": ("germany", "dach"),
    "Düsseldorf": ("germany", "dach"),
    "Stuttgart": ("germany", "dach"),
    "Germering": ("germany", "dach"),
    "Vienna": ("austria", "dach"),
    "Wien": ("austria", "dach"),
    "Zurich": ("switzerland", "dach"),
    "Zürich": ("switzerland", "dach"),
    "London": ("united kingdom", "europe"),
    "Amsterdam": ("netherlands", "europe"),
    "Paris": ("france", "europe"),
    "Madrid": ("spain", "europe"),
    "Barcelona": ("spain", "europe"),
    "Lisbon": ("portugal", "europe"),
    "Cabedelo": ("brazil", "america"),
    "Cairo": ("egypt", "unknown"),
    "Manila": ("philippines", "asia"),
}

PLACE_WORDS = ("dach", "europe", "europa", "worldwide", "remote", "hybrid", "onsite", "asia", "america", "emea", "anywhere")

LOW_COST_PLACES = (
    "india", "indian", "mumbai", "delhi", "new delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "kolkata",
    "pune", "ahmedabad", "gurgaon", "gurugram", "noida", "jaipur", "lucknow", "kanpur", "nagpur", "indore",
    "coimbatore", "chandigarh", "mysore", "mysuru", "thiruvananthapuram", "pakistan", "pakistani", "karachi",
    "lahore", "islamabad", "rawalpindi", "faisalabad", "peshawar", "multan", "quetta", "sialkot", "gujranwala",
    "bangladesh", "bangladeshi", "dhaka", "chittagong", "chattogram", "sri lanka", "sri lankan", "colombo", "nepal",
    "nepali", "nepalese", "kathmandu", "philippines", "philippine", "filipino", "filipina", "manila", "cebu",
    "makati", "davao", "quezon city", "indonesia", "indonesian", "jakarta", "surabaya", "bandung", "vietnam",
    "vietnamese", "hanoi", "ho chi minh", "saigon", "da nang", "nigeria", "nigerian", "abuja", "ibadan", "kenya",
    "kenyan", "nairobi", "mombasa", "ghana", "ghanaian", "accra", "kumasi", "egypt", "egyptian", "cairo", "giza",
)

#: Regular expressions of low-wage currencies.
LOW_COST_PAY = (
    "\\bpkr\\b", "\\binr\\b", "\\bbdt\\b", "\\bngn\\b", "\\blkr\\b", "\\bnpr\\b", "\\bidr\\b", "\\bvnd\\b",
    "\\begp\\b", "\\bkes\\b", "\\bghs\\b", "₨", "₹", "৳", "₦", "₱", "₫", "\\brupees?\\b", "\\blakhs?\\b",
    "\\bcrores?\\b", "\\bnaira\\b", "\\btaka\\b", "\\brupiah\\b", "\\bcedi\\b", "\\brs\\.?\\s?\\d",
)

# ---- Fixed values: web-search results; the domain lists are sets, so their order means nothing ----

BLOCKED_DOMAINS = (
    "aiexpertmagazine.com", "anthropic.com", "bdjobs.com", "bing.com", "brightermonday.com", "careerexplorer.com",
    "community.n8n.io", "dev.to", "dictionary.com", "duckduckgo.com", "facebook.com", "foundit.in",
    "freecodecamp.org", "geeksforgeeks.org", "genaisummit.eu", "github.com", "github.io", "gitlab.com",
    "glassdoor.co.in", "glassdoor.com", "glassdoor.de", "google.com", "hashnode.dev", "hirist.com", "imdb.com",
    "indeed.in", "indeed.pk", "instagram.com", "instahyre.com", "jobberman.com", "jobicy.com", "jobleads.com",
    "kalibrr.com", "kdnuggets.com", "linkedin.com", "medium.com", "merriam-webster.com", "monsterindia.com",
    "mustakbil.com", "naukri.com", "netflix.com", "openai.com", "platform.openai.com", "quora.com", "reval.site",
    "rottentomatoes.com", "rozee.pk", "shine.com", "stackoverflow.com", "substack.com", "talentsurge.io",
    "themoviedb.org", "timesjobs.com", "topcv.vn", "towardsdatascience.com", "twitter.com", "vietnamworks.com",
    "w3schools.com", "wikipedia.org", "wiktionary.org", "wuzzuf.net", "x.com", "yahoo.com", "youtube.com",
)

WEAK_AGGREGATORS = (
    "bebee.com", "careerjet.com", "careerjet.ua", "indeed.com", "jooble.org", "ziprecruiter.com",
)

BOARD_DOMAINS = (
    "africashore.com", "aidoos.com", "builtin.com", "builtinboston.com", "builtinsf.com", "cvbankas.lt",
    "dailyremote.com", "djinni.co", "eu-startups.com", "euremotejobs.com", "expertini.com", "himalayas.app",
    "hiring.lat", "indeed.com", "jaabz.com", "jobgether.com", "jobrapido.com", "jobserve.com", "jobsora.com",
    "jobspy.net", "jobtensor.com", "learn4good.com", "lensa.com", "meetfrank.com", "neuvoo.com", "onlinejobs.ph",
    "page.gd", "railway.app", "recomlinked.com", "recruit.net", "remotefront.com", "remoterocketship.com",
    "simplyhired.com", "snagajob.com", "social-networking.me", "startup.jobs", "studysmarter.de", "talent.com",
    "talent.outsized.com", "tanqeeb.com", "trabajo.org", "vaia.com", "whatjobs.com", "ziprecruiter.com",
)

GEO_DOMAIN_PARTS = (
    "br", "cabedelo", "de", "egypt", "es", "gb", "ph", "pt", "uk", "us",
)

NOISY_TITLES = (
    "jobs, employment", "hiring now", "what does", "hire an", "hire a", "freelance gigs", "remote jobs matching",
    "job search", "jobs with salaries", "jobs in ", "open jobs", "latest jobs", "salary guide", "salary benchmark",
    "salary report", "career path", "skills & advice", "specializing in", "community", "definition & meaning",
    "official trailer", "testimonials", "jobs - work from home", "best remote", "how to become", "how to ",
    "what is ", "introduction to", "complete setup", "setup guide", "step by step", "step-by-step", "a collection of",
    "tutorial", "ultimate guide", "cheat sheet",
)

NOISY_PATHS = (
    "/jobs?", "/jobs/", "/job-search", "/search", "/salaries", "/career-advice",
)

HARD_NOISY_PATHS = (
    "/services/", "/top", "/u/",
)

EDITORIAL_HOSTS = ("magazine", "wikipedia", "wikihow")

#: A title that counts postings ("1,200+ jobs ...").
COUNTED_TITLE = r"(?U)\b\d{3,}[,\d]*\+?\s+"

# ---- Fixed values: what cannot be a company ----

NO_COMPANY_WORDS = r"(?U)\b(department|abteilung|team|jetzt bewerben|bewerben|apply now|work from home|home office|remote jobs|freelancers?)\b"
NO_COMPANY_ROLES = (
    r"(?U)\b(specialist|engineer|developer|workflow|workflows|automation|automate|manager|analyst|intern|consultant|architect|recruiter)\b"
)
NO_COMPANY_NAMES = ("apply", "careers", "jobs", "remote", "hybrid", "new", "work from home", "freelance")
BARE_DOMAIN = r"^[a-z0-9][a-z0-9-]*\.[a-z]{2,}(?:\.[a-z]{2,})?$"
COMPANY_AFTER = r"(?iU)(?:\bat\s+|\bbei\s+|@\s*)([^|,–—-]+)"
TITLE_PIECES = r"(?U)\s[-|–—]\s"
NO_COMPANY_PIECES = ("jazzhr", "greenhouse", "lever", "workable", "ashby", "apply", "careers", "jobs")
NO_COMPANY_PIECE_WORDS = r"(?U)\b(remote|hybrid|job|jobs|career|careers)\b"
DOMAIN_WORDS = ("com", "co", "io", "jobs", "careers")

# ---- Fixed values: titles and companies without their trimmings ----

TITLE_TAIL = (
    r"(?iU)\s*\|\s*(Jobs?|Careers?|Apply|LinkedIn|Built In.*|Strider Jobs|Visa Sponsorship Jobs|Jetzt bewerben.*|Remote Jobs on.*).*$"
)
TITLE_CALL = r"(?iU)\s*[-–—]\s*(Jetzt bewerben|Apply Now|Work From Home)!?.*$"
COMPANY_TAIL = r"(?iU)\s+(Djinni|JazzHR|Greenhouse|Lever|Ashby|Workable|Built In.*|Jetzt bewerben.*|Apply Now.*)$"
COMPANY_LINK = r"(?iU)\s+(in|im|for|at|bei|f[uü]r)$"

# ---- Fixed values: places in a search result, in order ----

RESULT_PLACES = (
    r"(?iU)\b(remote\s+(germany|europe|dach|worldwide))\b",
    r"(?iU)\b(hybrid\s+(berlin|germany|europe|dach))\b",
    r"(?iU)\b(onsite\s+[^.,;|]{2,40})\b",
    r"(?iU)\b(berlin|munich|münchen|hamburg|frankfurt|germering|vienna|wien|zurich|zürich|london|amsterdam|paris)\b",
)

# ---- Fixed values: slugs of company boards ----

SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
NO_SLUGS = ("embed", "job_board", "j", "jobs", "o", "api", "v1", "v0", "")

PRIORITY_TITLES = (
    "Junior AI Automation Specialist", "AI Automation Specialist", "Junior Workflow Automation Specialist",
    "AI Workflow Specialist", "Junior AI Solutions Specialist", "AI Implementation Specialist",
    "AI Enablement Specialist", "AI Process Automation Specialist", "Business Process Automation Specialist AI",
    "No-Code AI Automation Specialist", "Low-Code AI Automation Specialist", "n8n Automation Specialist",
    "Junior n8n Specialist", "AI Agents Specialist", "Junior AI Agent Engineer", "Agentic Systems Engineer",
    "LLM Automation Specialist", "MCP Server Developer", "MCP Integration Engineer", "AI Tooling Engineer",
    "RevOps Automation Specialist", "GTM Automation Engineer AI", "Sales Automation Specialist AI",
    "Operations Automation Specialist",
)

CONCEPT_QUERIES = (
    '"workflow automation" "AI agents"', '"MCP server" "AI agents"', '"agentic systems" engineer',
    '"Model Context Protocol" engineer', '"LLM automation" workflow',
)

SEARCH_SITES = (
    "site:join.com", "site:wellfound.com", "site:ycombinator.com/jobs", "site:berlinstartupjobs.com",
    "site:germantechjobs.de",
)

REGION_TERMS = {
    "germany": ("Germany", "Remote Germany", "Hybrid Germany"),
    "dach": ("Germany", "DACH", "Remote DACH", "Austria", "Switzerland"),
    "europe": ("Germany", "DACH", "Europe", "Remote Europe", "Hybrid Europe"),
    "worldwide": ("Remote", "Worldwide Remote", "Remote Europe", "Germany", "DACH"),
}

DISCOVERY_TITLES = (
    "AI Automation Specialist", "AI Automation Engineer", "Junior AI Automation", "Workflow Automation Specialist",
    "AI Workflow Engineer", "n8n Automation Specialist", "AI Agent Engineer", "LLM Automation Engineer",
)

ROLE_WORDS = (
    "engineer", "developer", "scientist", "specialist", "manager", "designer", "analyst", "architect", "consultant",
    "programmer", "researcher", "lead", "ops", "sre",
)


# ---- Fixed values: words and patterns of classifiers ----

ONSITE_TERMS = ("onsite", "on-site", "office", "büro")
ENTRY_LEVELS = {
    "working_student": ("working student", "werkstudent"),
    "internship": ("intern", "praktikum", "стаж"),
    "entry_level": ("graduate", "trainee", "associate"),
}
STARTUP_SIGNS = ("startup", "early-stage", "saas", "y combinator")
COMPANY_FITS = {
    "enterprise": ("enterprise", "corporation", "konzern", "10,000+", "10000+"),
    "startup": ("startup", "early-stage", "seed", "series a", "y combinator", "yc"),
    "sme/mid-market": ("gmbh", "agency", "agentur", "consulting", "beratung", "saas", "b2b"),
}
#: Ranges, counts and teams that name a size, with words without which they do not occur.
SIZE_PATTERNS = {
    r"(\d{1,3}(?:,\d{3})?)\s*[-–]\s*(\d{1,3}(?:,\d{3})?)\s+(employees|people|team members)": ("employees", "people", "team members"),
    r"(\d{1,3}(?:,\d{3})?)(\+?)\s+(employees|people|team members)": ("employees", "people", "team members"),
    r"(team of|team size|company of)\s+(\d{1,4})": ("team of", "team size", "company of"),
}
SIZE_WORDING = (
    (("enterprise", "corporation", "konzern", "large company"), "1,001+", "inferred from company wording"),
    (("startup", "early-stage", "early stage", "seed stage"), "1-50", "inferred from startup wording"),
    (("mittelstand", "sme", "small business", "mid-market"), "51-500", "inferred from SME wording"),
)

# ---- Fixed values: patterns of hiring threads ----

#: What a head's first piece is cleaned of: brackets, addresses, backers.
THREAD_COMPANY_NOISE = (r"\(.*?\)", r"(?U)https?://\S+", r"(?iU)\b(backed|back)\s+by\b.*$")
THREAD_PAY = r"(?U)[$€£]|\d{2,}\s*[k,]"
THREAD_MODES = {
    "hybrid": r"(?U)\bhybrid\b",
    "remote": r"(?U)\bremote\b",
    "onsite": r"(?U)\b(onsite|on-site|in office|in-office)\b",
}
THREAD_ROLE = (
    r"(?iU)\b(?:senior|junior|lead|staff|principal|founding|applied|forward[- ]deployed)?\s*"
    r"(?:ai|ml|machine learning|software|full[- ]?stack|back[- ]?end|front[- ]?end|platform|data|automation|infrastructure)?\s*"
    r"(?:engineer|developer|scientist|specialist)s?\b"
)
THREAD_NO_PLACE = r"(?U)\b(remote|onsite|on-site|hybrid|full[- ]time|part[- ]time|contract|intern)\b"
THREAD_PLACES = r"(?U)\b(usa|uk|eu|europe|germany|berlin|munich|london|nyc|new york|san francisco|sf|amsterdam|paris|canada|austin|boston)\b"

# ---- Fixed values: searches for company boards ----

BOARD_SITES = {"greenhouse": "boards.greenhouse.io", "lever": "jobs.lever.co", "ashby": "jobs.ashbyhq.com", "workable": "apply.workable.com"}
DISCOVERY_KEYWORDS = ("AI engineer", "AI automation", "machine learning engineer")
MOST_DISCOVERY_SEARCHES = 5

#: Companies whose size postings rarely give.
COMPANY_SIZES = {
    "Siemens Energy": "90000", "Siemens": "300000", "Bosch": "400000", "SAP": "100000", "Deutsche Telekom": "200000",
    "Telekom": "200000", "Vodafone": "90000", "Allianz": "150000", "Bayer": "100000", "BASF": "110000",
    "Volkswagen": "680000", "BMW": "150000", "Mercedes-Benz": "170000", "Daimler": "170000", "Continental": "200000",
    "Deutsche Bank": "90000", "Capgemini": "350000", "Amazon": "1500000", "Amazon Web Services": "1500000",
    "AWS": "1500000", "Google": "180000", "Alphabet": "180000", "Microsoft": "220000", "Apple": "160000",
    "Meta": "67000", "Facebook": "67000", "IBM": "280000", "Oracle": "150000", "Intel": "120000", "Cisco": "80000",
    "Dell": "100000", "HP": "55000", "HPE": "60000", "Hewlett Packard": "55000", "Hewlett-Packard": "55000",
    "Hewlett Packard Enterprise": "60000", "Nvidia": "30000", "Adobe": "30000", "Salesforce": "75000",
    "SAP SE": "100000", "Atlassian": "12000", "Uber": "32000", "Airbnb": "7000", "Spotify": "9000",
    "ByteDance": "150000", "TikTok": "150000", "Whatnot": "700", "Newell Brands": "25000", "Newellbrands": "25000",
    "Yogurtland": "2000", "Shopify": "8000", "Stripe": "8000", "Datadog": "5000", "Snowflake": "7000",
    "Twilio": "5000", "Cloudflare": "4000", "Palantir": "3500", "Reddit": "2000", "Lyft": "22000", "Boomi": "2000",
    "Kong": "700", "Deloitte": "450000", "Accenture": "740000", "Infosys": "340000",
    "Tata Consultancy Services": "600000", "TCS": "600000", "Wipro": "250000", "Cognizant": "350000", "HCL": "220000",
    "Orange": "130000", "Orange Business": "130000",
}

# ---- Fixed values: thresholds ----

#: Least, greatest, label.
EMPLOYEE_BUCKETS = (
    (1, 10, "1-10"), (11, 50, "11-50"), (51, 200, "51-200"), (201, 500, "201-500"),
    (501, 1000, "501-1,000"), (1001, 5000, "1,001-5,000"), (5001, 10000, "5,001-10,000"),
)
OPEN_BUCKET = "10,001+"
YEARLY_LEAST = 50_000
MONTHLY_LEAST = 4_200
HOURS_MOST = 36
MOST_EMPLOYEES = 200
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "ref", "source")
TITLE_SUFFIXES = ("gmbh", "ltd", "inc", "llc", "ag", "se")
COMPANY_SUFFIXES = ("gmbh", "ag", "se", "inc", "llc", "ltd", "bv", "oy", "ab", "co")
TITLE_NOISE = (
    "junior", "senior", "lead", "principal", "staff", "remote", "hybrid", "onsite", "m f d", "m w d", "w m d", "f m d",
    "d f m", "all genders", "m w x", "w m x",
)
TARGET_HINTS = (
    "ai automation", "automation specialist", "ai agent", "workflow automation", "n8n", "ai engineer", "llm",
)
DACH_HINTS = (
    "german", "deutschland", "berlin", "munich", "münchen", "hamburg", "vienna", "wien", "zurich", "zürich", "dach",
    "austria", "switzerland",
)


@dataclass(frozen=True)
class TargetingProfile:
    """What a run looks for; every list can be replaced."""

    target_titles: tuple[str, ...] = TARGET_TITLES
    off_target_title_signals: tuple[str, ...] = OFF_TARGET_TITLE_TERMS
    search_priority_titles: tuple[str, ...] = PRIORITY_TITLES
    search_concept_queries: tuple[str, ...] = CONCEPT_QUERIES
    search_sites: tuple[str, ...] = SEARCH_SITES
    region_terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REGION_TERMS))

    @classmethod
    def load(cls, path: str | Path) -> TargetingProfile:
        """Lists of a YAML file; what it lacks, leaves empty or has in another shape keeps its default."""
        import yaml

        try:
            data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError):
            data = None
        data, found = data if isinstance(data, dict) else {}, {}
        for name in ("target_titles", "off_target_title_signals", "search_priority_titles", "search_concept_queries", "search_sites"):
            value = data.get(name)
            kept = [str(x).strip() for x in value if str(x).strip()] if isinstance(value, list) else []
            if isinstance(value, list) and value:
                found[name] = tuple(x.lower() for x in kept) if name.endswith(("titles", "signals")) and "search" not in name else tuple(kept)
        regions = data.get("region_terms")
        if isinstance(regions, dict):
            lists = {str(k).strip().lower(): tuple(str(t).strip() for t in v if str(t).strip()) for k, v in regions.items() if isinstance(v, list)}
            if lists := {k: v for k, v in lists.items() if v}:
                found["region_terms"] = lists
        return cls(**found)
