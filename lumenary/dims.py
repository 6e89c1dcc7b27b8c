"""Dictionaries that the operators read: knowledge base, labels, salaries and sources.

Each is bounded by what people write, not by the data; the DataFrames made of them are small
enough to broadcast whatever the size of the fact tables. ``values()`` renders the same rows
for an SQL oracle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- knowledge base (fixed values)

#: Canonical skills with the skills that each is related to.
SKILLS: dict[str, tuple[str, ...]] = {
    "JavaScript": ("TypeScript", "React"),
    "TypeScript": ("JavaScript",),
    "React": ("JavaScript", "TypeScript"),
    "Node.js": ("NestJS", "JavaScript"),
    "NestJS": ("Node.js", "TypeScript"),
    "Python": ("Django",),
    "Django": ("Python",),
    "SQL": ("PostgreSQL",),
    "PostgreSQL": ("SQL",),
    "Docker": ("Kubernetes",),
    "Kubernetes": ("Docker", "AWS"),
    "AWS": (),
    "Java": ("Spring",),
    "Spring": ("Java",),
    "Excel": ("Accounting",),
    "Accounting": ("Bookkeeping",),
    "Bookkeeping": ("Accounting", "Excel"),
    "Nursing": ("Patient Care",),
    "Patient Care": ("Nursing",),
    "Project Management": (),
    "Communication": (),
    "Figma": ("Photoshop",),
    "Photoshop": ("Figma",),
    "Sales": (),
}

#: Other spellings, lower case.
ALIASES: dict[str, str] = {
    "js": "JavaScript",
    "ts": "TypeScript",
    "reactjs": "React",
    "node": "Node.js",
    "nodejs": "Node.js",
    "py": "Python",
    "postgres": "PostgreSQL",
    "k8s": "Kubernetes",
    "ms excel": "Excel",
    "pm": "Project Management",
}

#: Directed relationships with weights, and direct transferabilities.
EDGES: tuple[tuple[str, str, float], ...] = (
    ("JavaScript", "TypeScript", 0.85),
    ("JavaScript", "React", 0.8),
    ("TypeScript", "NestJS", 0.7),
    ("Node.js", "NestJS", 0.9),
    ("PostgreSQL", "SQL", 0.9),
    ("Python", "Django", 0.75),
    ("Docker", "Kubernetes", 0.7),
    ("Java", "Spring", 0.75),
    ("Accounting", "Excel", 0.5),
    ("Bookkeeping", "Accounting", 0.8),
)
TRANSFERS: tuple[tuple[str, str, float], ...] = (
    ("SQL", "PostgreSQL", 0.85),
    ("Nursing", "Patient Care", 0.9),
    ("Photoshop", "Figma", 0.65),
    ("Java", "Python", 0.45),
)

#: Skills that must be known before another.
PREREQUISITES: dict[str, tuple[str, ...]] = {"NestJS": ("Node.js", "TypeScript"), "Django": ("Python",), "Kubernetes": ("Docker",)}

#: Phrases that name a role beside its own.
ROLE_SYNONYMS: dict[str, tuple[str, ...]] = {
    "backend developer": ("backend developer", "backend engineer", "software engineer"),
    "frontend developer": ("frontend developer", "frontend engineer", "react developer"),
    "full stack developer": ("full stack developer", "fullstack developer", "software engineer"),
    "data analyst": ("data analyst", "bi analyst", "data scientist"),
    "accountant": ("accountant", "bookkeeper", "finance officer"),
    "nurse": ("nurse", "registered nurse"),
    "project officer": ("project officer", "project coordinator", "program officer"),
    "mobile developer": ("mobile developer", "android developer", "ios developer"),
    "devops engineer": ("devops engineer", "site reliability engineer"),
    "graphic designer": ("graphic designer", "visual designer"),
}

#: Core skills of role profiles, in order of precedence.
ROLE_CORES: dict[str, tuple[str, ...]] = {
    "backend developer": ("Node.js", "SQL", "PostgreSQL", "Docker"),
    "frontend developer": ("JavaScript", "React", "TypeScript"),
    "full stack developer": ("JavaScript", "React", "Node.js", "SQL"),
    "data analyst": ("SQL", "Python", "Excel"),
    "devops engineer": ("Docker", "Kubernetes", "AWS"),
    "graphic designer": ("Figma", "Photoshop"),
    "nurse": ("Nursing", "Patient Care"),
}

#: Roles whose title speaks against a candidate with much weak and little core evidence, in order.
NEGATIVE: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "accountant": (("JavaScript", "React", "Docker", "SQL", "Python"), ("Accounting", "Excel")),
    "nurse": (("JavaScript", "SQL", "Excel", "Sales", "Figma"), ("Nursing", "Patient Care")),
    "data analyst": (("Figma", "Photoshop", "Sales", "Nursing"), ("SQL", "Python")),
}

#: Years that a level asks for; other levels ask for DEFAULT_YEARS.
LEVEL_YEARS: dict[str, int] = {"INTERN": 0, "ENTRY": 1, "MID": 3, "SENIOR": 5, "LEAD": 7}
DEFAULT_YEARS = 2

#: Weights of a target role by priority, and of a location by tier.
PRIORITY_WEIGHT: dict[str, float] = {"HIGH": 1.0, "MEDIUM": 0.72, "LOW": 0.45}
TIER_WEIGHT: dict[str, float] = {"HIGH": 1.0, "MEDIUM": 0.62, "LOW": 0.38}
NO_TIER = 0.12

#: Cities that count as the home country, as they are stored.
HOME = "Ethiopia"
HOME_CITIES = ("addis ababa", "bahir dar", "hawassa", "dire dawa", "jimma", "mekelle", "adama", "dessie", "gondar", "harar")

# ---------------------------------------------------------------- posting labels (fixed values)

HOME_WORDS = ("addis ababa", "addis", "mekelle", "adama", "nazret", "bahir dar", "hawassa", "dire dawa", "jimma", "gondar", "dessie", "debre markos", "harar", "arba minch", "ethiopian", "ethiopia")
REMOTE_WORDS = ("remote", "work from home", "wfh", "anywhere", "global", "distributed", "telecommute", "home-based")
NGO_WORDS = ("ngo", "non-profit", "nonprofit", "humanitarian", "un ", "unicef", "who", "undp", "world bank", "red cross", "msf", "care ", "save the children", "plan international", "relief", "charity", "foundation", "civil society")
TECH_WORDS = ("developer", "engineer", "architect", "devops", "sre", "data scien", "machine learning", "ai ", "ml ", "frontend", "backend", "full stack", "fullstack", "full-stack", "software", "programmer", "typescript", "javascript", "python", "react", "node", "angular", "vue", "cloud", "infrastructure", "cybersecurity", "qa", "ios", "android")
SENIOR_WORDS = ("senior", "sr.", "sr ", "lead", "principal", "staff", "director", "vp ", "chief", "head of", "architect")
ENTRY_WORDS = ("junior", "jr.", "jr ", "intern", "trainee", "apprentice", "graduate", "entry level", "entry-level", "associate")
FREELANCE_WORDS = ("freelance", "contract", "gig", "consultant")

#: Tags that a tag count always lists.
KNOWN_TAGS = ("ethiopian", "remote", "international", "ngo", "tech", "senior", "entry_level", "freelance")

#: Categories: (id, aliases, keywords), in order of precedence.
TAXONOMY: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("software-engineering", ("software", "it"), ("developer", "engineer", "programmer", "software")),
    ("software-engineering.backend", ("backend", "api"), ("node", "java", "python", "django")),
    ("software-engineering.frontend", ("frontend", "web"), ("react", "javascript", "typescript")),
    ("data", ("data", "analytics"), ("data", "sql", "analyst")),
    ("finance", ("finance", "accounting"), ("account", "bookkeep", "excel")),
    ("health", ("health", "medical"), ("nurse", "patient", "clinic")),
    ("design", ("design",), ("designer", "figma", "photoshop")),
    ("sales-marketing", ("sales", "marketing"), ("sales", "marketing")),
    ("program-management", ("project",), ("project", "program")),
    ("education", ("education", "teaching"), ("teacher", "tutor")),
)
#: Category labels of some sources: (source, id, label, categories).
CATALOGUE: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("src0", "ict", "ICT", ("software-engineering", "data")),
    ("src0", "fin", "Banking", ("finance",)),
    ("src1", "hlth", "Health care", ("health",)),
    ("src1", "edu", "Schools", ("education",)),
    ("src2", "ict", "Computers", ("software-engineering",)),
)

# ---------------------------------------------------------------- salaries (fixed values)

LEVEL_OF: dict[str, str] = {"INTERN": "ENTRY", "ENTRY": "ENTRY", "JUNIOR": "ENTRY", "MID": "MID", "SENIOR": "SENIOR", "LEAD": "LEAD", "PRINCIPAL": "LEAD", "STAFF": "LEAD"}
#: Title phrases with the benchmark role; the first that a title contains counts.
SALARY_ROLES: tuple[tuple[str, str], ...] = (
    ("backend developer", "Backend Developer"),
    ("frontend engineer", "Frontend Developer"),
    ("frontend developer", "Frontend Developer"),
    ("developer", "Software Engineer"),
    ("mobile developer", "Mobile Developer"),
    ("devops", "DevOps Engineer"),
    ("data analyst", "Data Analyst"),
    ("accountant", "Accountant"),
    ("nurse", "Nurse"),
    ("project", "Project Officer"),
)
#: (role, level, local min, median, max, foreign min, median, max)
SALARIES: tuple[tuple[str, str, int, int, int, int, int, int], ...] = (
    ("Backend Developer", "ENTRY", 18000, 28000, 45000, 500, 800, 1300),
    ("Backend Developer", "SENIOR", 60000, 95000, 150000, 1600, 2600, 4200),
    ("Frontend Developer", "ENTRY", 15000, 25000, 40000, 400, 700, 1200),
    ("Frontend Developer", "MID", 30000, 50000, 80000, 800, 1500, 2500),
    ("Software Engineer", "MID", 32000, 52000, 85000, 850, 1550, 2600),
    ("DevOps Engineer", "SENIOR", 65000, 100000, 160000, 1700, 2800, 4500),
    ("Data Analyst", "MID", 20000, 35000, 55000, 600, 1000, 1700),
    ("Accountant", "ENTRY", 8000, 12000, 18000, 250, 400, 600),
    ("Nurse", "MID", 9000, 14000, 20000, 300, 450, 700),
)
CURRENCIES = ("ETB", "USD", "EUR", "GBP")
LOCAL_CURRENCY = "ETB"

# ---------------------------------------------------------------- sources (fixed values)

#: Rank of a source tier in the collection queue; others come last.
TIER_RANK: dict[str, int] = {"ETHIOPIA": 1, "INTERNATIONAL": 3}
LAST_RANK = 5
#: Stages that an application may go to from another.
TRANSITIONS: tuple[tuple[str, str], ...] = (
    ("SAVED", "APPLIED"), ("SAVED", "WITHDRAWN"), ("APPLIED", "INTERVIEW"), ("APPLIED", "REJECTED"), ("APPLIED", "WITHDRAWN"),
    ("INTERVIEW", "OFFER"), ("INTERVIEW", "REJECTED"), ("INTERVIEW", "WITHDRAWN"), ("OFFER", "ACCEPTED"), ("OFFER", "REJECTED"), ("REJECTED", "SAVED"),
)


def transfer_pairs() -> list[tuple[str, str, float, bool]]:
    """(from, to, transferability, related) of all different skills that have something to do with one another.

    A direct transferability counts before its reverse, then a relationship's weight times 0.8 in
    either direction, then 0.4 for skills listed as related.
    """
    direct = {(a, b): t for a, b, t in TRANSFERS}
    edge = {(a, b): w for a, b, w in EDGES}
    listed = {(a, b) for a, names in SKILLS.items() for b in names}
    known = set(direct) | set(edge) | listed
    out = []
    for a, b in sorted(known | {(b, a) for a, b in known}):
        back = (b, a)
        steps = [direct.get((a, b)), direct.get(back), edge.get((a, b), 0) * 0.8, edge.get(back, 0) * 0.8, 0.4 if {(a, b), back} & listed else 0]
        out.append((a, b, next((float(s) for s in steps if s), 0.0), bool({(a, b), back} & (set(edge) | listed))))
    return out


def role_phrases() -> list[tuple[str, str]]:
    """(role, phrase) of the roles with synonyms."""
    return [(role, p) for role, phrases in ROLE_SYNONYMS.items() for p in phrases]


def frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A dictionary as a DataFrame: literal rows in the plan, whose size the optimizer knows; no job and no Python worker."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {cast} FROM {values(rows, ', '.join(n for n, _ in fields))}")


def values(rows: Iterable[Sequence], columns: str) -> str:
    """A dictionary as an SQL table: ``(VALUES ...) AS v(columns)``."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        if isinstance(x, int):
            return str(x)
        return "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(cell(x) for x in r) + ')' for r in rows)}) AS v({columns})"
