"""Fixed values. They decide results, so they are listed here and nowhere else."""

from __future__ import annotations

# Characters that count as whitespace for strip / blank checks: the Unicode
# White_Space set plus the four ASCII separators FS, GS, RS, US.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Shuffle seed and truncation width of the standard preparation.
SHUFFLE_SEED = 42
DESCRIPTION_CHARS = 1500

POSTING_COLUMNS = ["job_posting_id", "title", "description", "location"]

# Title rules (fixed word lists). "substrings" match anywhere, "words" only
# between word boundaries; every match ignores case.
ENTRY_LEVEL_SUBSTRINGS = [
    "entry", "new grad", "junior", "early career", "trainee", "recent grad",
]
ENTRY_LEVEL_WORDS = ["I", "1"]
ENTRY_LEVEL_EXCLUDED_SUBSTRINGS = [
    "senior", "principal", "lead", "staff", "director", "manager", "head of",
    "chief", "vp", "vice president", "executive", "intern",
]
DATA_BUSINESS_WORDS = [
    "data analyst", "business analyst", "business intelligence",
    "business analytics", "reporting", "operations analyst", "analytics",
    "data science",
]
FINANCE_WORDS = [
    "financial analyst", "fp&a analyst", "treasury analyst",
    "finance analytics", "budget analyst", "investment analyst",
]
MARKETING_WORDS = [
    "marketing analyst", "marketing", "product analyst",
    "marketing analytics", "growth analyst", "campaign analyst",
    "customer insights analyst",
]

# Categories of the model labeller with their descriptions (fixed values).
MODEL_CATEGORIES = {
    "internship": "Internship roles.",
    "entry_level": (
        "Roles explicitly targeting new graduates or candidates with 0-1 years of experience. "
        "Excludes any role that requires 2+ years of experience or involves supervising/mentoring "
        "junior staff."
    ),
    "data_analytics": (
        "Hands-on data, analytics, BI, dashboarding, experimentation, or data science analysis roles."
    ),
    "software_engineering": (
        "Software engineer, developer, or similar engineering roles, including data/ML/platform "
        "engineering that primarily builds systems and tooling."
    ),
    "finance_accounting": (
        "Finance, accounting, treasury, FP&A, or investment analysis roles focused on financial "
        "modeling, budgeting, forecasting, or accounting."
    ),
    "marketing": (
        "Marketing, growth, brand, campaign, performance marketing, or GTM execution roles."
    ),
    "strategy_product_consulting": (
        "Generalist consulting, corporate/business strategy, business operations, corporate "
        "development/M&A strategy, and product management/product strategy roles (typical MBA-target "
        "roles)."
    ),
}

# Feature texts: which columns are joined, in order.
COLUMN_COMBINATIONS = {
    "combination1": ["title"],
    "combination2": ["title", "description"],
    "combination3": ["title", "description", "location"],
    "combination4": ["location"],
    "combination5": ["title", "summary"],
}

# Vector width -> (slot of the stored query vector, model id).
DIM_MODEL_SLOTS = {
    1024: ("embedding1", "qwen/Qwen3-Embedding-0.6B"),
    4096: ("embedding2", "Qwen/Qwen3-Embedding-8B"),
}

# Depths used when none are given.
DEFAULT_KS = [5, 10, 20, 30, 50]
COMPARISON_KS = [10, 50, 100]
