"""Thresholds, hint words, patterns and type names that results depend on."""

# Dataset types, in registry order.
DATASET_TYPES = (
    "survey", "usage", "circulation", "e_resource", "spaces",
    "instruction", "reference", "events", "collection", "benchmark",
)
TEXT_TYPES = ("survey", "reference")
METRIC_TYPES = tuple(t for t in DATASET_TYPES if t not in TEXT_TYPES)

# Label used as metric name when a metric file names none.
DOMAIN_LABELS = {
    "survey": "Survey and feedback",
    "usage": "General usage statistics",
    "circulation": "Circulation and borrowing",
    "e_resource": "E-resource and COUNTER usage",
    "spaces": "Spaces, rooms, and gate counts",
    "instruction": "Instruction and learning assessment",
    "reference": "Reference, chat, and service interactions",
    "events": "Events and programs",
    "collection": "Collection assessment",
    "benchmark": "Peer, ACRL, ARL, or benchmark data",
}

# Dataset-type hints, first type with a hit wins.
TYPE_HINTS = (
    ("benchmark", ("acrl", "arl", "peer", "benchmark", "ipeds", "institution")),
    ("e_resource", ("counter", "database", "platform", "title", "requests", "searches", "turnaway")),
    ("spaces", ("gate", "door", "room", "booking", "reservation", "seat", "occupancy", "libcal")),
    ("instruction", ("instruction", "class", "course", "section", "learning", "attendance")),
    ("reference", ("reference", "chat", "ticket", "question_text", "transaction", "libanswers")),
    ("events", ("event", "program", "workshop", "attendee", "registration")),
    ("collection", ("holdings", "collection", "call_number", "subject", "cost", "vendor")),
    ("circulation", ("checkout", "borrow", "renewal", "hold", "loan", "material")),
    ("survey", ("survey", "qualtrics", "feedback", "satisfaction", "comment", "response_text")),
    ("usage", ("usage", "visits", "sessions", "metric", "count", "value")),
)

# Source-system hints on file name and column names, first hit wins.
SOURCE_HINTS = (
    ("Qualtrics Survey", ("qualtrics",)),
    ("LibCal", ("libcal",)),
    ("LibAnswers", ("libanswers",)),
    ("COUNTER Report", ("counter",)),
    ("Integrated Library System", ("alma", "sierra", "ils")),
    ("External Benchmark Source", ("acrl", "arl", "ipeds")),
)
DEFAULT_SOURCE = "Data Import Hub"

# Columns a strict file of these types must have.
REQUIRED_COLUMNS = {
    "survey": ("response_date", "question", "response_text"),
    "usage": ("date", "metric_name", "metric_value"),
    "circulation": ("checkout_date", "material_type", "patron_type"),
}

# Column-role hints, first role with a hit wins.
ROLE_HINTS = (
    ("date/time", ("date", "time", "month", "year", "period")),
    ("metric label", ("metric", "measure", "indicator", "kpi")),
    ("numeric measure", ("value", "count", "total", "score", "rating", "amount", "cost")),
    ("qualitative text", ("comment", "response", "feedback", "question", "answer", "text")),
)
ROLE_CATEGORY_MAX = 25

# Profile hints by column kind.
TEXT_HINTS = ("response", "comment", "feedback", "answer", "question", "text", "description", "quote")
TEXT_EXCLUDED_HINTS = ("date", "time", "year", "month", "period", "timestamp")
DATE_HINTS = ("date", "time", "year", "month", "period")
NUMERIC_HINTS = ("value", "count", "total", "number", "score", "rating", "visits", "circulation")
CATEGORY_HINTS = ("type", "category", "group", "state", "branch", "language", "patron", "material")
LANGUAGE_HINTS = ("language", "lang")
LABEL_HINTS = ("sentiment", "label")

# Texts that stand for a missing value, and the coded ones among them.
MISSING_TEXTS = ("", "nan", "none", "null", "-666", "-777", "-888", "-999", "n/a", "na")
CODED_MISSING = ("-666", "-777", "-888", "-999")

# Personal-data patterns, applied in this order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "address": (
        r"\b\d+\s+[A-Za-z0-9\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd"
        r"|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way)\b"
    ),
}

# Question-intent rules, first intent with a hit wins.
INTENT_HINTS = (
    ("data_inventory", ("what data", "what datasets", "available data", "uploaded data")),
    ("qualitative", ("theme", "sentiment", "quote", "comment", "feedback", "mad", "complain")),
    ("quantitative", ("average", "total", "count", "rank", "highest", "lowest", "trend", "compare", "outlier")),
    ("reporting", ("report", "executive", "summary", "recommendation", "board")),
    ("data_quality", (
        "missing", "quality", "duplicate", "dirty", "clean", "null", "invalid", "limitation", "caveat",
    )),
)
DEFAULT_INTENT = "retrieval"
EVIDENCE_INTENTS = ("qualitative", "retrieval", "reporting")
PROFILE_INTENTS = ("data_inventory", "data_quality")
BROAD_TERMS = ("what data", "available", "summarize", "overview", "limitations")

# Metadata fields a registered dataset should carry.
METADATA_FIELDS = ("title", "description", "source", "usage_notes", "ethical_considerations")
CORE_METADATA_FIELDS = ("title", "description", "source")
INDEXED_STATUSES = ("completed", "indexed", "ready")

# Analysis thresholds.
ALPHA = 0.05
MIN_ROWS_CORRELATION = 10
MIN_ROWS_TREND = 10
MIN_ROWS_COMPARISON = 5
MIN_ROWS_DISTRIBUTION = 10
MIN_ROWS_ACF = 20
MAX_ACF_LAG = 30
SEASONAL_LAGS = (7, 14, 30)
FORECAST_STEPS = 7
FORECAST_CONFIDENCE = 0.95
MOVING_WINDOWS = (7, 30)
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
TOP_CORRELATIONS = 10
SHAPIRO_MAX_ROWS = 5000
SENTIMENT_POSITIVE = 0.1
SENTIMENT_NEGATIVE = -0.1
MIN_RESPONSES = 10
DEFAULT_THEMES = 5
THEME_FEATURES = 100
THEME_SEED = 42
THEME_RESTARTS = 10
TOP_K = 5
DISTANCE_LIMIT = 1.45
MRR_DEPTH = 20
CONTEXT_TURNS = 5
MAX_CONTEXT_TOKENS = 4000
LOW_CONFIDENCE = 0.35
PINNED_LIMIT = 20
RATE_LIMIT_ATTEMPTS = 5
RATE_LIMIT_SECONDS = 60
RATE_LIMIT_BACKOFF_MAX = 16

# Name hints of the roles of a metric table, in the order in which roles are given out.
METRIC_ROLE_HINTS = {
    "metric_value": ("value", "count", "total", "number", "visits", "sessions"),
    "metric_name": ("metric", "measure", "indicator", "title", "room", "event"),
    "date": ("date", "time", "period", "month", "year"),
    "category": ("category", "type", "group", "audience", "department"),
}

# Sentences of profiles, in the order in which they are given.
STRENGTH_TEXTS = (
    ("text_columns", "Ready for qualitative themes and sentiment questions."),
    ("numeric_columns", "Ready for numeric summaries and comparisons."),
    ("date_columns", "Ready for time-based trend questions."),
    ("languages", "Contains language metadata for subgroup comparisons."),
    ("sentiment_labels", "Contains sentiment or label fields for validation/comparison."),
)
WARNING_TEXTS = {
    "no_text": "No obvious text response column was detected.",
    "no_metric": "No obvious numeric metric column was detected.",
    "missing": "Empty or fully missing columns detected: {}.",
    "coded": "Coded missing values appear in: {}.",
    "small": "This dataset is small, so patterns may be anecdotal.",
}
WARNING_COLUMNS = 4
# Reasons of the capability matrix.
CAPABILITY_TEXTS = {
    "text_type": "Dataset type is '{}' — qualitative analysis requires survey/text data.",
    "text_none": "No text columns detected.",
    "text_few": "Only {} rows — need at least 10 for meaningful analysis.",
    "text_ready": "Ready: {} text responses across {} text column(s).",
    "correlation_ready": "Ready: {} numeric columns with sufficient data.",
    "correlation_few": "Need ≥2 numeric columns with ≥10 values. Found {} usable.",
    "correlation_type": "Correlation requires numeric usage/circulation data.",
    "trend_ready": "Ready: date column '{}' + {} numeric metric(s).",
    "trend_none": "No date column detected — trend analysis requires time series data.",
    "trend_type": "Trend requires numeric usage/circulation data.",
    "comparative_ready": "Ready: can compare across '{}' ({} groups).",
    "comparative_few": "Need a categorical grouping column (≤20 unique values). Found {}.",
    "comparative_type": "Comparative analysis requires usage/circulation data.",
    "distribution_ready": "Ready: {} numeric column(s) available.",
    "distribution_few": "Distribution analysis requires at least one numeric column.",
    "distribution_type": "Distribution analysis requires usage/circulation data.",
    "query_ready": "Ready: {} rows will be indexed for natural language queries.",
}
# Reasons of the kind of analysis recommended for a dataset.
CLASSIFICATION_TEXTS = {
    "qualitative": "Survey datasets contain text responses — best suited for sentiment and theme analysis.",
    "quantitative": "{} datasets contain numeric metrics — best suited for correlation, trend, and distribution analysis.",
    "neither": "Unknown dataset type.",
}
# Sentences of suggested descriptions.
DESCRIPTION_TEXTS = {
    "size": "{} dataset with {} records and {} fields.",
    "dates": "Includes date/time fields ({}).",
    "dated": "Includes date/time fields ({}) covering {}.",
    "measures": "Contains numeric measures such as {}.",
    "texts": "Contains qualitative text fields such as {}.",
}
# Sentences of patterns and of evidence labels.
PATTERN_TEXTS = {
    "strong": "Strong correlations detected between {} variable pairs",
    "trend": "{} trend detected",
    "seasonal": "Seasonal pattern detected in time series",
    "groups": "Statistically significant differences between groups",
    "outliers": "Outliers detected: {} ({}% of data)",
    "skewed": "Non-normal distribution detected",
}
EVIDENCE_TEXTS = {
    "profile": "Answered from dataset profiles, not vector retrieval.",
    "High": "Retrieved source rows closely matched the question.",
    "Medium": "Retrieved source rows were relevant but not tightly matched.",
    "Low": "Retrieved source rows were only loosely matched.",
    "broad": " Broad or metadata-style questions often score lower with vector retrieval.",
}

# Questions made from passages, by dataset type and the column that fills them (none: as it is); the first that fits counts.
QUESTION_TEMPLATES = (
    ("survey", "question", "What do respondents say about {}?"),
    ("survey", None, "What are the main themes in survey responses?"),
    ("circulation", "category", "What are the circulation patterns for {} patrons?"),
    ("circulation", "metric_name", "What are the trends for {}?"),
    (None, "metric_name", "What are the usage statistics for {}?"),
)

# Name hints of the columns of canonical rows, in the order in which a column's role is tried.
SURVEY_ROLES = (
    ("response_date", ("date", "time")),
    ("question", ("question", "prompt", "item")),
    ("response_text", ("response", "answer", "feedback", "comment", "text")),
)
USAGE_ROLES = (
    ("date", ("date", "time", "period")),
    ("metric_name", ("metric", "name", "measure", "indicator")),
    ("metric_value", ("value", "count", "total", "number", "visits", "sessions")),
    ("category", ("category", "type", "group")),
)
CIRCULATION_ROLES = (
    ("checkout_date", ("date", "time")),
    ("material_type", ("material", "type", "format", "item", "resource")),
    ("patron_type", ("patron", "user", "borrower", "member", "category")),
)
# Name hints for renaming text files, and for the metric and title of a wide period report.
TEXT_RENAMES = (
    ("response_text", ("response", "answer", "feedback", "comment", "text", "question"), ()),
    ("response_date", ("date", "time", "timestamp"), ()),
    ("question", ("question", "prompt", "topic", "category"), ("response_text",)),
)
PERIOD_METRIC_HINTS = ("metric", "measure", "type")
PERIOD_TITLE_HINTS = ("title", "database", "platform", "resource")
