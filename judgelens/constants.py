"""Fixed values. They decide the results and must stay exactly as written."""

# Ordered relevance classes: exact, substitute, complement, irrelevant.
LABELS = ("E", "S", "C", "I")
OFFICIAL_SPLITS = ("train", "test")
DATASET_SPLITS = ("train", "validation", "test")

SEED = 20260926
HASH_BUCKETS = 10000
VALIDATION_BUCKETS = 2000
SAMPLE_MODULUS = 1000

# Text patterns.
WHITESPACE_RUN = r"\s+"
NON_WORD_RUN = r"[^\p{L}\p{N}]+"
DIGIT_RUN = r"[0-9]+"

PRODUCT_KEYS = ("product_locale", "product_id")
# What tells judged pairs apart where ids are sound, and where two pairs may share one.
EXAMPLE_KEY = ("example_id",)
PAIR_KEY = ("example_id", "query_id", "product_id")

FEATURES = (
    "query_token_count",
    "title_token_count",
    "token_intersection_count",
    "query_coverage",
    "title_coverage",
    "token_jaccard",
    "exact_title_match",
    "query_in_title",
    "brand_token_overlap",
    "brand_match",
    "color_token_overlap",
    "color_match",
    "query_has_number",
    "numeric_mismatch",
    "title_missing",
    "brand_missing",
    "color_missing",
)

FEATURE_TABLE_COLUMNS = (
    "example_id",
    "query_id",
    "query_norm",
    "query",
    "product_id",
    "product_title",
    "product_brand",
    "label",
    "dataset_split",
    "product_seen_train",
) + FEATURES

SCORED_COLUMNS = (
    "example_id",
    "query_id",
    "label",
    "prediction",
    "p_e",
    "query_token_count",
    "query_has_number",
    "numeric_mismatch",
    "brand_missing",
    "title_missing",
    "product_seen_train",
)

# Review study settings.
REVIEW_BUDGETS = (0.05, 0.10)
RANDOM_REPEATS = 100
BOOTSTRAP_REPLICATES = 300
BOOTSTRAP_BUDGET = 0.10
CONFIDENCE = 0.95

# Classifier settings.
REG_PARAM = 0.05
MAX_ITER = 100
TOLERANCE = 1e-6
CANDIDATES = (("logistic_unweighted", False), ("logistic_class_weighted", True))

# Error-case sample settings.
CASES_PER_CELL = 4
EVIDENCE_COLUMNS = (
    "query_token_count",
    "title_token_count",
    "query_coverage",
    "token_jaccard",
    "query_in_title",
    "exact_title_match",
    "brand_match",
    "numeric_mismatch",
    "title_missing",
)
REVIEW_FORM_FIELDS = (
    "reviewer",
    "reviewed_at",
    "reviewer_judgement",
    "disagreement_reason",
    "review_notes",
)
