"""Fixed values that must equal the reference's for equal results.

Everything here is data, stated plainly: regular expressions of the
row-level quality checks, the issue/impact configuration, the task to
stage/phase lookup, and the default validity bounds.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: detection patterns (Java regex and RE2 agree on these)
# ---------------------------------------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL_PATTERN = r"\b(?:https?://|www\.)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?\b"
PHONE_PATTERN = r"\b(?:\d{3}[-.]?|\(\d{3}\) )?\d{3}[-.]?\d{4}\b"

# ---------------------------------------------------------------------------
# FIXED VALUES: issue -> characteristic -> impact (15 rows, in file order)
# ---------------------------------------------------------------------------
IMPACT_CONFIG = [
    ("dqa_is_duplicate", "Duplicate Values", "Critical"),
    ("dqa_is_duplicate_review_id", "Duplicate IDs", "Critical"),
    ("dqa_has_non_english_review", "Non-English Review", "Critical"),
    ("dqa_has_non_english_app_name", "Non-English App Name", "Critical"),
    ("dqa_has_invalid_rating", "Invalid Ratings", "Critical"),
    ("dqa_has_null_values", "Null Values", "High"),
    ("dqa_has_excessive_special_chars", "Excessive Special Characters", "High"),
    ("dqa_has_invalid_date", "Invalid Dates", "High"),
    ("dqa_has_profanity", "Profanity", "High"),
    ("dqa_contains_email", "Contains Email Address(es)", "High"),
    ("dqa_contains_phone_number", "Contains Phone Number(s)", "High"),
    ("dqa_vote_sum_outlier", "Contains Vote Sum Outliers", "Medium"),
    ("dqa_vote_count_outlier", "Contains Vote Count Outliers", "Medium"),
    ("dqa_has_emojis", "Emojis", "Low"),
    ("dqa_contains_url", "Contains URL(s)", "Low"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: task -> (phase, stage) lookup (32 rows, in file order)
# ---------------------------------------------------------------------------
TASK_CONFIG = [
    ("data_prep", "clean", "DataCleaningTask"),
    ("data_analysis", "data_quality_analysis", "DataQualityAnalysis"),
    ("data_prep", "data_quality_assessment", "DetectDuplicateRowTask"),
    ("data_prep", "data_quality_assessment", "DetectNullValuesTask"),
    ("data_prep", "data_quality_assessment", "DetectNonEnglishTask"),
    ("data_prep", "data_quality_assessment", "DetectEmojiTask"),
    ("data_prep", "data_quality_assessment", "DetectEmailTask"),
    ("data_prep", "data_quality_assessment", "DetectInvalidRatingsTask"),
    ("data_prep", "data_quality_assessment", "DetectOutliersTask"),
    ("data_prep", "data_quality_assessment", "DetectProfanityTask"),
    ("data_prep", "data_quality_assessment", "DetectInvalidDatesTask"),
    ("data_prep", "data_quality_assessment", "DetectSpecialCharacterTask"),
    ("data_prep", "data_quality_assessment", "DetectPhoneNumberTask"),
    ("data_prep", "data_quality_assessment", "DetectURLTask"),
    ("data_prep", "features", "AnonymizeAuthorsTask"),
    ("data_prep", "features", "ParseDatesTask"),
    ("data_prep", "features", "DropFeaturesTask"),
    ("data_prep", "features", "CastDatatypesTask"),
    ("data_prep", "features", "BasicTextFeaturesTask"),
    ("data_prep", "features", "LexicalFeaturesTask"),
    ("data_prep", "features", "ReadabilityMetricsTask"),
    ("data_prep", "io", "ReadTask"),
    ("data_prep", "io", "WriteTask"),
    ("data_prep", "io", "ConvertTask"),
    ("data_prep", "metrics", "CategoryMetricsTask"),
    ("data_prep", "metrics", "AuthorMetricsTask"),
    ("data_prep", "metrics", "AppMetricsTask"),
    ("data_prep", "metrics", "CategoryAuthorMetricsTask"),
    ("data_prep", "normalize", "NormalizeDataTask"),
    ("data_prep", "text_prep", "TextPreprocessorTask"),
    ("data_prep", "data_quality_analysis", "DQAInitTask"),
    ("data_prep", "data_quality_analysis", "DQAFinalizeTask"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: default bounds and thresholds
# ---------------------------------------------------------------------------
DATE_LOWER = "2007-01-01 00:00:00"   # earlier is invalid
DATE_UPPER = "2024-01-01 00:00:00"   # later is invalid
RATING_LOWER = 0                     # smaller is invalid
RATING_UPPER = 5                     # larger is invalid
SPECIAL_CHAR_THRESHOLD = 0.3         # pipeline setting (class default 0.2)
CLEAN_IMPACTS = ("Critical", "High")
EXCLUDED_CATEGORY = "Shopping"
LABEL_CODES = [("NEG", 0), ("NEU", 1), ("POS", 2)]
