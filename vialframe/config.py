"""Fixed values that define the results: thresholds, weights, word lists and patterns."""

from __future__ import annotations

# ---- white space: the inside of a class with all of Unicode's, as Spark's trim strips blanks and its \s knows ASCII only
SPACE = r" \x{9}-\x{D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def spaced(pattern: str) -> str:
    """A pattern whose \\s and \\S stand for all white space, inside classes and outside."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


# ---- pages and layout
DIGITAL_PAGE_MIN_CHARS = 20
TEXT_INPUT_MIN_CHARS = 400
HEADER_FONT_MIN, HEADER_FONT_MAX, HEADER_MAX_CHARS = 11.5, 14.0, 60

# ---- row parsing
MAX_LABEL_CHARS = 60
PARSE_CONFIDENCE, FALLBACK_CONFIDENCE = 0.9, 0.65
STACK_GAP_FACTOR = 1.6
QUALIFIERS = ("non-reactive", "reactive", "negative", "positive", "normal", "not detected", "detected", "trace", "equivocal", "borderline")
FLAG_WORDS = ("normal", "high", "low", "critical", "abnormal", "h", "l")
PROSE_PREFIXES = ("info", "inference", "disclaimer", "note")
METADATA_MARKERS = (
    "patient name", "patient:", "age/gender", "sex", "dob", "mrn", "lrn", "sample id", "icmr id", "refered by", "referred by",
    "location", "report date", "sample drawn date", "sample regd", "sample auth date",
)
NUMBER = r"\d+\.?\d*"
RANGE_PATTERN = spaced(r"\d+\.?\d*\s*-\s*\d+\.?\d*|[<>]\s*\d+\.?\d*|\(.+\)")
PURE_RANGE_PATTERN = spaced(r"^(?:\d+\.?\d*\s*-\s*\d+\.?\d*|[<>]\s*\d+\.?\d*)$")
UNIT_SHAPE_PATTERN = r"^[A-Za-z%/°μu³\*\d\.\-]{1,20}$"
KNOWN_UNIT_PATTERN = r"(?i)^(?:[A-Za-zµμ%]+/[A-Za-z0-9µμ%\^\*]+|%|fl|pg|sec|s|10[\*\^]\d+/\w+|x10[\*\^]?\d+/?\w*|mm/hr)$"
SPECIMEN_PATTERN = spaced(r"(?i)specimen\s*:?\s*([A-Za-z ]+)")
TOKEN_SPLIT_PATTERN = spaced(r"\s{2,}|\.{2,}")

# ---- units
UNIT_VARIANTS = {
    "gm/dl": "g/dL", "g/dl": "g/dL", "mill/mm3": "mill/cmm", "mill/mm³": "mill/cmm", "mill/cumm": "mill/cmm",
    "million/mm3": "mill/cmm", "million/mm³": "mill/cmm", "million/cumm": "mill/cmm",
}
UNIT_NUMERATORS = (
    "g", "mg", "ug", "ng", "pg", "fg", "kg", "mmol", "umol", "nmol", "pmol", "meq", "eq", "iu", "u", "mu", "miu", "mill", "million",
    "millions", "cells", "cell", "mm", "cm", "l", "dl", "ml", "ul", "fl", "sec", "s", "mosm", "ratio", "copies", "tests",
)
UNIT_DENOMINATORS = (
    "l", "dl", "ml", "ul", "cumm", "cmm", "mm3", "mm³", "cm3", "hr", "h", "min", "d", "day", "hpf", "lpf", "cell", "cells", "g", "mg",
    "kg", "mol", "mmol", "creat",
)
UNIT_WORDS = ("%", "g", "mg", "ug", "ng", "pg", "fl", "sec", "s", "iu", "u", "mmol", "meq")
POWER_OF_TEN_PATTERN = r"(?i)^x?10[\*\^]?\d+$|^10[²³⁰-⁹]$|^10\^\d+$"

# ---- validation
SUGGESTION_BAND, SUSPECT_FACTOR = (0.5, 2.0), 5.0
PENALTY_NOTE, PENALTY_DECIMAL, PENALTY_UNIT, PENALTY_FLAG, MIN_CONFIDENCE = 0.10, 0.25, 0.10, 0.10, 0.20
LOW_CONFIDENCE = 0.7
CONFUSABLE = (("0", "O"), ("1", "l"), ("1", "I"), ("5", "S"), ("8", "B"))

# ---- terminology and retrieval
STOPWORDS = ("in", "of", "by", "the", "a", "an", "and", "or", "test", "level", "specimen", "with", "to", "for")
SPECIMEN_SYNONYMS = {
    "serum": ["ser"], "plasma": ["plas"], "blood": ["bld"], "whole": ["bld"], "venous": ["bld"], "capillary": ["bld"],
    "arterial": ["bld"], "urine": ["urine", "ur"], "feces": ["stool"], "faeces": ["stool"], "cerebrospinal": ["csf"],
    "synovial": ["synv"], "amniotic": ["amnio"], "nasopharynx": ["nph"], "vaginal": ["vag"], "fluid": ["fld"],
}
NAME_WEIGHT, ALIAS_WEIGHT, LENGTH_NORM = 1.0, 0.7, 0.07
MAX_NAME_TOKENS, MAX_EXTRA_TOKENS = 8, 2
RANK_CEILING, RANK_WEIGHT = 2000, 0.35
PRESENCE_QUALITATIVE, PRESENCE_QUANTITATIVE, PRESENCE_UNKNOWN = 1.2, 0.75, 0.9
SPECIMEN_MATCH, SPECIMEN_MISMATCH, UNIT_MATCH = 1.6, 0.55, 1.25
POOL, TOP_K, HINTS = 300, 6, 3
ACCEPT_SCORE, ACCEPT_MARGIN = 1.3, 0.2
CONFIRM_CONFIDENCE, REMEMBER_CONFIDENCE = 0.75, 0.90
STAGE_CONFIDENCE = {"alias_exact": 0.98, "learned": 0.95, "retrieval_auto": 0.85}
SHORT_NAME_MAX_RAW, SHORT_NAME_MAX = 10, 8

# ---- OCR
OCR_WORD_CONFIDENCE, OCR_GAP_RATIO = 15, 0.8
OCR_HEALTHY_CONFIDENCE, OCR_COMPLETE_FRACTION = 0.80, 0.80
OCR_ATTEMPTS = ((2.0, 6), (1.0, 6), (1.5, 6), (2.0, 4))

# ---- lifecycle
FEED_CAP = 200
STUCK_SECONDS, STUCK_STARTUP_SECONDS, CANCEL_STALE_SECONDS = 180, 45, 60
BUDGET_MIN_SECONDS, BUDGET_PAGE_SECONDS = 60, 15
VERIFY_BATCH = 25
MAX_UPLOAD_MB = 15
LIST_LIMIT, LIST_LIMIT_MAX, SEARCH_LIMIT, SEARCH_LIMIT_MAX = 200, 1000, 25, 100
LEARNED_KEY_CHARS, FILENAME_CHARS = 512, 512
#: Column widths of an observation; longer texts are clipped.
OBSERVATION_WIDTHS = {
    "original_test_name": 512, "normalized_test_name": 512, "value": 512, "unit": 128, "specimen": 256, "method": 512, "timing": 256,
    "flag": 64, "loinc_display": 512, "suggested_value": 256,
}
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".txt": "text/plain",
}
#: (pattern, replacement) in order.
SECRET_PATTERNS = (
    (r"AIza[0-9A-Za-z_\-]{20,}", "[REDACTED]"),
    (r"sk-[A-Za-z0-9_\-]{16,}", "[REDACTED]"),
    (spaced(r"(?i)(bearer\s+)[A-Za-z0-9._\-]{16,}"), "$1[REDACTED]"),
    (spaced(r"(?i)(x-api-key['\"]?\s*[:=]\s*['\"]?)[^\s'\",}]+"), "$1[REDACTED]"),
    (spaced(r"(?i)((?:api[_-]?key|key)=)[^&\s'\"]{8,}"), "$1[REDACTED]"),
)
#: Names that stand for one code whatever lists them (code, names).
ALIAS_OVERRIDES: dict[str, tuple[str, ...]] = {
    "718-7": ("Hgb", "HGB", "Hemoglobin", "Haemoglobin", "Hb"),
    "6690-2": ("WBC", "White Blood Cell Count", "White Blood Cells", "Leukocyte Count"),
    "789-8": ("RBC", "Red Blood Cell Count", "Red Cell Count"),
    "4544-3": ("Hct", "HCT", "Hematocrit", "Haematocrit", "PCV"),
    "777-3": ("Platelet Count", "PLT", "Platelets"),
    "4548-4": ("A1C", "HbA1c", "Glycated Hemoglobin", "Glycosylated Hemoglobin"),
    "1920-8": ("SGOT", "AST"),
    "1742-6": ("SGPT", "ALT"),
    "2951-2": ("Na+", "Na", "Sodium"),
    "2823-3": ("K+", "Potassium"),
    "2075-0": ("Cl-", "Chloride"),
    "3094-0": ("BUN", "Blood Urea Nitrogen"),
    "2160-0": ("Creatinine", "Creat"),
    "13457-7": ("LDL", "LDL-C", "LDL Cholesterol"),
    "2085-9": ("HDL", "HDL-C", "HDL Cholesterol"),
    "2093-3": ("Total Cholesterol", "Cholesterol Total"),
    "2571-8": ("Triglycerides", "TG"),
    "3016-3": ("TSH", "Thyroid Stimulating Hormone"),
    "3024-7": ("Free T4", "FT4"),
    "3053-6": ("Free T3", "FT3"),
    "1988-5": ("CRP", "C-Reactive Protein"),
    "30341-2": ("ESR", "Sed Rate"),
    "5902-2": ("PT", "Prothrombin Time"),
    "6301-6": ("INR",),
    "14979-9": ("PTT", "aPTT"),
    "1989-3": ("Vitamin D", "Vit D"),
    "2132-9": ("B12", "Vitamin B12"),
    "2276-4": ("Ferritin",),
    "2498-4": ("Iron", "Serum Iron"),
    "2500-7": ("TIBC",),
    "2345-7": ("Sugar (Fasting)", "Fasting Blood Sugar", "Blood Sugar", "Fasting Glucose"),
}

# ---- page images
MAX_SKEW_DEG, MIN_SKEW_DEG = 15.0, 0.3
MAX_IMAGE_PIXELS, MIN_IMAGE_WIDTH = 9_000_000, 1000
NOISE_LIMIT, SHARPNESS_LIMIT, CONTRAST_LIMIT = 0.8, 250.0, 150.0
ORIENTATION_CONFIDENCE = 1.5
MAX_OCR_WIDTH, MAX_OCR_PIXELS = 3600, 8_000_000
MODEL_IMAGE_SIDE, MODEL_IMAGE_QUALITY = 2000, 80
#: Input limits of a row that a person adds or edits: column, most characters.
INPUT_LIMITS = {
    "original_test_name": 512, "value": 512, "unit": 128, "reference_range": 4000, "specimen": 256, "method": 512, "timing": 256, "flag": 64,
}


def settings(spark=None, env: dict[str, str] | None = None) -> dict[str, object]:
    """SRC-23: the scalar values of this module, overridden by environment variables (VIALFRAME_NAME), these by Spark
    settings (spark.vialframe.name). An override must read as the value's own kind."""
    import os

    env = dict(os.environ) if env is None else env
    out: dict[str, object] = {}
    for name, value in sorted(globals().items()):
        if not name.isupper() or not isinstance(value, bool | int | float | str):
            continue
        given = env.get(f"VIALFRAME_{name}")
        if spark is not None:
            given = spark.conf.get(f"spark.vialframe.{name.lower()}", given)
        if given is not None:
            value = given.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, bool) else type(value)(given)
        out[name] = value
    return out
