"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def clean(s: Column) -> Column:
    """FN-01: lower case, every run of other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def strip(s: Column, chars: str = C.SPACE) -> Column:
    """Without white space (of any script, or the given characters of a class) at both ends."""
    return F.regexp_replace(s, f"^[{chars}]+|[{chars}]+$", "")


def blank_to_null(s: Column) -> Column:
    """FN-21: null for what is empty after trimming."""
    return F.when(strip(s) != "", s)


def standardize_unit(raw: Column) -> Column:
    """FN-02: drop [H], [L] and [ ] marks, trim, micro sign to u, and the common variants to one spelling."""
    bare = F.translate(strip(F.regexp_replace(raw, C.spaced(r"\[(H|L)\]|\[\s*\]"), "")), "µ", "u")
    known = F.create_map(*[F.lit(x) for kv in [*C.UNIT_VARIANTS.items(), ("ul", "uL")] for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(known, F.lower(bare)), bare), F.lit(""))


def tokenize(s: Column) -> Column:
    """FN-03: a-z0-9 runs of two or more characters that are no stop word, in order, repeats kept; null: none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*C.STOPWORDS))


def unit_key(u: Column) -> Column:
    """FN-04: the unit's letters and digits in lower case; null: empty."""
    return F.regexp_replace(F.lower(F.coalesce(u, F.lit(""))), "[^a-z0-9]", "")


def make_key(name: Column, specimen: Column, unit: Column) -> Column:
    """FN-05: cleaned name|specimen|unit, at most 512 characters."""
    parts = [clean(F.coalesce(c, F.lit(""))) for c in (name, specimen, unit)]
    return F.substring(F.concat_ws("|", *parts), 1, C.LEARNED_KEY_CHARS)


def clip(s: Column, limit: int) -> Column:
    """FN-20: longer texts become their first limit-1 characters and an ellipsis."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def short(s: Column, limit: int = 90) -> Column:
    """FN-25: white space collapsed, then clipped."""
    return clip(F.trim(F.regexp_replace(s, C.spaced(r"\s+"), " ")), limit)


def describe_error(kind: Column, message: Column) -> Column:
    """FN-26: ``kind: message``, at most 500 characters."""
    return F.substring(F.concat(kind, F.lit(": "), F.coalesce(message, F.lit(""))), 1, 500)


def lenient_json(s: Column) -> Column:
    """FN-27: the JSON of a text: the text itself, or its outermost {...} where fences or chatter stand around it; null if neither parses."""
    whole, inner = strip(s), F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(whole.startswith("{") & parses(whole), whole).when(parses(inner), inner)


def redact(s: Column, secrets: tuple[str, ...] = ()) -> Column:
    """FN-28: secret-shaped strings, and given secrets of eight characters or more, replaced."""
    for pattern, to in C.SECRET_PATTERNS:
        s = F.regexp_replace(s, pattern, to)
    for secret in secrets:
        if secret and len(secret) >= 8:
            s = F.replace(s, F.lit(secret), F.lit("[REDACTED]"))
    return s


def resolve_content_type(filename: Column, declared: Column) -> Column:
    """SRC-08: a blank or generic declared type gives way to the file extension's."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    declared = F.coalesce(declared, F.lit(""))
    by_name = F.coalesce(*[F.when(name.endswith(ext), F.lit(kind)) for ext, kind in C.CONTENT_TYPES.items()], declared)
    return F.when(declared.isin("", "application/octet-stream"), by_name).otherwise(declared)


def upload_problem(content_type: Column, n_bytes: Column, max_mb: int = C.MAX_UPLOAD_MB) -> Column:
    """SRC-09: the HTTP status with which an upload is refused, else null; types first, then size, then emptiness."""
    known = content_type.isin(*sorted(set(C.CONTENT_TYPES.values()))) | content_type.startswith("image/") | content_type.startswith("text/")
    return (
        F.when(~known, F.lit(415)).when(n_bytes > max_mb * 1024 * 1024, F.lit(413)).when(n_bytes == 0, F.lit(400)).otherwise(F.lit(None).cast("int"))
    )


def page_source(content_type: Column) -> Column:
    """SRC-01: which reader a content type goes to."""
    return (
        F.when(content_type.startswith("image/"), "image")
        .when(content_type.isin("application/pdf", "application/octet-stream"), "pdf")
        .when(content_type == C.CONTENT_TYPES[".docx"], "docx")
        .when(content_type.startswith("text/"), "text")
        .otherwise("unsupported")
    )


def normalize_database_url(url: Column) -> Column:
    """SRC-24."""
    return F.regexp_replace(url, "^postgres://", "postgresql://")


def is_request_id(s: Column) -> Column:
    """FN-40."""
    return F.coalesce(F.rlike(s, F.lit(r"^[A-Za-z0-9_-]{6,64}$")), F.lit(False))


def is_transient(status: Column) -> Column:
    """FLT-19: worth a retry: too many requests, or the server's fault."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def document_budget(pages: Column) -> Column:
    """FN-31: seconds a document may take."""
    return F.greatest(F.lit(C.BUDGET_MIN_SECONDS), C.BUDGET_PAGE_SECONDS * F.coalesce(pages, F.lit(0)))


def effective_concurrency(requested: Column, dialect: Column, sqlite_cap: int = 1) -> Column:
    """FN-30: at least one worker; no more than the cap where the store takes one writer."""
    wanted = F.greatest(F.lit(1), requested)
    return F.when(dialect == "sqlite", F.least(wanted, F.lit(sqlite_cap))).otherwise(wanted)


def percent_done(done: Column, total: Column) -> Column:
    """FN-36: progress in per cent, at most 99."""
    return F.least(F.lit(99), F.round((done + 0.3) / total * 100, 0).cast("int"))


def like_any(q: str, *cols: Column) -> Column:
    """Case-insensitive 'contains' over several columns; % and _ of the user's text stay wildcards."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(c.ilike(f"%{q}%"), F.lit(False))
    return hit


def file_kind(content_type: Column, filename: Column) -> Column:
    """FLT-18: what kind of file a list shows."""
    ct, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    return (
        F.when((ct == C.CONTENT_TYPES[".pdf"]) | name.endswith(".pdf"), "pdf")
        .when(ct.startswith("image/") | F.rlike(name, F.lit(r"\.(png|jpe?g)$")), "image")
        .when((ct == C.CONTENT_TYPES[".docx"]) | name.endswith(".docx"), "docx")
        .when(ct.startswith("text/") | name.endswith(".txt"), "text")
        .otherwise("other")
    )


def status_label(status: Column, cancel_requested: Column) -> Column:
    """FLT-18: the label of a document's state."""
    return (
        F.when(cancel_requested & (status == "processing"), "Cancelling")
        .when(status == "pending", "Queued")
        .when(status.isin("processing", "complete", "failed", "cancelled"), F.initcap(status))
        .otherwise(status)
    )


def input_problem(created: bool = True) -> Column:
    """FN-21: why a row that a person adds (or edits) is refused, over its columns; null if it is fine."""
    name = F.col("original_test_name")
    blank = (strip(name) == "") | (name.isNull() if created else F.lit(False))
    checks = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n} characters")) for c, n in C.INPUT_LIMITS.items()]
    page = [F.when(F.col("page_number") < 1, F.lit("page_number must be 1 or more"))] if created else []
    return F.coalesce(F.when(blank, F.lit("original_test_name must not be blank")), *checks, *page)
