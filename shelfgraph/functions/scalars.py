"""Scalar operators as Column functions; each is one native expression. IDs in brackets name the inventory's operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgraph.constants import MISSING

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def string_id(x: C) -> Column:
    """[SCL-S2] trimmed text of an id, '' if missing."""
    return F.coalesce(F.trim(_c(x).cast("string")), F.lit(""))


def normalized(x: C, lower: bool = False) -> Column:
    """[SCL-S3, S5] trimmed text, '' if missing."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return F.lower(t) if lower else t


def match_key(x: C, ascii_key: bool = False) -> Column:
    """[SCL-S4] lower case, runs of anything but letters and digits as one space. ascii_key keeps a-z and 0-9 alone."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+" if ascii_key else r"[^\p{L}\p{N}]+", " "))


def token_key(x: C) -> Column:
    """[SCL-S6] lower case, word characters alone."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}_]", "")


def clean(x: C) -> Column:
    """[SCL-S1, S7, S8, S9, S13] trimmed text, null for blank and for words that mean missing."""
    t = F.trim(_c(x).cast("string"))
    return F.when(~F.lower(t).isin(*MISSING), t)


def title_variants(x: C) -> Column:
    """[SCL-S10] the title, squeezed, before a colon, before a bracket, without punctuation; distinct, sorted."""
    t = F.trim(_c(x))
    forms = [
        t, F.trim(F.regexp_replace(t, r"\s+", " ")), F.trim(F.split(t, ":", 2)[0]), F.trim(F.split(t, r"\(", 2)[0]),
        F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda v: v != "")))


def similarity_ratio(a: C, b: C) -> Column:
    """[SCL-S12] 100 for equal sorted tokens, else 100 times the mean of token and character Jaccard, rounded to 2."""
    words = lambda x: F.array_sort(F.filter(F.split(F.lower(F.trim(_c(x))), r"\s+"), lambda w: w != ""))
    ta, tb = words(a), words(b)
    chars = lambda t: F.array_distinct(F.filter(F.split(F.array_join(t, " "), ""), lambda w: w != ""))
    jaccard = lambda p, q: F.when(F.size(F.array_union(p, q)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
    return F.when(ta == tb, F.lit(100.0)).otherwise(F.round(50.0 * (jaccard(F.array_distinct(ta), F.array_distinct(tb)) + jaccard(chars(ta), chars(tb))), 2))


def shortened(x: C, width: int = 300) -> Column:
    """[SCL-S14] white space squeezed; longer texts cut before the word that passes width, with an ellipsis."""
    t = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    cut = F.regexp_extract(F.substring(t, 1, width), r"^(.*)\s", 1)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(t, 1, width)), F.lit("…")))


def duration(seconds: C) -> Column:
    """[SCL-S15] HH:MM:SS."""
    s = F.round(_c(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def isbn(x: C) -> Column:
    """[SCL-S16] digits and X alone."""
    return F.regexp_replace(_c(x), "[^0-9Xx]", "")


def quoted_tokens(x: C) -> Column:
    """[SCL-S17] texts between single or double quotes."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(r"('[^']*'|\"[^\"]*\")"), F.lit(1)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))


def safe_int(x: C) -> Column:
    """[SCL-N1] whole number or null; '2005.0' is none."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def to_year(x: C) -> Column:
    """[SCL-N2] whole part of a number, or null."""
    return F.trim(_c(x).cast("string")).try_cast("double").try_cast("int")


def to_number(x: C) -> Column:
    """[SCL-N3] number or null."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def age(death: C, birth: C) -> Column:
    """[SCL-N4]"""
    return _c(death) - _c(birth)


def blend(dense: C, sparse: C, weight: float) -> Column:
    """[SCL-N5, N6] (1 - w) dense + w sparse, w cut to 0 .. 1."""
    w = max(0.0, min(1.0, weight))
    return (1 - w) * _c(dense) + w * _c(sparse)


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: C) -> Column:
    """[SCL-N7] vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(_c(v), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def statement_time(x: C) -> Column:
    """[SCL-D1] struct of date text and year of '+YYYY[-MM-DD]...'; both null for other forms."""
    m = lambda g: F.regexp_extract(_c(x), r"^\+?(\d{4})(?:-(\d{2})-(\d{2}))?", g)
    text = F.when(m(1) != "", F.when(m(2) != "", F.concat_ws("-", m(1), m(2), m(3))).otherwise(m(1)))
    return F.struct(text.alias("text"), F.when(m(1) != "", m(1)).cast("int").alias("year"))


def ymd_date(y: C, m: C, d: C) -> Column:
    """[SCL-D2] date, null if there is none such."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _c(y), _c(m), _c(d)), "yyyy-MM-dd")


def parsed_list(x: C) -> Column:
    """[SCL-A1, A2, A6, A8, A9] a JSON list, a list with single quotes, or the text as its only item."""
    t = F.trim(_c(x))
    both = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.translate(t, "'", '"'), "array<string>"))
    return F.when(clean(t).isNull(), F.array().cast("array<string>")).otherwise(F.when(t.startswith("["), F.coalesce(both, F.array(t))).otherwise(F.array(t)))


def split_multi(x: C) -> Column:
    """[SCL-A7, A12] items between semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")


def clean_ids(a: C) -> Column:
    """[SCL-A3, SET5] trimmed ids without blanks; first occurrences."""
    return F.array_distinct(F.filter(F.transform(_c(a), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))


def clean_strings(a: C, lower: bool = True, exclude=(), drop_numeric: bool = False, min_length: int = 0, parts=(), patterns=()) -> Column:
    """[SCL-A4] trimmed items that pass the deny lists; first occurrences."""
    items = F.transform(_c(a), lambda v: F.lower(F.trim(v)) if lower else F.trim(v))
    return F.array_distinct(F.filter(items, lambda v: v.isNotNull() & (v != "") & (F.length(v) >= min_length) & ~denied(v, exclude, parts, patterns, drop_numeric)))


def denied(v: Column, exclude=(), parts=(), patterns=(), numeric: bool = True) -> Column:
    """[FLT6] in the set, holding one of the parts, matching a pattern, or digits alone."""
    out = v.isin(*exclude) if exclude else F.lit(False)
    if parts:
        out = out | v.rlike("|".join(p.replace("-", "[-]") for p in parts))
    if patterns:
        out = out | v.rlike("|".join(patterns))
    return out | v.rlike(r"^\p{Nd}+$") if numeric else out


def clean_authors(a: C) -> Column:
    """[SCL-A5] id and role, trimmed; items without an id go."""
    return F.filter(F.transform(_c(a), lambda x: F.struct(F.trim(x["author_id"]).alias("author_id"), F.coalesce(F.trim(x["role"]), F.lit("")).alias("role"))), lambda x: x["author_id"].isNotNull() & (x["author_id"] != ""))


def unique_ignoring_case(a: C) -> Column:
    """[SCL-A10, A11, A13] trimmed items, each once whatever its case; the first casing stays."""
    items = F.filter(F.transform(_c(a), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    # sorted by their lower case, equal items are neighbours: n log n; an array of one makes the sorted items a variable, computed once
    placed = F.array_sort(F.transform(items, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def json_values(doc: C, path: str) -> Column:
    """[SCL-A14, A16, A17] texts of a JSON path's array, or of its value."""
    raw = F.get_json_object(_c(doc), path)
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))


def is_english(x: C) -> Column:
    """[FLT2, FLT3] '1', a code of English, or anything that starts with en."""
    t = F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))))
    t = F.when(t.rlike(r"^\d+\.0*$"), F.regexp_extract(t, r"^(\d+)", 1)).otherwise(t)
    return (t == "1") | t.startswith("en")


def sample_key(x: C, seed: int) -> Column:
    """[TOP1] hash of seed and key, of any type, that other engines can repeat: order by it for a seeded uniform sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(x).cast("string")))
