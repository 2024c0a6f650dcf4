"""Text cleaning, counting and scoring as column expressions; NFKC alone is an Arrow UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.batches import parts

LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
HEADER_LINE = "(?i)^(Page\\s+\\d+|Confidential|[A-Z]{2,}\\s+\\d+$)"
MATH = ("\\\\frac", "\\\\sum", "\\\\int", "\\\\sqrt", "[=<>]\\s*\\d", "\\^\\{?\\d", "[∑∫√π∞]", "\\$[^$]+\\$")
FORMULA_WEIGHTS = {
    "\\int": 2, "\\sum": 2, "\\prod": 2, "\\frac": 1, "\\sqrt": 1, "\\partial": 2, "^": 1, "_": 1, "\\alpha": 1,
    "\\beta": 1, "\\gamma": 1, "\\matrix": 3, "\\begin": 2,
}


def nfkc_parts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        for start, n in parts(array):
            yield pa.array([t and unicodedata.normalize("NFKC", t) for t in array.slice(start, n).to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfkc(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return nfkc_parts(x)


def words(x: Column) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def line_count(x: Column) -> Column:
    return F.size(F.split(x, "\n"))


def sentence_count(x: Column) -> Column:
    """Runs of full stops, exclamation and question marks before white space or the end; one at least."""
    return F.greatest(F.regexp_count(x, F.lit("[.!?]+(\\s|$)")), F.lit(1))


def readability(x: Column) -> Column:
    return word_count(x) / sentence_count(x)


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def replace_ligatures(x: Column) -> Column:
    for a, b in LIGATURES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_non_ascii(x: Column) -> Column:
    return F.regexp_replace(x, "[^\\x00-\\x7F]", "")


def strip_cid(x: Column) -> Column:
    return F.regexp_replace(x, "\\(cid:\\d+\\)", "")


def collapse_repeats(x: Column, letters_only: bool = False) -> Column:
    """Three or more of one character become one; also in numbers unless ``letters_only``."""
    return F.regexp_replace(x, "([A-Za-z])\\1{2,}" if letters_only else "(.)\\1{2,}", "$1")


def drop_short_runs(x: Column) -> Column:
    """Removes three short words in a row; meant for text without accents (see ``strip_non_ascii``)."""
    return F.regexp_replace(x, "\\b\\w{1,3}\\s+\\w{1,3}\\s+\\w{1,3}\\b", "")


def allowed_characters(x: Column, extra: str = "") -> Column:
    return F.regexp_replace(x, f"[^\\w\\s.,!?{extra}]", "")


def correct_numbers(x: Column) -> Column:
    """Letters and points that character recognition puts into numbers."""
    for pattern, digit in (("(?<!\\d)[Il](?=\\d{2,})", "1"), ("\\bO(?=\\d)", "0"), ("(?<=\\d)[Oo](?=\\d)", "0")):
        x = F.regexp_replace(x, pattern, digit)
    return F.regexp_replace(x, "(?<=\\d)\\.(?=\\d{3})", ",")


def guard_numbers(x: Column) -> Column:
    """A last group of one digit gets two zeros: ``1,5`` becomes ``1,500``."""
    return F.regexp_replace(x, "\\b((?:\\d{1,3},)+\\d)\\b", "$1\\0\\0")  # an escaped digit is no group


def kept_lines(x: Column, least_length: int = 10, least_share: float = 0.3) -> Column:
    """Lines of over ``least_length`` characters of which word characters are at least a share."""
    return F.filter(
        F.split(x, "\n"),
        lambda line: (F.length(line) > least_length)
        & (F.length(F.regexp_replace(line, "[^A-Za-z0-9_]", "")) >= F.lit(least_share) * F.length(line)),
    )


def drop_header_lines(x: Column) -> Column:
    return F.array_join(F.filter(F.split(x, "\n"), lambda line: ~line.rlike(HEADER_LINE)), "\n")


def has_math(x: Column) -> Column:
    return x.rlike("|".join(MATH))


def clean(x: Column, normalise: bool = True) -> Column:
    """The chain: NFKC, ligatures, ASCII, header lines, space, repeats, cid marks, short runs, allowed characters."""
    if normalise:
        x = nfkc(x)
    x = drop_header_lines(strip_non_ascii(replace_ligatures(x)))
    return collapse_space(allowed_characters(drop_short_runs(strip_cid(collapse_repeats(collapse_space(x))))))


def correct(x: Column, confidence: Column | None = None, threshold: float = 80.0) -> Column:
    """Text recognition repair: basic, patterns and numbers; only where the confidence is below the threshold."""
    fixed = correct_numbers(collapse_repeats(collapse_space(allowed_characters(strip_cid(x), "₹$:/-")), True))
    return fixed if confidence is None else F.when(confidence < threshold, fixed).otherwise(x)


def replace_fuzzy(x: Column, pairs: Mapping[str, str], threshold: float = 0.85) -> Column:
    """Literal replacements whose two sides are alike; the likeness depends on the configuration alone."""
    for wrong, right in pairs.items():
        if SequenceMatcher(None, wrong, right).ratio() >= threshold:
            x = F.replace(x, F.lit(wrong), F.lit(right))
    return x


def break_headings(x: Column, phrases: Iterable[str]) -> Column:
    """Upper-cases key phrases and puts them on lines of their own."""
    for p in phrases:
        x = F.regexp_replace(x, "(?i)\\s*\\Q" + p + "\\E\\s*", "\n" + p.upper().replace("$", "\\$") + "\n")
    return x


def formula_variables(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("\\\\?([a-zA-Z])"), 1))


def formula_complexity(x: Column) -> Column:
    total = F.lit(0)
    for token, weight in FORMULA_WEIGHTS.items():
        total = total + weight * (F.length(x) - F.length(F.replace(x, F.lit(token), F.lit("")))) / len(token)
    return F.least(F.lit(10), total.cast("int"))


def extract_formula(x: Column) -> Column:
    """What stands between the first formula delimiters; null if there are none."""
    found = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in ("(?s)\\$\\$(.+?)\\$\\$", "(?s)\\\\\\[(.+?)\\\\\\]", "(?s)\\\\\\((.+?)\\\\\\)", "\\$([^$]+)\\$", "(?s)(<math.*?</math>)")]
    return F.coalesce(*found)


def code_lines(x: Column) -> Column:
    lines = F.split(x, "\n")
    return F.struct(
        F.size(lines).alias("total"),
        F.size(F.filter(lines, lambda l: F.trim(l) != "")).alias("filled"),
        F.size(F.filter(lines, lambda l: F.trim(l).startswith("#"))).alias("comments"),
    )


def citations(x: Column) -> Column:
    """Entries that begin a line with ``1.``, a bullet or ``[1]``."""
    return F.filter(F.transform(F.split(x, "(?:^|\\n)\\s*(?:\\d+\\.|•|\\[\\d+\\])\\s+"), lambda p: F.trim(p)), lambda c: c != "")


def clauses(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\\."), lambda p: F.trim(p)), lambda c: F.length(c) > 10)


def format_size(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%.1f B", n.cast("double")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / float(1024**k)))
    return out.otherwise(F.format_string("%.1f TB", n / float(1024**4)))


def infer_type(cell: Column) -> Column:
    """numeric, date or text, as Python's ``float`` and a date prefix would tell; null for null."""
    number = "^\\s*[+-]?((\\d+(_\\d+)*)?\\.?\\d+(_\\d+)*|\\d+(_\\d+)*\\.)([eE][+-]?\\d+)?\\s*$|(?i)^\\s*[+-]?(nan|inf|infinity)\\s*$"
    return F.when(cell.rlike(number), "numeric").when(cell.rlike("^\\d{4}-\\d{2}-\\d{2}"), "date").when(cell.isNotNull(), "text")
