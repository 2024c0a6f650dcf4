"""Scripts, languages and text direction from character ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order that decides ties; code point ranges.
RANGES = {
    "latin": ((0x0000, 0x00FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)),
    "cjk": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF)),
    "devanagari": ((0x0900, 0x097F),),
    "telugu": ((0x0C00, 0x0C7F),),
    "cyrillic": ((0x0400, 0x04FF),),
    "thai": ((0x0E00, 0x0E7F),),
    "hebrew": ((0x0590, 0x05FF),),
}
LANGUAGES = {"arabic": "ar", "cjk": "zh", "devanagari": "hi", "telugu": "te", "latin": "en"}
RTL = ("arabic", "hebrew")
HTML_LANGUAGES = {
    "ar": "ar", "ar-ae": "ar", "ar-sa": "ar", "zh": "zh", "zh-cn": "zh", "zh-tw": "zh", "hi": "hi", "hi-in": "hi",
    "te": "te", "te-in": "te", "ja": "ja", "ja-jp": "ja", "ko": "ko", "ko-kr": "ko", "en": "en", "en-us": "en", "en-gb": "en",
}


def _class(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


def histogram(x: Column) -> list[Column]:
    """One column a script with its number of characters."""
    return [(F.length(x) - F.length(F.regexp_replace(x, _class(r), ""))).alias(s) for s, r in RANGES.items()]


def script(x: Column) -> Column:
    """The script with most characters, the earlier of equals; ``unknown`` without any."""
    ranked = [F.struct(h.alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (h, s) in enumerate(zip(histogram(x), RANGES))]
    best = F.array_max(F.array(*ranked))
    # bound once: else every use counts the characters again
    return F.get(F.transform(F.array(best), lambda b: F.when(b["n"] > 0, b["s"]).otherwise("unknown")), F.lit(0))


def process(x: Column) -> Column:
    """script, language, confidence, direction and cleaned text of a text, with its characters counted once."""

    def rest(name: Column) -> Column:
        lang, sure = language_of(name, x)
        return F.struct(
            name.alias("script"), lang.alias("language"), sure.alias("confidence"), direction(name).alias("direction"), clean_script(x, name).alias("text")
        )

    return F.get(F.transform(F.array(script(x)), rest), F.lit(0))


def setting(code: Column, settings: dict[str, str], default: str) -> Column:
    """A language's setting, or the default."""
    return F.coalesce(F.create_map(*[F.lit(v) for pair in settings.items() for v in pair])[code], F.lit(default))


def allowed(x: Column, languages) -> Column:
    """Whether the language of the first 1000 characters is in a list."""
    return process(F.substring(x, 1, 1000))["language"].isin(*languages)


def language_of(script_name: Column, x: Column) -> tuple[Column, Column]:
    """(language, confidence) from the script; ``en`` with 0 for short texts and other scripts."""
    table = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    known = (F.length(F.trim(x)) >= 10) & table[script_name].isNotNull()
    return F.when(known, table[script_name]).otherwise("en"), F.when(known, 0.6).otherwise(0.0)


def direction(script_name: Column) -> Column:
    return F.when(script_name.isin(*RTL), "rtl").otherwise("ltr")


def html_language(tag: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in HTML_LANGUAGES.items() for v in pair])
    return table[F.lower(F.trim(tag))]


def clean_for_detection(x: Column) -> Column:
    """Without URLs, addresses, digits and punctuation."""
    for p in ("https?://\\S+", "\\S+@\\S+", "\\d+", "(?U)[^\\w\\s]"):
        x = F.regexp_replace(x, p, " ")
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def clean_script(x: Column, script_name: Column) -> Column:
    """White space collapsed; Arabic loses its diacritics, CJK its ideographic spaces."""
    x = F.trim(F.regexp_replace(x, "\\s+", " "))
    return (
        F.when(script_name == "arabic", F.regexp_replace(x, "[\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]", ""))
        .when(script_name == "cjk", F.trim(F.regexp_replace(F.regexp_replace(x, "\\x{FEFF}", ""), "[\\s\\x{3000}]+", " ")))
        .otherwise(x)
    )
