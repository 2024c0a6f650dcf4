"""Sentiment by a word list, keywords, clause labels and legal entities: plain expressions, with tables that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = ("good", "great", "excellent", "happy", "best", "love", "nice", "clean", "safe", "fine", "useful", "strong")
NEGATIVE = ("bad", "poor", "terrible", "sad", "worst", "hate", "ugly", "dirty", "toxic", "wrong", "useless", "weak")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: label: pattern, in the order that decides.
CLAUSES = {
    "termination": "terminat|expir",
    "payment": "pay|fee|invoice|rent",
    "confidentiality": "confidential|secret",
    "liability": "liab|indemn|damage",
    "obligation": "shall|must",
}
#: type: pattern.
ENTITIES = {
    "date": "\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}",
    "amount": "[$€]\\s?\\d+(?:[.,]\\d+)*",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "section": "(?:Section|Article|Clause)\\s+\\d+",
}


def polarity(x: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """The mean of +1 and -1 over the words of the lists, -1 to 1; 0 without any, null for null."""
    words = F.split(F.lower(x), "[^a-z]+")
    good = F.size(F.filter(words, lambda w: w.isin(*positive)))
    bad = F.size(F.filter(words, lambda w: w.isin(*negative)))
    return F.when(x.isNull(), None).when(good + bad == 0, 0.0).otherwise((good - bad) / (good + bad))


def paragraphs(x: Column) -> Column:
    return F.filter(F.split(x, "\\n\\s*\\n"), lambda p: F.trim(p) != "")


def mean_polarity(x: Column) -> Column:
    """The mean over a text's paragraphs; 0 without paragraphs."""
    found = F.transform(F.coalesce(paragraphs(x), F.array().cast("array<string>")), lambda p: polarity(p))
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)


def keywords(rows: DataFrame, key: str, text: str, k: int = 5, least: int = 3) -> DataFrame:
    """(key, rank, word, n): the ``k`` most frequent words of a row that aren't stop words, the alphabetically first of equals."""
    words = rows.select(key, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word"))
    words = words.filter((F.length("word") >= least) & ~F.col("word").isin(*STOP_WORDS))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", "word", "n")


def clause_label(x: Column, labels: dict[str, str] = CLAUSES) -> Column:
    """The first label whose pattern the clause has, else ``other``."""
    found = F.lit("other")
    for name, pattern in reversed(labels.items()):
        found = F.when(F.lower(x).rlike(pattern), name).otherwise(found)
    return found


def clause_score(x: Column, labels: dict[str, str] = CLAUSES) -> Column:
    """The share of the labels' patterns found that the deciding label stands for: 1 over their number; 0 for ``other``."""
    hits = sum((F.lower(x).rlike(p).cast("int") for p in labels.values()), F.lit(0))
    return F.when(hits > 0, 1.0 / hits).otherwise(0.0)


def entities(rows: DataFrame, key: str, text: str, kinds: dict[str, str] = ENTITIES) -> DataFrame:
    """(key, type, entity): all matches of the patterns."""

    def matches(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 0), lambda e: F.struct(F.lit(name).alias("type"), e.alias("entity")))

    return rows.select(key, F.inline(F.flatten(F.array(*[matches(n, p) for n, p in kinds.items()]))))


def entity_spans(rows: DataFrame, key: str, text: str, kinds: dict[str, str] = ENTITIES) -> DataFrame:
    """(key, type, entity, start, end) of the first match of each kind; ``end`` is behind it."""
    parts = [
        F.struct(
            F.lit(n).alias("type"),
            F.regexp_extract(text, f"({p})", 1).alias("entity"),
            (F.regexp_instr(F.col(text), F.lit(p)) - 1).alias("start"),
        )
        for n, p in kinds.items()
    ]
    found = rows.select(key, F.inline(F.array(*parts))).filter("start >= 0")
    return found.withColumn("end", F.col("start") + F.length("entity"))


def repair(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, repaired): of the dictionary (term, n) the nearest term within ``most`` edits; the more frequent of equals.

    Words and terms that are so near share a string that deleting at most ``most`` letters of each gives, so they are found
    by an equi-join.  Words without such a term stay as they are.
    """

    def shorter(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.transform(places, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))

    def cut(x: Column) -> Column:
        found = F.array(x)
        for _ in range(most):
            found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
        return found

    distinct = words.select("word").distinct()
    asked = distinct.select("word", F.explode(cut(F.col("word"))).alias("short"))
    known = dictionary.select("term", "n", F.explode(cut(F.col("term"))).alias("short"))
    pairs = asked.join(known, "short").withColumn("edits", F.levenshtein("word", "term")).filter(F.col("edits") <= most)
    best = pairs.groupBy("word").agg(F.min(F.struct("edits", (-F.col("n")).alias("n"), "term")).alias("b"))
    return distinct.join(best, "word", "left").select("word", F.coalesce("b.term", "word").alias("repaired"))
