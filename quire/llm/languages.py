"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every byte n-gram (2 to 4 bytes of the lower-cased UTF-8 text, ended by zero bytes) is hashed to a bucket that has an
embedding; a text's vector is the average over its n-grams, and a linear softmax gives the language.  The model is
trained in numpy by stochastic gradient descent on a bounded, documented sample of labelled rows.  One more class stands
for text of no learned language; its examples are made: training snippets with their letters shuffled, and words of random
letters of other scripts.  A temperature fitted on rows kept out of training calibrates the probabilities.  The score is the
probability of the language; the rejection threshold is its ``rejected_share`` quantile over correctly labelled rows that
were kept out.

As average and softmax layer are both linear before the softmax, prediction needs only one number a bucket and language:
the product of embeddings and weights is broadcast inside the task closure (buckets x languages floats).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices, string_offsets

GRAMS = (2, 3, 4)
PAD = 4
PREDICTION = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class LanguageModel:
    """``table`` has a row a bucket and one of zeros; a column a language and one for none of them."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    validation: dict = field(default_factory=dict)


def buckets_of(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; ``data`` must have n - 1 more bytes at its end."""
    size = len(data) - PAD + 1
    h = np.full(size, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        h ^= data[k : k + size]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h & np.uint32(buckets - 1)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined with zero bytes after each; the start of each; which positions belong to a text."""
    data = np.frombuffer((b"\0" * PAD).join(texts) + b"\0" * (2 * PAD), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, starts + lengths, -1)
    return data, starts, np.cumsum(inside[:-1]).astype(bool)


def logits(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """A row a text; texts without bytes get the bias alone."""
    buckets = len(model.table) - 1
    data, starts, inside = padded(texts)
    size = len(data) - PAD + 1
    outside = ~inside[:size]
    indexes = []
    for n in GRAMS:
        b = buckets_of(data, n, buckets).astype(np.int32)
        b[outside] = buckets
        indexes.append(b)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    scale = 1.0 / np.maximum(1, len(GRAMS) * lengths)
    result = np.empty((len(texts), len(model.bias)))
    for k in range(len(model.bias)):
        column = np.ascontiguousarray(model.table[:, k])
        total = column[indexes[0]]
        for b in indexes[1:]:
            total += column[b]
        result[:, k] = np.add.reduceat(total, starts, dtype=np.float64) * scale + model.bias[k]
    return result


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sparse(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their share of its n-grams."""
    data = np.frombuffer(text + b"\0" * (2 * PAD), np.uint8)
    counts = np.zeros(buckets, np.float32)
    for n in GRAMS:
        counts += np.bincount(buckets_of(data, n, buckets)[: len(text)], minlength=buckets)
    index = np.flatnonzero(counts)
    return index, counts[index] / max(1.0, float(counts.sum()))


def snippet(text: bytes, rng: np.random.Generator) -> bytes:
    """A few words from somewhere in a text, so that short texts are learned too."""
    words = text.split()
    if len(words) < 4:
        return text
    n = int(rng.integers(2, 13))
    k = int(rng.integers(0, max(1, len(words) - n)))
    return b" ".join(words[k : k + n])


#: First letters of scripts from which words of no language are made, and how many letters each has.
SCRIPTS = ((0x3B1, 25), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x4E00, 2000), (0xAC00, 2000), (0x3041, 86))


def nonsense(text: bytes, rng: np.random.Generator) -> bytes:
    """Text of no language: the letters of ``text`` shuffled, or words of random letters of one script."""
    if rng.random() < 0.5:
        words = text.decode(errors="ignore").split()
        letters = list("".join(words))
        rng.shuffle(letters)
        sizes = np.cumsum([len(w) for w in words])
        return " ".join("".join(letters[a:b]) for a, b in zip([0, *sizes.tolist()], sizes.tolist())).encode()
    first, size = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
    words = ("".join(chr(first + int(k)) for k in rng.integers(0, size, rng.integers(1, 9))) for _ in range(int(rng.integers(2, 13))))
    return " ".join(words).encode()


def fit(
    rows: list[tuple[int, str, str]],
    buckets: int = 1 << 14,
    dimension: int = 16,
    epochs: int = 4,
    rate: float = 4.0,
    seed: int = 7,
    rejected_share: float = 0.0005,
) -> LanguageModel:
    """Trains on (doc_id, text, lang) rows, which count once each; their order doesn't matter.

    No rows: a model without languages.  ``validation`` has, of the rows kept out, their number, the accuracy, the share
    rejected, and the share of made text of no language that isn't.
    """
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    languages = sorted({r[2] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    texts = [r[1].lower().encode() for r in rows]
    label = np.array([languages.index(r[2]) for r in rows])
    kept_out = rng.random(len(rows)) < 0.2
    if kept_out.all() or len(rows) < 20:
        kept_out[:] = False
    train = np.flatnonzero(~kept_out)
    examples = [(sparse(texts[i], buckets), label[i]) for i in train]
    examples += [(sparse(snippet(texts[i], rng), buckets), label[i]) for i in train for _ in range(2)]
    none = len(languages)
    examples += [(sparse(nonsense(snippet(texts[i], rng), rng), buckets), none) for i in train]
    emb = rng.normal(0, 0.1, (buckets, dimension)).astype(np.float32)
    weights = np.zeros((dimension, none + 1), np.float32)
    bias = np.zeros(none + 1, np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            (index, share), y = examples[i]
            step = rate * (1 - done / steps)
            done += 1
            x = share @ emb[index]
            g = softmax(x @ weights + bias)
            g[y] -= 1
            back = weights @ g
            weights -= step * np.outer(x, g)
            bias -= 0.01 * step * g
            emb[index] -= step * np.outer(share, back)
    table = np.vstack([emb @ weights, np.zeros((1, none + 1), np.float32)]).astype(np.float32)
    model = LanguageModel(languages, table, bias.astype(np.float64))
    calibrate(model, texts, label, kept_out if kept_out.any() else ~kept_out, rng, rejected_share)
    return model


def calibrate(model, texts, label, which, rng, rejected_share: float) -> None:
    """Fits the temperature by likelihood on whole texts and snippets, then takes the threshold."""
    chosen = [texts[i] for i in np.flatnonzero(which)]
    chosen += [snippet(t, rng) for t in chosen]
    y = np.concatenate([label[which], label[which]])
    raw = logits(model, chosen)
    best = min(
        np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).sum()
    )
    model.temperature = float(best)
    p = probabilities(model, chosen)
    right, top = p.argmax(axis=1) == y, p.max(axis=1)
    model.threshold = float(np.quantile(top[right], rejected_share)) if right.any() else 0.0
    made = probabilities(model, [nonsense(t, rng) for t in chosen]).max(axis=1)
    model.validation = {
        "rows": len(y),
        "accuracy": float(right.mean()),
        "rejected": float((top < model.threshold).mean()),
        "nonsense_accepted": float((made >= model.threshold).mean()),
    }


def probabilities(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """Of each language, a row a text; what is missing to 1 is the probability of none."""
    return softmax(logits(model, texts) / model.temperature)[:, : len(model.languages)]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, rows_per_language: int, most_languages: int = 1000) -> list[tuple]:
    """A sample of labelled rows, bounded by parameters, spread evenly over the whole table by a hash of id and text.

    Languages are counted over all rows; each contributes about ``rows_per_language`` rows, repeated rows once.  Only the
    ``most_languages`` most frequent ones are learned.
    """
    usable = docs.filter(~held_out(docs["doc_id"]) & docs["lang"].isNotNull() & docs["text"].rlike("\\p{L}"))
    counts = (
        usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    )
    if not counts:
        return []
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(None).cast("double")
    rates = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(rows_per_language / r[1]))])
    rate = rates[F.col("lang")]
    picked = usable.select("doc_id", "text", "lang").filter(spread < rate)
    return [tuple(r) for r in picked.distinct().collect()]


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``; whole texts, no shuffle.

    ``und`` with score 0 and rejected: text null or without a letter, or a model without languages.  Ties between
    languages go to the first in order of name.  Repeated rows are predicted one by one; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"),
    )
    return rows.mapInArrow(lambda b: _predict(b, model), PREDICTION)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PREDICTION.split(", ")]
    languages = pa.array([*model.languages, "und"], pa.string())
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            lowered = pc.fill_null(pc.utf8_lower(part.column("text")), "")
            offsets = string_offsets(lowered)
            raw = memoryview(lowered.buffers()[2] or b"")
            texts = [bytes(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            known = np.fromiter((len(t) > 0 for t in texts), bool, len(texts)) & bool(model.languages)
            if model.languages:
                p = probabilities(model, texts)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            best = np.where(known, best, len(model.languages))
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    languages.take(pa.array(best)),
                    pa.array(score, pa.float64()),
                    pa.array(~known | (score < model.threshold)),
                ],
                names,
            )


def identify(docs: DataFrame, rows_per_language: int = 500, **options) -> DataFrame:
    """Trains on the rows of ``docs`` that aren't held out and predicts all of it: see ``training_rows`` and ``predict``.

    Rows with null text, null ``lang`` or null doc_id aren't learned from.  An empty table gives no rows.
    """
    return predict(docs, fit(training_rows(docs, rows_per_language), **options))


def keep_recognised(docs: DataFrame, rows_per_language: int = 500, **options) -> DataFrame:
    """The rows of ``docs`` whose language the model trained on them recognises, with all their columns.

    Rejected are texts that are null or have no letter, and those with a calibrated probability below the threshold.  A null
    ``lang`` becomes the language found.  Without labelled rows there is no model, and only texts without a letter go.
    Repeated rows are judged one by one.  A table without ``lang`` is an error.
    """
    if "lang" not in docs.columns:
        raise ValueError("keep_recognised learns from the column lang, which the table lacks")
    model = fit(training_rows(docs, rows_per_language), **options)
    fields, lettered = docs.schema.fields, F.col("text").rlike("\\p{L}")
    if not model.languages:
        return docs.filter(lettered)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang, rejected = _judged(part.column("text"), model)
                columns = [part.column(f.name) for f in fields]
                at = next(k for k, f in enumerate(fields) if f.name == "lang")
                columns[at] = pc.coalesce(columns[at], lang)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields]).filter(pc.invert(rejected))

    return docs.filter(lettered).mapInArrow(run, schema)


def _judged(text: pa.Array, model: LanguageModel) -> tuple[pa.Array, pa.Array]:
    texts = [x.encode() for x in pc.fill_null(pc.utf8_lower(text), "").to_pylist()]
    p = probabilities(model, texts)
    lang = pa.array(model.languages, pa.string()).take(pa.array(p.argmax(axis=1)))
    return lang, pa.array(p.max(axis=1) < model.threshold)
