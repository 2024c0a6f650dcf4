"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quire.llm import components as module_of_components
from quire.llm import crossparse, edits, languages, media, packing, pieces, queries, shared, simhash, substrings, topk, urlrules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_near long, fp string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["a", "the", "été", "日本", "x1", "foo,", "Bar", "naïve", "q"]
    base = [" ".join(rng.choices(words, k=n)) for n in (40, 60, 100)]
    texts = [None, "", " \n\t ", "one", "two words", *base, base[0], base[0] + " tail", base[1].upper(), "x " * 30_000, "!!! 123"]
    out = [(i, t, "en", 1, "clash") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base[2], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_cross_phrases_and_score(spark, docs, rows, nothing):
    marked = docs.withColumn("in_reference", F.col("doc_id") % 2 == 0)
    got = crossparse.score(marked, block_bytes=1 << 30).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.score is None) == (r.n_words == 0)
        assert r.n_phrases <= r.n_words
    assert crossparse.score(nothing.withColumn("in_reference", F.lit(None).cast("boolean"))).count() == 0
    alone = crossparse.score_against(docs, docs.select("text").limit(0)).collect()
    assert len(alone) == len(rows) and all(r.n_phrases == r.n_words for r in alone)


def test_cross_phrases_brute_force():
    rng = random.Random(1)

    def brute(reference, words):
        at = phrases = 0
        while at < len(words):
            n = 1
            while at + n <= len(words) and any(words[at : at + n] == r[k : k + n] for r in reference for k in range(len(r) - n + 1)):
                n += 1
            at += max(1, n - 1)
            phrases += 1
        return phrases

    for _ in range(400):
        reference = [rng.choices("abc", k=rng.randrange(12)) for _ in range(3)]
        moves = crossparse.suffix_automaton(x for r in reference for x in [*r, None])
        words = rng.choices("abcd", k=rng.randrange(15))
        assert crossparse.cross_phrases(moves, words) == brute(reference, words)


@pytest.mark.parametrize("block_bytes, whole", [(64, False), (1 << 20, True)])
def test_cross_parsing_meets_the_whole_reference(spark, block_bytes, whole):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijk"[: 3 + k % 9], k=rng.randrange(90))) for k in range(60)]
    texts += [texts[3], texts[4], texts[5] + " " + texts[6], "z " * 40 + texts[7], " ".join(texts[:30]), None, ""]
    texts += [" ".join(texts[2:20]), " ".join(texts[20:33]) + " new " + texts[9], texts[10]]
    rows = [(i, t, whole or i % 3 == 0 or i == 64) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, in_reference boolean").repartition(3)
    got = {r.doc_id: r for r in crossparse.score(table, block_bytes, 1000).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        others = [(t or "").split() for k, t, g in rows if g and k != i]
        words = (text or "").split()
        moves = crossparse.suffix_automaton(x for r in others for x in [*r, None])
        n, phrases, own, size = len(words), crossparse.cross_phrases(moves, words), got[i].own_phrases, sum(map(len, others))
        assert (got[i].n_words, got[i].n_phrases, got[i].reference_words) == (n, phrases, size)
        if n:
            assert abs(got[i].score - (phrases * np.log2(size) - own * np.log2(own)) / n) < 1e-9
    against = crossparse.score_against(table, table.filter("in_reference"))
    found = {r.doc_id: r.n_phrases for r in against.collect()}
    moves = crossparse.suffix_automaton(x for _, t, g in rows if g for x in [*(t or "").split(), None])
    assert found == {i: crossparse.cross_phrases(moves, (t or "").split()) for i, t, _ in rows}


def test_cross_parsing_keeps_only_words_of_long_runs():
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(23))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(100)]
    for i in range(0, 100, 20):
        texts[i] = f"{texts[i]} {passage} tail{i}"
    columns = [range(100), texts, range(100), range(100), [True] * 100]
    batch = pa.RecordBatch.from_pydict(dict(zip(("doc_id", "text", "key", "other", "of_reference"), map(list, columns))))
    known = pa.Table.from_batches(crossparse._pack(iter([batch]), 1 << 30))
    flags = pa.table({"at": range(100), "asks": [True] * 100, "supplies": [True] * 100})
    static = known.column("packed")[0].as_py()
    state = crossparse._first_state(known, flags).column("state")[0].as_py()

    def learn(static, state, *what):  # all rows are in this chunk
        runs = crossparse.Round(static, state, *what)
        return runs.learn(runs.flags() if len(runs.hashes) else np.zeros(0, np.uint8))[0]

    def peak(static, state):
        tracemalloc.start()
        runs = crossparse.Round(static, state, "rise", 8, 4)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, runs.hashes.tolist(), runs.flags().tolist()

    for what in (("rise", 2, 0), ("rise", 3, 2), ("rise", 4, 3)):
        state = learn(static, state, *what)
    small, base, left = crossparse._smaller(static, state)
    most, *sent = peak(static, state)
    less, *sent_less = peak(small, left)
    assert sent == sent_less and len(sent[0]) == 16
    assert less < most / 20
    rest = [("rise", 8, 4), ("rise", 16, 8), ("rise", 32, 16), ("census", 0, 0)]
    for what in rest:
        left = learn(small, left, *what)
    assert crossparse.State(left).bounds[0][:23].tolist() == [*range(23, 3, -1), 0, 0, 0]  # ends where the passage ends
    for what in (("fall", 8, 0), ("fall", 4, 0), ("fall", 2, 0), ("fall", 1, 0)):
        left = learn(small, left, *what)
    lengths = crossparse._whole_lengths(base, left)
    assert lengths[2000:2024].tolist() == [*range(23, 0, -1), 1]
    assert lengths.sum() == len(lengths) + 5 * sum(range(23))


def test_cross_parsing_answers_a_part_in_little_memory():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(1 << 40, 1 << 44, 400_000).astype(np.uint64))
    sent = [(np.sort(rng.choice(pool, n, replace=False)), rng.choice([1, 2, 4, 5, 8, 10], n).astype(np.uint8)) for n in (1, 2, 7, *[40_000] * 40)]
    table = pa.table({"chunk": range(len(sent)), "part": [3] * len(sent), "runs": [crossparse._coded(*x) for x in sent]})
    asking, supplying = Counter(), Counter()
    for hashes, flags in sent:
        for h, f in zip(hashes.tolist(), flags.tolist()):
            asking[h] += f & 3
            supplying[h] += f >> 2
    tracemalloc.start()
    answers = crossparse._answer(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for (hashes, _), got in zip(sent, answers.column("answer").to_pylist()):
        want = bytes(min(asking[h], 2) + 4 * min(supplying[h], 2) for h in hashes.tolist())
        assert zstandard.decompress(got) == want
    assert peak < 3 * sum(h.nbytes for h, _ in sent)


def test_language_held_out_accuracy(spark, nothing):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = found.join(truth, "doc_id").filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 100
    assert languages.identify(nothing).count() == 0


def test_language_scores_are_averages_over_the_grams():
    rng = np.random.default_rng(3)
    buckets = 64
    table = np.vstack([rng.normal(0, 1, (buckets, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = languages.LanguageModel(["a", "b"], table, rng.normal(0, 1, 3), temperature=0.7)
    texts = [b"abc", b"x", "été 12".encode(), b"a b c d " * 50]
    for text, got in zip(texts, languages.probabilities(model, texts)):
        total = np.zeros(3)
        for n in languages.GRAMS:
            for k in range(len(text)):
                h = 0x811C9DC5 + n
                for c in (text[k : k + n] + bytes(n))[:n]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                total += table[h & (buckets - 1)]
        x = (total / (len(languages.GRAMS) * len(text)) + model.bias) / 0.7
        e = np.exp(x - x.max())
        assert np.allclose(got, (e / e.sum())[:2], atol=1e-5)


def test_language_edges(spark, docs, rows):
    got = languages.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 12)} == {"und"}
    kept = languages.keep_recognised(docs)
    assert kept.columns == docs.columns and not {0, 1, 2, 12} & {r.doc_id for r in kept.collect()}


def test_edits_brute_force(docs, rows, nothing):
    counter = edits.Counter.cached(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    letters = "ab c'  \n\n  re1 2é,.'s l'l  "
    for _ in range(800):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        tree = edits.TokenTree(text, counter, run=rng.choice([1, 3, 64]))
        for _ in range(3):
            a = rng.randrange(len(text) + 1)
            b, new = rng.randrange(a, min(len(text), a + 8) + 1), "".join(rng.choices(letters, k=rng.randrange(6)))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert [x for leaf in tree.leaves for x in leaf] == counter.split(text)
            assert tree.tokens == sum(map(counter.count, counter.split(text)))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = lambda t: [(0, 3, "<x>"), (5, 9, "")] if len(t) > 9 else []
    got = edits.edited_counts(docs, path, cut).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        text = texts[r.doc_id] or ""
        after = "<x>" + text[3:5] + text[9:] if len(text) > 9 else text
        assert (r.tokens_before, r.tokens_after) == tuple(sum(map(counter.count, counter.split(t))) for t in (text, after))
        assert r.n_reencoded <= 40 and r.chars_after == len(after)
    assert edits.edited_counts(nothing, path).count() == 0


def test_media_sequences(spark, nothing):
    page = """<p>Before</p><figure><img data-digest="d1" alt="old"><img src="sha256:D2"><figcaption>Both <b>bold</b></figcaption></figure>
    <script>"<img src=x>"</script>After<img src="data:,hi" alt="inline"><figure><figcaption>First</figcaption><img src="sha256:d1"></figure><img src="u.png">"""
    items = media.parse(page)
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        ("text", "Before", None, None), ("image", None, "d1", "Both bold"), ("image", None, "d2", "Both bold"), ("text", "After", None, None),
        ("image", None, hashlib.sha256(b"hi").hexdigest(), "inline"), ("image", None, "d1", "First"), ("image", None, None, None),
    ]
    pages = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "")], "page_id long, html string")
    table = spark.createDataFrame([("d1", bytearray(media.stored(b"abc"))), ("d1", bytearray(media.stored(b"abc"))), ("d3", None)], "digest string, media binary")
    found = media.resolve(media.sequences(pages), media.features(table)).orderBy("page_id", "position").collect()
    assert len(found) == 14 and {r.n_bytes for r in found if r.digest == "d1"} == {3}
    assert all(r.n_bytes is None for r in found if r.digest != "d1")
    assert media.sequences(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_media_of_texts(docs, rows, nothing):
    got = media.text_media(docs).collect()
    assert sorted(Counter(r.doc_id for r in got).items(), key=str) == sorted(Counter(r[0] for r in rows).items(), key=str)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        raw = texts[r.doc_id]
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        whole = media.stored(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(whole), hashlib.sha256(whole).hexdigest())
        assert r.feature == media.describe(padded)
    assert media.text_media(nothing).count() == 0


def test_pieces_equal_the_library(docs, rows, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Vocabulary.cached(path)
    rng = random.Random(3)
    parts = ["a", "the", "in", " ", "  ", "\n", "é", "日", "\t", "▁x", "hello", "ing", ".", "1", "ﬁ", "🙂", "aaaa", "\x00", "\r"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(1500)] + ["", " ", "   ", "\n", "x" * 5000]
    for text, (_, ids) in zip(texts, model.encode(texts)):
        assert memoryview(ids).cast("I").tolist() == model.model.encode(text)
        assert "▁" in text or model.decode(ids) == text
    got = pieces.round_trip(docs, path).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == {r[0]: r[1] for r in rows}
    assert pieces.round_trip(nothing, path).count() == 0


def test_unigram_pieces_have_the_best_sum():
    """The merge vocabulary's pieces under other scores, against all ways to cut a word."""
    model = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    model.merges = False
    model.scores = {p: -rng.choice([1.0, 2.5, 4.0, 7.25]) - len(p) / 4 for p in model.ids}
    model.penalty = min(model.scores.values()) - 10

    def cuts(word):
        if not word:
            yield 0.0, []
        for size in range(1, len(word) + 1):
            piece = word[:size]
            if piece in model.ids:
                score, ids = model.scores[piece], [model.ids[piece]]
            elif size == 1:
                score, ids = model.penalty, [model.bytes[b] for b in piece.encode()]
            else:
                continue
            for rest, more in cuts(word[size:]):
                yield score + rest, ids + more

    by_id = {i: p for p, i in model.ids.items()}
    words = {"".join(rng.choices(["a", "the", "in", "é", "hello", "ing", "🙂", "th", "er", "s", "on"], k=rng.randrange(1, 4)))[:9] for _ in range(300)}
    words |= {w[:k] for w in list(words) for k in range(1, len(w))}
    learned = model.learn(map(pieces.marked, words))
    for word in words:
        ids = memoryview(learned[pieces.marked(word)]).cast("I").tolist()
        ways = list(cuts(pieces.marked(word)))
        top = max(s for s, _ in ways)
        assert any(i == ids and abs(s - top) < 1e-9 for s, i in ways), (word, [by_id.get(i) for i in ids])


def test_redactions_are_those_of_the_plain_patterns_in_linear_time():
    import re
    import time

    mail, number = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), re.compile(r"\d[\d .()-]{5,}\d")

    def plain(text):
        found = [(m.start(), m.end(), "<mail>") for m in mail.finditer(text)]
        taken = list(found)
        for m in number.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _ in taken):
                found.append((m.start(), m.end(), "<number>"))
        return found

    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "@", ".", "b.c", "-", " ", "+", "12", "3 4", "1234567", "é", "@x.y"], k=rng.randrange(16)))
        assert edits.redactions(text) == plain(text), text
    began = time.time()
    edits.redactions("x" * 1_000_000 + "@" + "a@b.c 1234567 " * 50_000)
    assert time.time() - began < 20


CLASHES = ("rank", "_doc", "_hash", "_text", "_id", "ranges", "root", "fp", "digest", "_ranges", "text_hash", "part", "position")


def test_operators_take_clashing_columns_and_long_texts(spark):
    long = "ab" * 1_000_000
    rows = [(1, "one two three " * 20, "en"), (2, long, "en"), (3, None, None), (2, long, "en"), (None, "", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = table.withColumns({c: F.lit("clash") for c in CLASHES})
    pages = table.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), *CLASHES)
    vectors = table.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), *CLASHES)
    path = public_tokenizers.path
    assert crossparse.score(table.withColumn("in_reference", F.lit(True))).count() == 5
    assert languages.identify(table).count() == 5
    assert edits.edited_counts(table, path("byte_bpe_50k.tiktoken")).count() == 5
    assert media.text_media(table).count() == 5
    assert pieces.round_trip(table, path("piece_bpe_32k.model")).count() == 5
    judged = urlrules.judge(pages, urlrules.rule_table(spark, queries.URL_RULES))
    assert set(CLASHES) <= set(judged.columns) and {r.verdict for r in judged.collect()} == {"allow"}
    assert topk.search(vectors, every=1).count() == 8  # of four rows with an id, two share one: three queries
    assert packing.pack(table, path("word_bpe_49k.json")).agg(F.countDistinct("doc_id")).first()[0] == 3
    assert substrings.remove_repeats(table).count() == 5
    assert simhash.near_duplicates(table).count() == 5
    for kept in (languages.keep_recognised(table), simhash.drop_near_duplicates(table), substrings.cut_repeats(table)):
        assert kept.columns == table.columns
        assert {tuple(r[c] for c in CLASHES) for r in kept.collect()} == {("clash",) * len(CLASHES)}


def test_languages_reject_text_of_none_and_keep_clean_text(spark):
    model = languages.fit(languages.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 500))
    assert model.validation["accuracy"] > 0.97 and model.validation["rejected"] < 0.01
    assert model.validation["nonsense_accepted"] < 0.05
    strange = ["данный текст написан кириллицей", "هذا النص مكتوب بالعربية", "这是中文文本", "zqxv kjqz xxqj vvkq qzzj xkcd", "ελληνικό κείμενο"]
    assert (languages.probabilities(model, [t.encode() for t in strange]).max(axis=1) < model.threshold).mean() >= 0.8


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/17?q#f", "http://a.example.org/es/x", "http://badexample.org/es/x", "x://org", "x://org/", "ftp://u.com/de/", "http://u.com/fr/a", "http://u.net/", "a://b://c.com/de/x", "http://例.com/de/é"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        if rest is None:
            return "", "", None, "allow"
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    table = urlrules.rule_table(spark, queries.URL_RULES)
    got = urlrules.judge(pages, table).collect()
    assert len(got) == len(urls) * 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url)
    assert urlrules.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, table.limit(0), "block").collect()} == {"block"}
    many = [*rules, *(("com", "/" + "x" * k, "block") for k in range(1, 700))]
    longer = spark.createDataFrame([(9, "http://www.u.com/" + "x" * 650, "clash"), (10, "http://u.com/fr/", None)], "page_id long, url string, host string")
    found = urlrules.judge(longer, spark.createDataFrame(many, "host string, path string, verdict string")).collect()
    assert {r.page_id: r.rule for r in found} == {9: "com/" + "x" * 650, 10: "com/fr/"}


@pytest.mark.parametrize("broadcast_bytes", [topk.BROADCAST_BYTES, 400])
def test_top_k(spark, broadcast_bytes):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(90)]
    vectors += [(90, None), (91, [1.0, None] * 4), (92, [float("nan")] * 8), (93, [float("inf")] * 8), (100, [1.0, 2.0]), (102, [0.5, 0.5]), (None, [1.0] * 8), (120, [0.0] * 8), (40, vectors[40][1])]
    vectors += [(140, []), (141, []), (160, [1e8] * 8), (161, [2.0**24, -3.0] * 4), (180, [1e300, 1e308]), (181, [1.0, 1e9]), (182, [1.0, -2.0**30])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    known = [(i, tuple(int(x) * 64 if abs(x) > 1e9 else int(np.floor(64 * x)) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({k for k in known if k[0] % 20 == 0}):
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q[1], v)))), i) for i, v in known if i != q[0] and len(v) == len(q[1])]
        scored.sort(key=lambda x: (-x[0], x[1]))
        want += [(q[0], n + 1, i, s) for n, (s, i) in enumerate(scored[:20])]
    got = topk.search(table, broadcast_bytes=broadcast_bytes).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(table.limit(0)).count() == 0


def test_top_k_prunes_by_what_earlier_blocks_have_proven():
    rng = np.random.default_rng(6)
    vectors, ids = np.floor(rng.normal(0, 20, (6000, 64))), np.arange(6000)
    walk = topk.Walk(ids[:100], vectors[:100], 20, 1)
    shares = []
    kept = topk.ImpactIndex
    for a in range(0, 6000, 2000):
        index = kept(ids[a : a + 2000], vectors[a : a + 2000])
        q, v, s = index.search(walk.ids, walk.queries, 20, walk.floor())
        walk._keep(q, index.ids[v], s)
        shares.append(index.scored / index.pairs)
    assert shares[-1] < 0.05
    full = vectors[:100] @ vectors.T
    full[np.arange(100), np.arange(100)] = -np.inf
    q, found, score = walk.found
    for k in range(100):
        order = np.lexsort([ids, -full[k]])[:20]
        assert found[q == k].tolist() == order.tolist() and score[q == k].tolist() == full[k][order].tolist()


@pytest.mark.parametrize("n", range(1, 24))
def test_small_block_without_the_query_gives_all(n):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-50, 50, (n, 6)).astype(np.int32)
    asked = rng.integers(-50, 50, (2, 6)).astype(np.int32)
    q, v, s = topk.ImpactIndex(np.arange(n), vectors).search(np.array([0, 1000]), asked, 20)
    for k, own in enumerate((0, 1000)):
        want = sorted((-int(asked[k] @ vectors[i]), i) for i in range(n) if i != own)[:20]
        assert list(zip((-s[q == k]).tolist(), v[q == k].tolist())) == want


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 20, (10, 32))
    vectors = np.floor(centres[rng.integers(0, 10, 4000)] + rng.normal(0, 3, (4000, 32))).astype(np.int32)
    index = topk.ImpactIndex(np.arange(4000), vectors)
    q, v, s = index.search(np.arange(0, 100), vectors[:100], 20)
    full = vectors[:100].astype(np.int64) @ vectors.T.astype(np.int64)
    full[np.arange(100), np.arange(100)] = -(1 << 60)
    for k in range(100):
        order = np.lexsort([np.arange(4000), -full[k]])[:20]
        assert v[q == k].tolist() == order.tolist() and s[q == k].tolist() == full[k][order].tolist()


def test_packing_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = packing.pack(docs, path).collect()
    copies, covered, sequences = Counter(r[0] for r in rows), Counter(), {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: n * len(ids[d]) for d, n in copies.items()}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(covered.values()) + 2048
    assert packing.pack(nothing, path).count() == 0


def brute_removed(rows, length=13):
    texts = [(1 << 62 if d is None else d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, words in texts:
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, words), row in zip(texts, rows):
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((str(row[0]), len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket_bytes", [substrings.BUCKET_BYTES, 4000, 400])
def test_substrings_brute_force(docs, rows, nothing, bucket_bytes, monkeypatch):
    # 4000 and 400: hot minimisers of one and both levels too
    monkeypatch.setattr(substrings.repeated_windows, "__defaults__", (13, substrings.RUNS, bucket_bytes))
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("k")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.k) for r in got) == brute_removed(rows)
    assert substrings.remove_repeats(nothing).count() == 0
    kept = substrings.cut_repeats(docs)
    assert kept.columns == docs.columns
    assert {8, 10} & {r.doc_id for r in kept.collect()} == {10}  # 8 is a copy of 5, 10 differs in case


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(len(ids)):
            if i != j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                near[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return near, [least.get(find(i)) for i in range(len(ids))]


def test_simhash_brute_force(docs, rows, nothing):
    fps = [brute_fingerprint(r[1]) for r in rows]
    near, least = components([r[0] for r in rows], fps)
    want = sorted((str(r[0]), f, n, c) for r, f, n, c in zip(rows, fps, near, least))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.n_near, r.component_id) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


def test_simhash_links_of_random_fingerprints(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    for crowded in (2000, 1):
        assert {tuple(r) for r in simhash.links(frame, 2, crowded).collect()} == want


def test_near_dedup_broadcasts_nothing_that_grows_with_the_data(spark, docs, monkeypatch):
    plans = []

    def noted(frame, label):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return shared.materialise(frame, label)

    for module in (simhash, module_of_components):
        monkeypatch.setattr(module, "materialise", noted)
    for frame in (simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs)):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def test_golay_decoding_shares_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for bit in range(23):
        a, b = simhash.codeword_indices(words), simhash.codeword_indices(words ^ (1 << bit))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))
