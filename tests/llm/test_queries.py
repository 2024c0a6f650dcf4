"""The registered queries against their SQL, and the pipeline stage by stage."""

import hashlib

import duckdb
import pytest
from test_brute_force import brute_fingerprint, brute_removed, components
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import queries
from quire.llm.shared import read_table, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    frame = queries.queries()[name](spark, SF).select(*names)
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on what the stage before kept."""
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k == 0:
            now = {r.doc_id: r for r in rows}
            lettered = {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
            assert set(now) <= lettered and len(now) >= 0.99 * len(lettered)
            assert all(now[i].text == before[i].text for i in now)
        elif k == 1:
            now = {r.doc_id: r for r in rows}
            ids = sorted(before)
            _, least = components(ids, [brute_fingerprint(before[i].text) for i in ids])
            assert set(now) == set(least)
        elif k == 2:
            now = {r.doc_id: r for r in rows}
            removed = {r[0]: r for r in brute_removed([(i, r.text) for i, r in before.items()])}
            for i, r in before.items():
                _, words, gone, digest = removed[str(i)]
                if gone == words > 0:
                    assert i not in now
                elif gone:
                    assert hashlib.sha256(now[i].text.encode()).hexdigest() == digest and now[i].n_chars == len(now[i].text)
                else:
                    assert now[i] == r
        else:
            tokens = {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in before.items()}
            found = {}
            for r in rows:
                found[r.doc_id] = found.get(r.doc_id, 0) + r.length
            assert found == tokens
            now = {i: None for i in found}
        assert len(rows) == len(now) if k < 3 else rows
        if k < 3:
            assert docs.columns == columns
        before = now
    total = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in total.select("doc_id").collect()} == set(before)
