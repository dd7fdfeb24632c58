"""Registered queries on the driver tables: against SQL where there is some, else against the rules in plain Python."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from eventscope.llm import queries as registered
from eventscope.llm.common import scratch

from . import brute
from ..oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in registered.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ok, message = compare(spark, con, name, registered.queries()[name], registered.oracle_sql()[name], SF)
    assert ok, message


def test_token_counts(spark, tokenizer):
    edits = {r.doc_id: r.e for r in registered.read(spark, SF, "documents").select("doc_id", registered.edit_log().alias("e")).collect()}
    got = {r["doc_id"]: r for r in rows(spark, "op1_token_counts")}
    for d in table("documents"):
        text = d["text"] or ""
        for e in edits[d["doc_id"]]:
            text = text[: e.pos] + e.ins + text[min(e.pos + e["del"], len(text)) :]
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens_edited"], r["edited_sha256"]) == (len(tokenizer.encode(text, add_special_tokens=False).ids), sha(text))


def test_line_dedup(spark):
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    gone = brute.later_lines([(i, t) for i, t in docs if t is not None], 50)
    got = {r["doc_id"]: r["removed_lines"] for r in rows(spark, "op2_line_dedup")}
    assert got == {i: len(gone[i]) for i, _ in docs}


def test_decontamination(spark):
    items = [(str(x["item_id"]), x["text"]) for x in table("benchmark")]
    got = {r["doc_id"]: r for r in rows(spark, "op3_benchmark_decontamination")}
    assert any(r["contaminated"] for r in got.values())
    for d in table("documents"):
        words, hit, names = brute.benchmark_hits(d["text"], items, 10)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (words, hit, len(names), sha(",".join(names)), hit > 0)


def test_toxicity(spark):
    toxic = {x["doc_id"]: x["toxic"] for x in table("labels")}
    got = rows(spark, "op4_toxicity")
    assert len(got) == len(table("documents"))
    clean = [r for r in got if toxic.get(r["doc_id"]) == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_of_held_out_rows_on_a_larger_table(spark):
    """Rows whose labels were not learned from: most toxic ones are found, and what is found is toxic."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    toxic = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = [r for r in registered.queries()["op4_toxicity"](spark, folder).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    bad, found = sum(toxic[r.doc_id] for r in got), sum(r.predicted for r in got)
    right = sum(r.predicted and toxic[r.doc_id] for r in got)
    assert bad > 50 and right >= 0.8 * bad and right >= 0.95 * found


def test_bpe(spark, tokenizer):
    got = {r["doc_id"]: r for r in rows(spark, "op6_bpe_round_trip")}
    for d in table("documents"):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(back))


def test_minhash(spark):
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op7_minhash_dedup")}
    assert got == brute.near_components(docs, 2)


def test_pii(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op8_pii")}
    terms = brute.disclosing_terms([d["text"] for d in table("documents")])
    for d, found in zip(table("documents"), terms, strict=True):
        assert [x for x in got[d["doc_id"]]["spans"].split(",") if x.startswith("term")] == [f"term:{s}:{e}" for s, e in found]
        spans = brute.pii_spans(d["text"])
        r = got[d["doc_id"]]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in spans) for k in ("email", "ip", "card", "phone")]


def test_embeddings(spark):
    vectors = [(x["vec_id"], x["embedding"]) for x in table("embeddings")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(spark, "op5_embedding_dedup")}
    assert got == brute.vector_links(vectors)


def test_pipeline_stages(spark, tokenizer):
    docs = registered.read(spark, SF, "documents")
    with scratch(spark) as store:
        for name, stage in corpus_pipeline.STAGES:
            before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            docs = store(stage(spark, docs, SF))
            if name == "bpe":
                break
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect() if name in ("line_dedup", "decontamination"))
            if name == "toxicity":
                judged = {r["doc_id"]: r["score"] for r in rows(spark, "op4_toxicity")}
                assert after == {i: t for i, t in before.items() if judged[i] < 0.5} and len(after) < len(before)
            elif name == "line_dedup":
                gone = brute.later_lines(sorted(before.items()), 50)
                left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
                assert after == {i: t for i, t in left.items() if len(gone[i]) < before[i].count("\n") + 1}
            elif name == "near_dedup":
                assert after == {i: before[i] for i, (_, c) in brute.near_components(sorted(before.items()), 5).items() if i == c}
            else:
                items = [(str(x["item_id"]), x["text"]) for x in table("benchmark")]
                hits = {i: brute.benchmark_hits(t, items, 10) for i, t in before.items()}
                assert set(after) == {i for i, (n, hit, _) in hits.items() if not hit or hit < n}
                assert all(after[i] == before[i] for i in after if not hits[i][1])
                assert all(len(brute.WORD.findall(after[i].translate(brute.LOWER))) == hits[i][0] - hits[i][1] for i in after)
        last = {r.doc_id: r for r in docs.collect()}
        assert set(last) == set(before) and all(r.round_trip for r in last.values())
        for i, text in before.items():
            assert last[i].ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < len(table("documents"))
