"""The pipeline against a brute-force version, and every operator query on the smallest tables."""

import numpy as np
import tiktoken
import public_tokenizers
import pytest

import corpus_pipeline
from scriptorium.llm import bpe, catalogue, mixing
from tests.llm.helpers import ODD, documents
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import slow_schedule
from tests.llm.test_secrets import base_spans

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_runs_on_whole_tables(spark, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r["doc_id"] for r in catalogue.QUERIES["op9_divergence_rules"](spark, SF_DIR).where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    first = {d for d, n, c in components(rows, 5, 80) if not n or c == d}
    texts = {}
    for d, text in rows:
        if d in first:
            end, out = 0, ""
            for start, stop in sorted(tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s):
                if start >= end:
                    out += text[end:start] + "[secret]"
                end = max(end, stop)
            texts[d] = out + text[end:]
    known = bpe.Vocabulary(bpe.read_vocabulary())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {d: reference.encode_ordinary(t) for d, t in texts.items()}
    assert all(r["round_trip"] for r in got) and len(got) == len(texts)
    # The mixture: positions without gaps, in the order of a schedule that is made slot by slot.
    by_place = [r["source"] for r in sorted(got, key=lambda r: r["position"])]
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    left = {s: by_place.count(s) for s in set(by_place)}
    own = mixing.whole_weights({f"={s}": n**mixing.TEMPERATURE for s, n in left.items()}, mixing.GRAIN)
    order, at = slow_schedule({f"={s}": n for s, n in left.items()}, own, mixing.BLOCK), 0
    for key in order:
        block = by_place[at : at + min(mixing.BLOCK, left[key[1:]])]
        assert set(block) == {key[1:]}
        at, left[key[1:]] = at + len(block), left[key[1:]] - len(block)


def prose(n, salt):
    """4 n different words of letters."""
    return " ".join("".join(chr(97 + (i * salt + k) // 26**k % 26) for k in range(3)) + chr(97 + salt) * (i % 5) for i in range(4 * n))


def test_odd_inputs_run_through_all_stages(spark, tmp_path):
    good = [prose(30, 3), prose(30, 3), prose(40, 5) + " password = abcdefgh12", prose(40, 5) + " password = abcdefgh12 more", "x" * 300_000 + " " + prose(60, 7)]
    texts = [*ODD, *good, (50, prose(35, 11)), (50, prose(35, 11)), (None, prose(35, 13)), (None, prose(35, 13)), (51, prose(20, 17) + " 日本語 𝔘")]
    documents(spark, texts, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in got) and sorted(r["position"] for r in got) == list(range(len(got)))
    kept = [r["doc_id"] for r in got]
    assert kept.count(50) == 1 and kept.count(None) == 1 and len(set(kept)) == len(kept) and len(ODD) in kept and len(ODD) + 1 not in kept
    known = bpe.Vocabulary(bpe.read_vocabulary())
    texts_out = {r["doc_id"]: known.decode(np.array(r["ids"]))[0].tobytes().decode() for r in got}
    assert "abcdefgh12" not in "".join(texts_out.values()) and "[secret]" in texts_out[len(ODD) + 2]


def test_an_empty_table_runs_through_all_stages(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF_DIR)
        assert docs.columns == DOCUMENTS
