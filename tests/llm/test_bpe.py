import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from scriptorium.llm import bpe
from tests.llm.helpers import ODD, SCHEMA, documents


@pytest.fixture(scope="module")
def known():
    return bpe.Vocabulary(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def reference(known):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(spark, reference):
    random.seed(7)
    signs = "ab XYZ\n\t\x1c\x85\xa0é²¼ßſ日本𝔘12'sll't!?.,_-\u2003\u3000<|endoftext|>"
    texts = [*ODD, "<|endoftext|>", "!" * 3000, *("".join(random.choices(signs, k=random.randint(0, 200))) for _ in range(200))]
    got = bpe.digests(bpe.decode(bpe.encode(documents(spark, texts).select("doc_id", "text")))).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == len(texts)


def test_long_pieces_merge_alike_either_way(known, monkeypatch):
    pieces = [bytes(random.Random(i).choices(b"abcdeth ", k=60)) for i in range(50)]
    matrix = [x.tolist() for x in known.encode_pieces(pieces)]
    monkeypatch.setattr(bpe, "MATRIX_WIDTH", 3)
    assert [x.tolist() for x in known.encode_pieces(pieces)] == matrix


def test_forgetting_changes_nothing(known, monkeypatch, reference):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    encoder = bpe.Encoder(known, public_tokenizers.PATTERN)
    for text in ("one two three", "three four five six", "one two seven"):
        ids, counts = encoder.encode([text, ""])
        assert ids.tolist() == reference.encode_ordinary(text) and counts.tolist() == [len(ids), 0]


def test_other_columns_stay(spark):
    df = documents(spark, ["a b", None], extra=True)
    got = bpe.encode(df)
    assert set(got.columns) == set(df.columns) - {"text"} and [len(r["ids"]) for r in got.orderBy("doc_id").collect()] == [2, 0]


def test_decoding_in_one_pass_equals_decode(spark):
    df = documents(spark, ODD, extra=True)
    two = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    one = bpe.encode(df, bytes_column="decoded").orderBy("doc_id").collect()
    assert [(r["ids"], r["decoded"]) for r in one] == [(r["ids"], r["decoded"]) for r in two]


def test_empty_table(spark):
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA)))).count() == 0
