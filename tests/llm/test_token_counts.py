import random

import public_tokenizers
import pytest
import sentencepiece

from reportloom.llm.token_counts import Transducer, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_agrees_with_the_library_on_odd_texts(library):
    rng = random.Random(7)
    parts = ["a", "e", "the", "ing", "<s>", "</s>", "<unk>", "<0x0A>", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "▁▁", "\0", "\xa0"]
    pieces = [library.id_to_piece(i) for i in rng.sample(range(300, 32000), 400)]
    texts = ["", " ", "▁", "x" * 5000, "日" * 3000, " " * 100]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    want = [len(ids) for ids in library.encode(texts, num_threads=1)]
    assert Transducer(MODEL).counts(texts).tolist() == want


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, None, 1), (2, "", 1), (3, "word " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(token_counts(docs, MODEL).collect(), key=str)
    want = sorted(
        ((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in rows), key=str
    )
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(docs, MODEL).count() == 0
