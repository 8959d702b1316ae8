import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reportloom.llm.best_fit_packing import Encoder, best_fit_pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_agrees_with_the_library(library):
    rng, encode = random.Random(3), Encoder(PATH)
    quick = Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    parts = ["the", "a", "ing", " ", " ", "  ", "\n", " \n", "\t", "é", "日本", "😀", "<|endoftext|>", "'s", "12", "\x1c", "\x85", "\xa0", " ", "!", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want, repr(text)
        assert np.frombuffer(quick(text), "<u4").tolist() == want, repr(text)
    for code in range(0x250):  # every character of the quick path, inside and at the edges of words
        text = f"{chr(code)}a{chr(code)}1 x{chr(code)}{chr(code)} 's{chr(code)}'ll{chr(code)} {chr(code)}z"
        assert quick(text) == encode(text), code


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plans_use_every_piece_once_and_fit(lengths):
    patterns = plan(Counter(lengths), 32)
    assert all(sum(p) <= 32 and n > 0 for p, n in patterns)
    used = Counter()
    for p, n in patterns:
        for v in p:
            used[v] += n
    assert used == Counter(lengths)
    best = -(-sum(lengths) // 32)
    assert sum(n for _, n in patterns) <= 1.5 * best + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_are_no_worse_than_best_fit_decreasing(lengths):
    gaps: list[int] = []
    for v in sorted(lengths, reverse=True):
        at = min((k for k, g in enumerate(gaps) if g >= v), key=lambda k: gaps[k], default=None)
        if at is None:
            gaps.append(64 - v)
        else:
            gaps[at] -= v
    assert sum(n for _, n in plan(Counter(lengths), 64)) <= len(gaps)


def test_exact_complements_are_filled():
    assert sum(n for _, n in plan({1024: 5, 600: 7, 424: 7, 500: 3, 300: 3, 224: 3, 400: 2, 200: 4, 224 + 0: 3}, 1024)) == 17


def test_packing_round_trip(spark, library):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "of", "ünï"]) for _ in range(rng.choice([0, 3, 40, 400, 3000]))), 1) for k in range(60)]
    rows += [rows[3], (None, None, 1), (100, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = best_fit_pack(docs, PATH, 2).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t, _ in rows}
    assert sum(r.length for r in got) == sum(len(ids[k]) for k, _, _ in rows)
    sequences = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / 1024 + 2


def test_empty_table(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
