import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from reportloom.llm import exact_dedup as ed
from reportloom.llm.exact_dedup import exact_dedup


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, texts, strict=True):
        groups[t].append(i)
    out, taken = [], set()
    for (i, *_), t in zip(rows, texts, strict=True):
        keep = min((x for x in groups[t] if x is not None), default=None)
        kept = i == keep and t not in taken
        taken |= {t} if kept else set()
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(map(tuple, exact_dedup(df, **how).collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part int, uid string, sha string, chunk string")


def rows_of(seed):
    rng = random.Random(seed)
    pool = ["a b", "a  b", " a b", "a\tb", "a\n\x0b b", "é ß", "é ß", "", " ", "\n", "x" * 70, "x" * 71, "ab" * 40, "ab" * 40 + " ", "𝒳" * 40]
    rows = [(rng.choice([None, *range(40)]), rng.choice([*pool, None]), 1, "u", "s", "c") for _ in range(120)]
    return rows + [(None, "only null ids", 1, "u", "s", "c")] * 3 + [(7, "same row", 1, "u", "s", "c")] * 3


@pytest.mark.parametrize("chunk", [1, 7, 1 << 15])
def test_against_brute_force(spark, chunk):
    """Null, empty and repeated rows, ties, null ids and clashing column names, whatever the chunks."""
    rows = rows_of(chunk)
    assert got(made(spark, rows), chunk=chunk) == brute(rows)


@pytest.mark.parametrize("primes", [(2, 3), (1, 1)])
def test_colliding_fingerprints_are_told_apart(spark, primes):
    rows = [(k, t, *rest) for k, (_, t, *rest) in enumerate(rows_of(3))] + [(500 + k, f"{k % 9:02d}" * 5, 1, "u", "s", "c") for k in range(60)]
    assert got(made(spark, rows), chunk=4, primes=primes) == brute(rows)


def test_long_text_and_empty_table(spark):
    long = " ".join(str(k) for k in range(200_000))
    rows = [(3, long, 1, "u", "s", "c"), (2, long.replace(" ", "\n"), 1, "u", "s", "c"), (1, long[:-1] + "x", 1, "u", "s", "c")]
    df = made(spark, rows)
    assert got(df) == brute(rows)
    assert got(df.where("false")) == []


def test_fingerprints_do_not_depend_on_the_cuts():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(5_000))
    want = [0, 0]
    for byte in text:
        want = [(h * b + byte + 1) % p for h, b, p in zip(want, ed.PLACES, ed.PRIMES, strict=True)]
    for n in (1, 3, 40, 4_000):
        ends = np.array(sorted([*rng.choices(range(len(text) + 1), k=n), len(text)]))
        h0, s0, h1, s1 = ed.chunk_hashes(np.frombuffer(text, dtype=np.uint8), ends, ed.PRIMES, ed.PLACES)
        whole = [0, 0]
        for k in range(len(ends)):
            whole = [(whole[0] * int(s0[k]) + int(h0[k])) % ed.PRIMES[0], (whole[1] * int(s1[k]) + int(h1[k])) % ed.PRIMES[1]]
        assert whole == want


def test_hot_group_is_summed_before_the_shuffle(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}", 1, "u", "s", "c") for k in range(3_000)]
    assert got(made(spark, rows).repartition(16)) == brute(rows)
