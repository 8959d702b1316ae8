import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from reportloom.llm import periodic_runs as pr
from reportloom.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plain_runs(words):
    """Every stretch of some period, by walking; the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def plain(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    rs = plain_runs(words)
    gone = {k for s, n, p in rs for k in range(s + p, s + n)}
    top = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(rs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in rs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


@pytest.mark.parametrize("seed", range(40))
def test_extensions_against_comparison(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([0, 1, 2, 7, 40, 150]))] for _ in range(6)]
    texts += [[0, 1] * 30, [0] * 50, ([0] * rng.randrange(1, 9) + [1]) * 9]
    row, wall, spans = [], [], []
    for t, x in enumerate(texts):
        row += [100 + t, *x]
        wall += [True] + [False] * len(x)
        spans.append((len(row) - len(x), len(row)))
    row, wall = np.array([*row, 200]), np.array([*wall, True])
    levels = pr.grammar(row, wall)
    back, n = [x.mirrored() for x in levels], len(row)
    for k, level in enumerate(levels):  # the grammar spells the texts
        assert level.words.sum() == n and (k == 0 or len(level.symbol) == len(levels[k - 1].first) - 1)
    asked = [(i, j) for a, b in spans for i in range(a, b) for j in range(a, b) if i != j]
    i, j = map(np.array, zip(*rng.sample(asked, min(600, len(asked))), strict=True))

    def forth(a, b):
        k = 0
        while not wall[a + k] and not wall[b + k] and row[a + k] == row[b + k]:
            k += 1
        return k

    def backward(a, b):
        k = 0
        while not wall[a - 1 - k] and not wall[b - 1 - k] and row[a - 1 - k] == row[b - 1 - k]:
            k += 1
        return k

    assert pr.extensions(levels, i, j).tolist() == [forth(a, b) for a, b in zip(i, j, strict=True)]
    assert pr.extensions(back, n - i, n - j).tolist() == [backward(a, b) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("seed", range(30))
def test_runs_against_walking(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(pr, "SLICE", rng.choice([8, 64, 1 << 20]))
    texts = []
    for _ in range(12):
        t = []
        for _ in range(rng.randrange(6)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
            t += (unit * rng.randrange(1, 9))[: rng.randrange(1, 90)]
        texts.append(t)
    flat, of = np.array([x for t in texts for x in t], dtype=np.int64), np.repeat(np.arange(12), [len(t) for t in texts])
    got = list(zip(*(x.tolist() for x in pr.runs(flat, of, 12)), strict=True))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_rows(spark):
    """Nulls, empty texts, odd spaces, repeated rows, clashing columns, an empty table and a very long run."""
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a " * 6, "a " * 5, "a\x0bb\x1ca b " * 4, "x " * 4_000, "é ß " * 9 + "é", "a a a a b " * 5]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(rng.choice([None, k]), t, "x", 1) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = pr.periodic_runs(df, reorder=pr.planted).drop("n_words", "runs", "collapsed")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(i, t) for i, t, *_ in rows), key=str)
    one = pr.periodic_runs(df.where("text = 'a a a a b a a a a b a a a a b a a a a b a a a a b '").limit(1)).first()
    assert (one.collapsed, [tuple(r) for r in one.runs]) == ("a a a a b", [(0, 25, 5)])
    assert pr.periodic_runs(df.where("false")).count() == 0


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    short = {i: t for i, t in docs if len(t or "") < 8_000}
    got = {r[0]: tuple(r) for r in pr.query(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 20
    assert all(got[i] == plain(i, t) for i, t in short.items())
