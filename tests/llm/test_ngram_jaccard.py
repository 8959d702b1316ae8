import random
import re

import pytest

from reportloom.llm.ngram_jaccard import ngram_jaccard


def brute(rows, k=5, percent=75):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * (len(x) + len(y) - both):
                r, q = root(rows[a][0]), root(rows[b][0])
                parent[max(r, q)] = min(r, q)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(pool) for _ in range(30))
    texts = []
    for _ in range(14):
        base = [rng.choice(pool) for _ in range(rng.choice([1, 4, 5, 6, 8, 20, 60, 150]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(pool)
            t = " ".join(w)
            texts.append(rng.choice([t, t.upper(), t.replace(" ", "\n"), t, t + " " + passage, "  " + t + "\t"]))
    texts += [None, "", " \n", "É a b c d", "é a b c d", "x " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (3, texts[3])] + [(None, texts[1]), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, node int")
    assert sorted(map(tuple, ngram_jaccard(df).collect()), key=str) == brute(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(60)]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {r[2] for r in brute(rows)} == {0}


def test_empty_table(spark):
    assert ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
