import os
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reportloom.llm import quality_rules as qr
from reportloom.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), min_size=1, max_size=4))
def test_longest_repeats_against_brute_force(texts):
    text_of = np.array([t for t, ws in enumerate(texts) for _ in ws], dtype=np.int64)
    word = np.array([w for ws in texts for w in ws], dtype=np.int64)
    assert qr.longest_repeats(text_of, word).tolist() == [x for ws in texts for x in brute(ws)]


def plain(text, least=10):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    longest = brute(words)
    cover = {i + k for i, m in enumerate(longest) if m >= least for k in range(m)}
    failed = len(words) < 50 or 100 * len(twice) > 50 * len(words)
    kept = not failed and not (len(cover) > 0.3 * len(words) or max(longest, default=0) > 50)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(twice), len(cover), max(longest, default=0), failed, kept)


def test_rows_against_a_plain_reading(spark):
    rng = random.Random(6)
    pool = [f"w{k}" for k in range(60)] + ["#x|", "é\x0b", "a<b>", "日本\xa0"]
    texts = [None, "", " \n\t ", "a " * 60, "one\n\none\n one\none"]
    for _ in range(40):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice(["\n", " ", "\r\n"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9))))
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[7], "y"), (5, texts[5], "x")]
    got = qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    by = {r.doc_id: tuple(r)[1:-1] for r in got}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        assert by[k] == plain(t), (k, t)
    for r in got:
        assert sum(s.last_word - s.first_word + 1 for s in r.spans) == r.covered_words


def test_very_long_text_and_empty_table(spark):
    words = [f"u{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:30_000] * 2))]
    got = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].longest_repeat == 0
    assert not got[2].kept and got[2].longest_repeat == 30_000 and got[2].covered_words == 60_000
    assert qr.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_repetition_is_rejected_by_the_method_alone(spark):
    """Real documents into which a passage or short lines are planted again: the base passes them, the suffix array does not."""
    docs = table(spark, SF, "documents")
    clean = [r for r in qr.quality_rules(docs).collect() if r.kept and 300 <= r.n_words <= 600][:60]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = []
    for r in clean:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        rows.append((r.doc_id, texts[r.doc_id]))
        rows.append((10_000 + r.doc_id, " ".join(words + words[40:100])))  # one passage of 60 words again
        rows.append((20_000 + r.doc_id, " ".join([w for k in range(0, 70, 10) for w in words[k : k + 10] + words[100 + k : 110 + k] + words[k : k + 10]] + words[170:300])))
    got = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(clean) > 30 and all(got[r.doc_id].kept for r in clean)
    planted = [r for i, r in got.items() if i >= 10_000 and not r.base_failed]
    assert len(planted) > 1.5 * len(clean) and not any(r.kept for r in planted)
