import math
import random
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from reportloom.llm import toxicity as tx


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1.5, 4.0, 0.5, -2.5]), max_size=25))
def test_segments_against_the_definition(scores):
    """Maximal segments: recursively take the best-scoring segment, then both sides."""
    signed = [s if s else -1.0 for s in scores]

    def brute(a, b):
        best = max(((sum(signed[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*brute(a, i), (i, j - 1, best[0]), *brute(j, b)]

    got = tx.maximal_segments(signed)
    assert sum(s for *_, s in got) == sum(s for *_, s in brute(0, len(signed)))
    assert max((s for *_, s in got), default=0) == max((s for *_, s in brute(0, len(signed))), default=0)


def test_many_separate_hits_take_linear_time():
    began = time.process_time()
    for scores in ([1.0, -9.0] * 160_000, [1.0, -0.5] * 160_000, [x for k in range(400) for x in [-1.0] * k + [0.5] * k]):
        found = tx.maximal_segments(scores)
        assert sum(s for *_, s in found) > 0
    assert time.process_time() - began < 4


def test_model_by_hand():
    """Scores, extreme-value calibration and evidence against the formulas."""
    model = tx.Model(lexicon={"bad": 3.0, "good": -1.5, "badly": 1.0}, cost=1.0)
    assert model.scores("Bad day, badly good") == [3.0, -1.0, 1.0, -2.5]
    by_score = {-1.0: 90, -2.5: 5, 3.0: 5}
    tx.calibrate(model, [(3.0, 50), (0.0, 50), (6.0, 100)], by_score)
    assert abs(sum(n / 100 * math.exp(model.decay * s) for s, n in by_score.items()) - 1) < 1e-6
    assert abs(model.scale - 3 / (50 * math.exp(-3 * model.decay) + 50 + 100 * math.exp(-6 * model.decay))) < 1e-9
    kept, evidence = model.read("bad " * 30)
    assert [(a, b) for a, b, *_ in kept] == [(0, 29)] and abs(evidence - (model.decay * 90 - math.log(model.scale * 30))) < 1e-9
    assert model.read("day " * 30) == ([], 0) and model.read("") == ([], 0)


def corpus(n=600):
    rng = random.Random(4)
    syllables = ["an", "ter", "lo", "mi", "ka", "res", "to"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = int(k % 6 == 0)
        if toxic:
            for _ in range(4):
                words.insert(len(words) // 2, rng.choice(["grobian", "nitwit", "oaf", "dunce"]))
        docs.append((k, " ".join(words), "toxic" if toxic else "x"))
        labels.append((k, toxic))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    docs, labels = corpus()
    docs += [(None, "nitwit oaf dunce grobian oaf", "a"), (9000, None, "a"), (9001, "", "a"), (9002, "an " * 30_000, "a"), docs[5]]
    labels += [(None, 1), (9000, 1), (3, None), (123456, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and by_id[9000].predicted == by_id[9001].predicted == by_id[9002].predicted == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert tx.toxicity(docs, model).collect()[0].score < 0.5
    assert tx.toxicity(docs.where("false"), model).count() == 0
