"""Kept columns against a plain fold over all columns."""

import random

from reportloom.operators import tables


def plain(rows):
    kept = []
    for j in range(len(rows[0])):
        column = [r[j] for r in rows]
        if not any(column):
            continue
        if kept:
            last = [r[kept[-1]] for r in rows]
            either = sum(1 for x, y in zip(last, column, strict=True) if x or y)
            same = sum(1 for x, y in zip(last, column, strict=True) if x and x == y)
            if same >= 0.9 * either:
                continue
        kept.append(j)
    return kept


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for b in range(40):
        width, bases = rng.choice([1, 2, 5, 31, 70]), [[rng.choice("abc") for _ in range(12)] for _ in range(4)]
        columns = []
        for _ in range(width):
            base = list(rng.choice([*bases, columns[-1] if columns else bases[0], [""] * 12]))
            for _ in range(rng.choice([0, 0, 1, 2])):
                base[rng.randrange(12)] = rng.choice(["x", ""])
            columns.append(base)
        block = [list(r) for r in zip(*columns, strict=True)]
        want["d", b] = plain(block)
        rows += [("d", b, k, r) for k, r in enumerate(block)]
    frame = spark.createDataFrame(rows, "doc_id string, block_no int, row_no int, cells array<string>")
    assert {(r.doc_id, r.block_no): r.columns for r in tables.column_selection(frame).collect()} == want
