"""Best-fit packing by exact-complement hashing.

Sequences are planned on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are. A plan is a list of
patterns (lengths that share a sequence) with the number of sequences of each.
Single lengths, pair sums and triple sums that equal a sequence's remaining gap
are looked up in the table of available lengths and consumed as often as the
counts allow; what is left goes best-fit, longest first. Exact fills that spend the
small pieces early can leave a rest that nothing fills, so plans that look up fewer
pieces, or look them up when the longest piece is due, are made too and the one with
the fewest sequences is taken. Pieces then find their
place from their rank among the pieces of the same length, without meeting the
other pieces of their sequence.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.llm.common import durable, ship, table

#: Entries of a worker's memo of chunk encodings; a full memo is emptied and refilled.
MEMO = 200_000
#: The first character beyond the Latin blocks whose letter classes are settled.
LATIN_END = "\u0250"
#: A space that does not stand alone between two other characters.
_UNEVEN = re.compile(r"\s | \s|^ | $")


class Encoder:
    """Token ids of whole texts by a byte-level BPE of the tokenizers library.

    Its pre-tokenizer always cuts before a lone space that follows a character
    other than white space, so texts fall into chunks there and each distinct
    chunk is encoded once. Texts with other spacing, or with a special string,
    are encoded whole. With ``ranks``, the same vocabulary as a rank file, chunks
    in Latin letters go through the faster tiktoken library, whose ids are equal;
    anything else stays with tokenizers, so that no two versions of Unicode's
    letter classes can disagree.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str = ""):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.quick = None
        if ranks:
            from tiktoken import Encoding

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            self.quick = Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        #: Bytes of text behind each id: a byte-level piece writes each byte as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece)
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.

        The chunks that the memo lacks are encoded as one text behind the first
        chunk and told apart by their widths in bytes.
        """
        if not text:
            return b""
        if _UNEVEN.search(text) or any(s in text for s in self.special):
            return self._ids(text).tobytes()
        first, *rest = text.split(" ")
        found = list(map(self.memo.get, rest))
        missing = list({c for c, f in zip(rest, found, strict=True) if f is None}) if None in found else []
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = list({*rest})
        fresh = [first, *(" " + c for c in missing)]
        joined = "".join(fresh)
        if self.quick and max(joined) < LATIN_END:
            ids = np.array(self.quick.encode_ordinary(joined), dtype="<u4")
        else:
            ids = self._ids(joined)
        ends = np.cumsum([len(c.encode()) for c in fresh])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.memo.update((c, raw[a:b]) for c, a, b in zip(missing, cuts, cuts[1:], strict=False))
        return raw[: cuts[0]] + b"".join(map(self.memo.__getitem__, rest) if missing else found)


def encoder(*files: str | None) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if files not in kept:
        kept[files] = Encoder(*files)
    return kept[files]


def pieces(docs: DataFrame, vocabulary: tuple, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Encoded documents, each ended by ``end_id``, cut where they exceed ``capacity``.

    Only the first piece of a cut document may be shorter than ``capacity``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(*vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


Patterns = list[tuple[tuple[int, ...], int]]


class Stock:
    """Lengths that are left, with their counts, and the patterns that took the others."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in histogram.items():
            self.left[length] = count
        self.patterns: Patterns = []

    def times(self, pattern: tuple[int, ...]) -> int:
        """How many sequences of this pattern the counts allow."""
        return int(min(self.left[v] // k for v, k in Counter(pattern).items()))

    def consume(self, pattern: tuple[int, ...], times: int) -> None:
        for v in pattern:
            self.left[v] -= times
        self.patterns.append((pattern, times))

    def complements(self, held: tuple[int, ...], gap: int, most: int):
        """Patterns of up to ``most`` more pieces that fill a gap exactly, fewest and longest pieces first."""
        left = self.left
        if most >= 1 and left[gap]:
            yield (*held, gap)
        if most >= 2:
            low = np.arange(1, gap // 2 + 1)
            for c in low[(left[low] > 0) & (left[gap - low] > 0)][::-1].tolist():
                yield (*held, gap - c, c)
        if most >= 3:
            for b in range(gap - 2, -(-gap // 3) - 1, -1):
                if left[b]:
                    low = np.arange(max(1, gap - b - b), (gap - b) // 2 + 1)
                    for d in low[(left[low] > 0) & (left[gap - b - low] > 0)][::-1].tolist():
                        yield (*held, b, gap - b - d, d)

    def fill(self, held: tuple[int, ...], most: int) -> bool:
        """Fills the gap beside ``held`` by the first complement that the counts allow, as often as they do."""
        gap = self.capacity - sum(held)
        pattern = held if not gap else next((p for p in self.complements(held, gap, most) if self.times(p)), None)
        if pattern and (times := self.times(pattern)):
            self.consume(pattern, times)
            return True
        return False

    def best_fit(self) -> None:
        """The rest, longest first: always into the smallest gap that takes the piece."""
        capacity, left = self.capacity, self.left
        gaps: list[int] = []
        opened: dict[int, list[list]] = {}

        def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
            if gap not in opened:
                opened[gap] = []
                insort(gaps, gap)
            opened[gap].append([pattern, times])

        for a in range(capacity, 0, -1):
            while left[a]:
                at = bisect_left(gaps, a)
                if at == len(gaps):  # as many to a sequence as fit
                    each = min(capacity // a, int(left[a]))
                    times = int(left[a]) // each
                    put(capacity - each * a, (a,) * each, times)
                    left[a] -= each * times
                    continue
                gap = gaps[at]
                pattern, times = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap], gaps[at]
                each = min(gap // a, max(1, int(left[a]) // times))
                used = min(times, int(left[a]) // each)
                left[a] -= each * used
                put(gap - each * a, pattern + (a,) * each, used)
                if times > used:
                    put(gap, pattern, times - used)
        self.patterns += [(p, t) for found in opened.values() for p, t in found]


def complements_first(histogram: dict[int, int], capacity: int, most: int) -> Patterns:
    """Exact fills by single pieces, then by pairs, then by triples, up to ``most`` pieces; then best fit."""
    stock = Stock(histogram, capacity)
    stock.fill((capacity,), 0)
    for fill in range(1, most + 1):
        for a in range(capacity - 1, capacity // (fill + 1) - 1, -1):
            while stock.left[a] and stock.fill((a,), fill):
                pass
    stock.best_fit()
    return stock.patterns


def longest_first(histogram: dict[int, int], capacity: int, most: int) -> Patterns:
    """For the longest piece at a time: exact fills, or else the longest piece that fits, and so on."""
    stock = Stock(histogram, capacity)
    left = stock.left
    for a in range(capacity, 0, -1):
        while left[a]:
            held = (a,)
            while not stock.fill(held, most):
                gap = capacity - sum(held)
                spare = left[: gap + 1] - np.bincount(held, minlength=capacity + 1)[: gap + 1]
                fits = np.flatnonzero(spare > 0)
                if not len(fits):
                    stock.consume(held, stock.times(held))
                    break
                held = (*held, int(fits[-1]))
    return stock.patterns


def plan(histogram: dict[int, int], capacity: int) -> Patterns:
    """Patterns of lengths that share a sequence, with their numbers of sequences: the fewest of several plans."""
    plans = [make(histogram, capacity, most) for make in (complements_first, longest_first) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


def places(patterns: Patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its slots, their first sequence and their offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], first, offset))
            taken[length] += times
            offset += length
        first += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}


def best_fit_pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_task: int = 50_000,
    ranks: str | None = None,
    pattern: str = "",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and packs as its end id alone. Repeated rows are
    packed as often as they stand; pieces that agree in every column are
    interchangeable, so reruns agree. Other columns are ignored; an empty table
    gives no rows. ``vocabulary`` and ``ranks`` (see :class:`Encoder`) must be
    readable on every executor.

    Pieces are narrow rows and are written once, since both the histogram and
    the placement read them. Ranks come from counts by (length, hash bucket), so
    a length that most pieces share is still ranked by many tasks. What reaches
    the driver and goes out with the tasks is the histogram and the plan, whose
    sizes follow ``capacity``.
    """
    cut = durable(pieces(docs, (vocabulary, ranks, pattern), end_id, capacity, id_col, text_col))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(plan(histogram, capacity))
    buckets = max(16, sum(histogram.values()) // rows_per_task)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select("id", "piece", "start", "length", "ids_crc32", "rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for value in np.unique(length):
                here = np.flatnonzero(length == value)
                since, first, at = slots[int(value)]
                slot = np.searchsorted(since, rank[here], side="right") - 1
                sequence[here] = first[slot] + rank[here] - since[slot]
                offset[here] = at[slot]
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = f"id {cut.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def packed(docs: DataFrame) -> DataFrame:
    """The contract's packing of a documents table."""
    import public_tokenizers

    at = public_tokenizers.path
    return best_fit_pack(
        docs, at("byte_bpe_50k.json"), end_id=2, ranks=at("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
