"""Periodic runs of words, found by recompression.

The words of a batch of texts become a run-length grammar: by turns, each block of equal
neighbours becomes one symbol (block compression), and each pair of a left and a right
letter becomes one (pair compression, the alphabet parted in two by a hash). Every level
shrinks by about a quarter or more, so there are logarithmically many. Equal stretches are
cut alike but for their ends, hence a longest common extension climbs the levels while both
sides stand at the start of a symbol, skips the rest of a block at once, and descends where
the symbols differ: a few steps a level.

A run of period p and at least four periods covers two neighbours of the grid 0, 2p, 4p, ...
with their partners p further on. So for each p these places are the candidates, a harmonic
sum in all; the extensions of a place and its partner to both sides are the run exactly.
A stretch that several periods fit keeps the smallest one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import ship, table

#: Words whose grammar is built together; a longer text has its own.
TOGETHER = 300_000
#: Candidates that are looked at together.
SLICE = 1 << 20


class Level:
    """One level of a grammar: its symbols, each one's symbol of the level above and words, and how that one came about."""

    def __init__(self, symbol: np.ndarray, words: np.ndarray):
        self.symbol, self.words = symbol, words
        self.up: np.ndarray | None = None  # the symbol above that each belongs to
        self.first: np.ndarray | None = None  # where each symbol above begins here, and the end
        self.block = False

    def mirrored(self) -> Level:
        out = Level(self.symbol[::-1], self.words[::-1])
        out.block = self.block
        if self.up is not None:
            n, above = len(self.symbol), len(self.first) - 1
            out.up, out.first = (above - 1 - self.up)[::-1], (n - self.first)[::-1]
        return out


def _closed(level: Level, opens: np.ndarray, block: bool) -> np.ndarray:
    """Joins each symbol to the one before unless it opens a new one; returns where the new ones begin."""
    level.block = block
    level.up = (np.cumsum(opens) - 1).astype(np.int32)
    starts = np.flatnonzero(opens)
    level.first = np.r_[starts, len(opens)].astype(np.int32)
    return starts


def _named(code: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """A new symbol for each different code, and the next free symbol."""
    kinds, name = np.unique(code, return_inverse=True)
    return name + free, free + len(kinds)


def grammar(symbol: np.ndarray, wall: np.ndarray) -> list[Level]:
    """The levels of texts that stand one after the other between ``wall`` places, up to one symbol a text.

    Symbols are numbered from 0. Walls are symbols of their own, never joined.
    """
    free = int(symbol.max(initial=0)) + 1
    levels = [Level(symbol.astype(np.int64), np.ones(len(symbol), dtype=np.int32))]
    wall = wall.copy()
    texts = int(wall.sum())
    while len(levels[-1].symbol) > 2 * texts and (~wall[1:] & ~wall[:-1]).any():
        here = levels[-1]
        same = np.r_[False, (here.symbol[1:] == here.symbol[:-1]) & ~wall[1:] & ~wall[:-1]]
        if same.any():
            starts = _closed(here, ~same, block=True)
            power = np.diff(here.first)
            above = here.symbol[starts].copy()
            long = np.flatnonzero(power > 1)
            above[long], free = _named(above[long] * (len(same) + 1) + power[long], free)
            wall = wall[starts]
            levels.append(Level(above, np.add.reduceat(here.words, starts)))
            here = levels[-1]
        # The hash of a symbol says its side; of both orders of the sides the one with more pairs is taken.
        with np.errstate(over="ignore"):
            mixed = (here.symbol.astype(np.uint64) + np.uint64(len(levels))) * np.uint64(0x9E3779B97F4A7C15)
            side = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)
        inner = ~wall[1:] & ~wall[:-1]
        up, down = inner & ~side[:-1] & side[1:], inner & side[:-1] & ~side[1:]
        pair = up if up.sum() >= down.sum() else down
        if pair.any():
            starts = _closed(here, np.r_[True, ~pair], block=False)
            above = here.symbol[starts].copy()
            joined = np.flatnonzero(np.diff(here.first) == 2)
            left = starts[joined]
            above[joined], free = _named(here.symbol[left] * free + here.symbol[left + 1], free)
            wall = wall[starts]
            levels.append(Level(above, np.add.reduceat(here.words, starts)))
        elif not same.any():  # an unlucky split: the next one differs, since it depends on the number of levels
            _closed(here, np.ones(len(here.symbol), dtype=bool), block=False)
            levels.append(Level(here.symbol.copy(), here.words.copy()))
    return levels


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places i and j on are alike (i and j different, both before the same wall)."""
    out = np.zeros(len(i), dtype=np.int64)
    x, y = i.astype(np.int64), j.astype(np.int64)
    top = np.zeros(len(i), dtype=np.int64)  # the level where two symbols were found to differ
    live = np.arange(len(i))
    for k, level in enumerate(levels):
        last = level.up is None
        while True:
            if not len(live):
                break
            a, b = x[live], y[live]
            differ = level.symbol[a] != level.symbol[b]
            top[live[differ]] = k
            live, a, b = live[~differ], a[~differ], b[~differ]
            if last:
                # Whole texts are walls here: what is alike up here are different places of one symbol.
                step = np.ones(len(live), dtype=np.int64)
                moving = np.ones(len(live), dtype=bool)
            else:
                pa_, pb = level.up[a], level.up[b]
                moving = (level.first[pa_] != a) | (level.first[pb] != b)
                step = np.minimum(level.first[pa_ + 1] - a, level.first[pb + 1] - b) if level.block else np.ones(len(live), dtype=np.int64)
            go = live[moving]
            if not len(go):
                break
            out[go] += step[moving] * level.words[a[moving]]
            x[go] += step[moving]
            y[go] += step[moving]
        if last:
            break
        x[live], y[live] = level.up[x[live]], level.up[y[live]]
    live = np.zeros(0, dtype=np.int64)
    for k in range(len(levels) - 1, 0, -1):
        live = np.r_[live, np.flatnonzero(top == k)]
        if not len(live):
            continue
        below = levels[k - 1]
        x[live], y[live] = below.first[x[live]], below.first[y[live]]
        while True:  # a pair holds two symbols, and a block is skipped at once
            a, b = x[live], y[live]
            same = below.symbol[a] == below.symbol[b]
            go, a, b = live[same], a[same], b[same]
            if not len(go):
                break
            step = np.minimum(below.first[below.up[a] + 1] - a, below.first[below.up[b] + 1] - b) if below.block else 1
            out[go] += step * below.words[a]
            x[go] += step
            y[go] += step
    return out


def candidates(begin: np.ndarray, size: np.ndarray):
    """(text, place, period) in slices: for each period up to a quarter of a text, every second multiple of it."""
    most = size // 4
    edge = np.cumsum(most)
    at = 0
    while at < (edge[-1] if len(edge) else 0):
        upto = min(at + SLICE // 8, int(edge[-1]))
        flat = np.arange(at, upto)
        text = np.searchsorted(edge, flat, side="right")
        period = flat - (edge[text] - most[text]) + 1
        count = size[text] // (2 * period)  # the place and two periods lie in the text
        ends = np.cumsum(count)
        a = 0
        while a < len(flat):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
            part = slice(a, b)
            total = np.repeat(np.arange(a, b), count[part])
            nth = np.arange(len(total)) - np.repeat(ends[part] - count[part] - (ends[a - 1] if a else 0), count[part])
            yield text[total], begin[text[total]] + nth * 2 * period[total], period[total]
            a = b
        at = upto


def runs(symbol: np.ndarray, text_of: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts that stand together, by text, start and period.

    A run is at least six words and four smallest periods long, and no word next to it
    extends it.
    """
    size = np.bincount(text_of, minlength=texts).astype(np.int64)
    begin = np.cumsum(size) - size + np.arange(texts) + 1  # with a wall before each text, and one at the end
    n = len(symbol) + texts + 1
    walls = np.r_[begin - 1, n - 1]
    wall = np.zeros(n, dtype=bool)
    wall[walls] = True
    row = np.empty(n, dtype=np.int64)
    row[~wall] = symbol
    row[walls] = int(symbol.max(initial=-1)) + 1 + np.arange(texts + 1)
    found = []
    forth = back = None
    for text, i, p in candidates(begin, size):
        # The two periods from the place on lie in the run: cheap looks before the grammar's.
        maybe = np.flatnonzero(row[i] == row[i + p])
        maybe = maybe[row[i[maybe] + p[maybe] - 1] == row[i[maybe] + 2 * p[maybe] - 1]]
        if not len(maybe):
            continue
        if forth is None:
            forth = grammar(row, wall)
            back = [level.mirrored() for level in forth]
        text, i, p = text[maybe], i[maybe], p[maybe]
        after = extensions(forth, i, i + p)
        far = np.flatnonzero(after >= p)
        text, i, p, after = text[far], i[far], p[far], after[far]
        before = extensions(back, n - i, n - i - p)
        length = before + p + after
        good = length >= np.maximum(6, 4 * p)
        found.append(np.stack([text, i - before - begin[text], length, p])[:, good])
    if not found:
        return tuple(np.zeros((4, 0), dtype=np.int64))
    text, start, length, p = np.concatenate(found, axis=1)
    by = np.lexsort((p, length, start, text))
    text, start, length, p = text[by], start[by], length[by], p[by]
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(by)]
    text, start, length, p = text[new], start[new], length[new], p[new]
    by = np.lexsort((p, start, text))
    return text[by], start[by], length[by], p[by]


def _words(texts: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's words (what ASCII white space leaves), a number for each word, and its text."""
    words = [t.encode().split() for t in texts.to_pylist()]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = pa.array([w for ws in words for w in ws], pa.large_binary())
    return words, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(words)), size)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reorder: Callable[[object, int], np.ndarray | None] | None = None
) -> DataFrame:
    """One row per input row: id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. ``runs`` holds each
    run (start, length, period) by start, then period; ``collapsed`` the words that are
    left, joined by single spaces, once every word that a run repeats is dropped. start,
    length, period and exponent_milli are those of the run with the most periods (of equal
    ones the first, then the shortest period), null without runs. The digests are those of
    the runs as lines and of ``collapsed``.

    ``reorder`` may give, for an id and a number of words, which word stands at each place
    instead (None: as they are), which plants runs in texts.

    A null or empty text has no words and no runs. Rows are judged one by one, so repeated
    rows and null ids stay; other columns are ignored; an empty table gives no rows. Texts
    are read whole: a text's grammar is built by one task, whose memory follows the
    longest text. No shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("_id").to_pylist() if reorder else None
        words, symbol, text_of = _words(batch.column("_text"))
        m = len(words)
        first = np.cumsum([0, *map(len, words)])
        if reorder:
            for t, ws in enumerate(words):
                if ws and (order := reorder(ids[t], len(ws))) is not None:
                    words[t] = [ws[k] for k in order.tolist()]
                    symbol[first[t] : first[t + 1]] = symbol[first[t] + order]
        text, start, length, period = (x.tolist() for x in runs(symbol, text_of, m))
        of: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for t, *run in zip(text, start, length, period, strict=True):
            of[t].append(tuple(run))
        best, digest, collapsed = [], [], []
        for ws, rs in zip(words, of, strict=True):
            top = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
            best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
            digest.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rs).encode()).hexdigest())
            if rs:
                edge = np.zeros(len(ws) + 1, dtype=np.int64)
                for s, n, p in rs:
                    edge[s + p] += 1
                    edge[s + n] -= 1
                ws = [ws[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(ws))
        longs = [[len(ws) for ws in words], [len(rs) for rs in of], *zip(*best, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id"), *(pa.array(v, pa.int64()) for v in longs), pa.array(digest),
                pa.array([hashlib.sha256(c).hexdigest() for c in collapsed]),
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in of], triple),
                pa.array([c.decode() for c in collapsed]),
            ],
            ["_id", *names],
        )

    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    def run(batches):
        for batch in batches:
            size = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to, total = at, 0
                while to < batch.num_rows and (to == at or total + size[to] <= 6 * TOGETHER):
                    total += size[to]
                    to += 1
                yield part(batch.slice(at, to - at))
                at = to

    schema = (
        f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that the contract gives to every tenth document by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place >= a, a + (place - a) % p, place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), reorder=planted).drop("n_words", "runs", "collapsed")
