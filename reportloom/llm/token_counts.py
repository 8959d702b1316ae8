"""Token counts by a compiled finite-state transducer, without building the tokens.

A sentencepiece BPE vocabulary whose pieces hold the space mark only at their
start never merges across the border between a character and a following space
mark. A text therefore falls into chunks (space marks, then other characters),
and every chunk leaves the transducer in its start state: the state map of a
chunk is a constant, so maps compose by adding their counts and the counts of
all texts of a batch come from one prefix sum.

Inside a chunk the transducer reads characters. A sequence of pieces is the
encoding of its text exactly if each two neighbours are the encoding of their
own concatenation, so the last piece of every prefix is determined by the last
pieces of the shorter prefixes. A state holds the longest suffix that can still
begin a piece and, for each place in it where a piece could start, the piece
that ends there and the number of pieces since. Transitions carry the change in
the number of emitted pieces (which can be negative: two pieces may become one).
States and transitions are compiled when first met and kept by the worker.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import ship

MARK = "▁"
#: Entries of a worker's chunk and pair memos; a full memo is emptied and refilled.
MEMO = 300_000
UNKNOWN = None


class Transducer:
    """The counting transducer of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            raise ValueError("a piece holds the space mark after another character: chunks are not independent")
        self.whole = {p for p in self.score if self._encode(p) == [p]}
        self.begins = {p[:k] for p in self.whole for k in range(1, len(p))}
        self.longest = max(map(len, self.whole), default=1)
        self.pairs: dict[tuple, bool] = {}
        self.states: dict[tuple, dict] = {}
        self.history: dict[int, tuple] = {}
        self.start = self._state(("", ((UNKNOWN, 0),)))
        self.memo: dict[str, int] = {}

    def _encode(self, text: str) -> list[str]:
        """Merges by score, leftmost first: the definition, for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score[m], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.score),
                default=None,
            )
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, left: str | None, right: str) -> bool:
        """Whether the two pieces stay as they are side by side."""
        if left is UNKNOWN:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[left, right] = self._encode(left + right) == [left, right]
        return found

    def _state(self, key: tuple) -> dict:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {}
            self.history[id(state)] = key
        return state

    def _compile(self, state: dict, char: str) -> tuple[dict, int]:
        """The transition of ``state`` on ``char``.

        A key is (suffix, places): places[k] belongs to the border k characters
        before the end, as (piece that ends there, pieces since).
        """
        suffix, places = self.history[id(state)]
        if char not in self.whole:
            step = (self.start, len(char.encode("utf-8", "surrogatepass")))
        else:
            text = suffix + char
            for size in range(len(text), 0, -1):
                piece = text[-size:]
                if piece in self.whole and places[size - 1] and self._fits(places[size - 1][0], piece):
                    since = places[size - 1][1]
                    break
            else:
                raise AssertionError("every prefix has a last piece")
            change = 1 - since
            keep = next((k for k in range(len(text), 0, -1) if text[-k:] in self.begins), 0)
            after = [(piece, 0)]
            for k in range(1, keep + 1):
                place = places[k - 1]
                after.append((place[0], place[1] + change) if place and text[-k:] in self.begins else None)
            step = (self._state((text[len(text) - keep :], tuple(after))), change)
        state[char] = step
        return step

    def chunk(self, text: str) -> int:
        """Pieces of one chunk, read from the start state."""
        if len(self.states) > MEMO:
            self.states.clear()
            self.history.clear()
            self.start = self._state(("", ((UNKNOWN, 0),)))
        state, count = self.start, 0
        for char in text:
            step = state.get(char) or self._compile(state, char)
            state = step[0]
            count += step[1]
        return count

    def chunks(self, text: str) -> list[int]:
        """Counts of a text's chunks, in order."""
        if not text:
            return []
        memo, runs = self.memo, text.replace(" ", MARK).split(MARK)
        if len(memo) > MEMO:
            memo.clear()
        counts, marks = [], 0
        for run in runs[:-1] if not runs[-1] else runs:
            marks += 1
            if not run:
                continue
            key = run if marks == 1 else MARK * (marks - 1) + run
            count = memo.get(key)
            if count is None:
                count = memo[key] = self.chunk(MARK + key)
            counts.append(count)
            marks = 0
        if not runs[-1]:
            counts.append(self.chunk(MARK * (marks + 1)))
        return counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts: chunk counts of all of them, one prefix sum."""
        flat, ends = [], []
        for text in texts:
            flat += self.chunks(text)
            ends.append(len(flat))
        total = np.concatenate([[0], np.cumsum(np.array(flat, dtype=np.int64))])
        ends = np.array([0, *ends], dtype=np.int64)
        return np.diff(total[ends])


def transducer(model_file: str) -> Transducer:
    """One compiled transducer for each model and worker process."""
    kept = sys.modules[__name__].__dict__.setdefault("_compiled", {})
    if model_file not in kept:
        kept[model_file] = Transducer(model_file)
    return kept[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    ``model_file`` must be readable at the same path on every executor. A null
    text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept
    as they are; other columns are ignored; an empty table gives no rows. Texts
    of any length are read whole. No shuffle: a narrow map over the scan.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )

    def count(batches):
        compiled = transducer(model_file)
        for batch in batches:
            n = compiled.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reportloom.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
