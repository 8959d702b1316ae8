"""Chat formatting with black-box templates.

A template is any function from a list of turns to a string. Spans are found by
rendering successive prefixes of a conversation: where the next output extends
the previous one, the added text is the new turn's span; where it does not, the
template has rewritten history and the conversation says so. Inside a span, two
probe renderings that differ in the turn's text alone give the fixed head and
tail around it, so the text's own place is known without reading the template.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import ship, table

Turn = tuple[str, str]

#: The strings that steer common chat models.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string with any number of backslashes after its first character.
ESCAPABLE = rf"([<\[])(\\*)({_RESTS})"
ESCAPED = rf"([<\[])\\(\\*)({_RESTS})"


def escape(text: str) -> str:
    """Puts one more backslash into everything that is, or was made from, a control string."""
    return re.sub(ESCAPABLE, r"\1\2\\\3", text)


@lru_cache(maxsize=1024)
def _marked(turn: Turn) -> str:
    role, text = turn
    return f"<s>{escape(role.replace('%', '%25').replace(chr(10), '%0A'))}\n{escape(text)}</s>\n"


def marked_turns(turns: list[Turn]) -> str:
    """The default template: each turn as ``<s>role``, a new line, the text, ``</s>``, a new line."""
    return "".join(map(_marked, turns))


def shared_start(a: str, b: str, step: int = 4096) -> int:
    """How many characters two strings have in common at their start."""
    at, end = 0, min(len(a), len(b))
    while step:
        while at + step <= end and a[at : at + step] == b[at : at + step]:
            at += step
        step //= 2
    return at


def shared_end(a: str, b: str, step: int = 4096) -> int:
    """How many characters two strings have in common at their end."""
    at, end = 0, min(len(a), len(b))
    while step:
        while at + step <= end and a[len(a) - at - step : len(a) - at] == b[len(b) - at - step : len(b) - at]:
            at += step
        step //= 2
    return at


def unescaped(text: Column) -> Column:
    """Undoes :func:`escape`."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


@dataclass
class Rendered:
    text: str
    #: For each turn: head start, text start, text end, span end in ``text``.
    spans: list[tuple[int, int, int, int]]
    #: The first turn that changed what stood before it, or -1.
    rewrites_at: int


def render(turns: list[Turn], template: Callable[[list[Turn]], str], context: int = 2, exact: int | None = None) -> Rendered:
    """Renders and locates; spans from the first rewriting turn on are empty at the end.

    Every prefix is rendered whole, which costs the square of a conversation's
    length. ``exact`` is for templates known to append alone: only so many
    prefixes are rendered whole. Later turns are rendered behind their last ``context`` turns only, and the text that this predicts is
    held against the whole prefix whenever the number of turns has doubled and at
    the end, so a rewrite that no such point shows goes unseen.
    Where a prediction fails, or a turn does not extend its context, the turns
    since the last comparison are done again with whole prefixes.
    """
    exact = len(turns) if exact is None else exact
    text, spans, rewrites_at = template([]), [], -1
    k, whole, checked = 0, False, (0, text)
    while k < len(turns):
        start = 0 if whole or k < exact else k - context
        before = template(turns[start:k]) if start else text
        after = template(turns[start : k + 1])
        fits = after.startswith(before)
        if fits:
            one, two = (template([*turns[start:k], (turns[k][0], probe)]) for probe in "ab")
            head, tail = shared_start(one, two), shared_end(one, two)
            shift = len(text) - len(before)
            spans.append(tuple(shift + x for x in (len(before), head, max(head, len(after) - tail), len(after))))
            text += after[len(before) :]
            k += 1
            if start and (k & (k - 1) == 0 or k == len(turns)):
                fits = template(turns[:k]) == text
            if fits and (not start or k & (k - 1) == 0):
                checked = (k, text)
        if not fits:
            if not start:
                rewrites_at = k
                break
            whole, (k, text) = True, checked
            del spans[k:]
    if rewrites_at >= 0:
        before, text = text, template(turns)
        kept = shared_start(text, before)
        spans = [s if s[3] <= kept else (len(text),) * 4 for s in spans]
        spans += [(len(text),) * 4] * (len(turns) - len(spans))
    return Rendered(text, spans, rewrites_at)


def chat_format(
    conversations: DataFrame,
    template: Callable[[list[Turn]], str] = marked_turns,
    loss_roles: tuple[str, ...] = ("assistant",),
    exact: int | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrites_at.

    Takes (conv_id, turn, role, text). Turns stand in the order of turn, then
    role, then text, nulls first, so repeated and tied rows have one defined
    order. Null roles and texts count as empty; rows with a null conv_id form
    one conversation. ``spans`` holds (head_start, text_start, text_end, end,
    loss) for each turn, in code points of ``formatted``; loss marks the roles
    to learn from. ``exact`` is that of :func:`render`. Other columns are ignored; an empty table gives no rows.

    Rows are sorted inside hash partitions of conv_id and streamed: a worker
    holds one conversation at a time. One conversation is one string, so it is
    the unit of work however long it is.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, formatted string, "
        "spans array<struct<head_start:long,text_start:long,text_end:long,end:long,loss:boolean>>, rewrites_at long"
    )
    arrow_spans = pa.list_(
        pa.struct([(n, pa.int64()) for n in ("head_start", "text_start", "text_end", "end")] + [("loss", pa.bool_())])
    )

    def run(batches):
        key, turns, done, kept = None, [], [], None

        def close():
            out = render(turns, template, exact=exact)
            spans = [
                {"head_start": s[0], "text_start": s[1], "text_end": s[2], "end": s[3], "loss": role in loss_roles}
                for s, (role, _) in zip(out.spans, turns, strict=True)
            ]
            done.append((key, out.text, spans, out.rewrites_at))

        def batch_of():
            ids, texts, spans, at = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kept), pa.array(texts, pa.string()), pa.array(spans, arrow_spans), pa.array(at, pa.int64())],
                ["conv_id", "formatted", "spans", "rewrites_at"],
            )

        for batch in batches:
            kept = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != key:
                    close()
                    turns = []
                key = conv
                turns.append((role, text))
            if done:
                yield batch_of()
                done = []
        if turns:
            close()
            yield batch_of()

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, read back from the formatted strings."""
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    part = lambda s, a, b: F.substring("formatted", s[a] + 1, s[b] - s[a])

    def turn(s: Column) -> Column:
        head = F.substring("formatted", s["head_start"] + 4, s["text_start"] - s["head_start"] - 4)
        role = F.replace(F.replace(unescaped(head), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.concat(role, F.lit("\n"), unescaped(part(s, "text_start", "text_end")), F.lit("\n"))

    loss = F.array_join(
        F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: unescaped(part(s, "text_start", "text_end"))), ""
    )
    return (
        chat_format(rows)
        .select(
            "conv_id",
            F.size("spans").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("spans", turn), ""), 256).alias("turns_sha256"),
            loss.alias("loss"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.col("rewrites_at"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
            (F.col("rewrites_at") >= 0).alias("rewrites_history"),
        )
    )
