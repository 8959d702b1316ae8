import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reportloom.llm import chat_format as cf

ODD = st.lists(st.sampled_from([*cf.CONTROLS, "<", "\\", "[", "s>", "/s>", "INST]", "a", "\n", "é", "😀", " "]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_escaping_is_reversible_and_hides_controls(parts):
    text = "".join(parts)
    hidden = cf.escape(text)
    assert re.sub(cf.ESCAPED, r"\1\2\3", hidden) == text
    assert not any(c in hidden for c in cf.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), ODD.map("".join)), max_size=6))
def test_spans_hold_each_text(turns):
    out = cf.render(turns, cf.marked_turns)
    assert out.rewrites_at == -1
    assert [out.text[a:b] for _, a, b, _ in out.spans] == [cf.escape(t) for _, t in turns]
    assert "".join(out.text[a:b] for a, _, _, b in out.spans) == out.text


def test_a_template_that_rewrites_history_is_detected():
    only_last = lambda turns: "".join(  # noqa: E731  drops the thoughts of earlier turns
        t if k == len(turns) - 1 else t.split("|")[-1] for k, (_, t) in enumerate(turns)
    )
    out = cf.render([("user", "x"), ("assistant", "think|say"), ("user", "y")], only_last)
    assert out.rewrites_at == 2 and out.text == "xsayy"
    assert out.spans[0] == (0, 0, 1, 1) and out.spans[1] == out.spans[2] == (5, 5, 5, 5)


def test_long_conversations_by_context_and_by_whole_prefixes():
    turns = [("user" if k % 2 else "assistant", f"text {k}</s>") for k in range(200)]
    plain, whole = cf.render(turns, cf.marked_turns), cf.render(turns, cf.marked_turns, exact=1000)
    assert plain == whole and plain.rewrites_at == -1
    numbered = lambda turns: "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))
    assert cf.render(turns, numbered) == cf.render(turns, numbered, exact=1000)
    late = lambda turns: ("!" if len(turns) > 90 else "") + numbered(turns)
    assert cf.render(turns, late).rewrites_at == 90


def test_query_against_plain_digests(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "yo</s>", 0), (1, 0, "user", None, 0), (1, 0, "user", None, 0), (1, 2, None, "", 0), (3, 0, "a%0A\n\\n<s>%", "t", 0),
        (None, 0, "assistant", "a\\<s>", 0), (2, None, "system", "x" * 50_000, 0),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in cf.query(spark, str(tmp_path)).collect()}
    says = "</s>[INST] ok [/INST]"
    want = {
        1: [("user", ""), ("user", ""), ("assistant", "yo</s>"), ("", "")],
        None: [("assistant", "a\\<s>")],
        2: [("system", "x" * 50_000)],
        3: [("a%0A\n\\n<s>%", "t")],
        -1: [("user", says), ("assistant", says)],
    }
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_empty_table(spark):
    assert cf.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_a_rewrite_that_only_late_user_turns_show_is_detected():
    def budget(turns):
        old = len(turns) - 20 if turns and turns[-1][0] == "user" and len(turns) > 20 else 0
        return "".join(f"{role}:{text};" for role, text in turns[max(0, old) :])

    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(64)]
    assert cf.render(turns, budget).rewrites_at == 20


def test_a_rewrite_that_is_undone_later_is_detected():
    blank = lambda lengths: lambda turns: "".join(  # noqa: E731  turn 0 vanishes at these prefixes alone
        "" if k == 0 and len(turns) in lengths else f"{k}:{t};" for k, (_, t) in enumerate(turns)
    )
    turns = [("user", f"t{k}") for k in range(40)]
    assert cf.render(turns, blank([20])).rewrites_at == 19
    assert cf.render(turns, blank(range(19, 30))).rewrites_at == 18


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
def test_shared_ends(a, b):
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    end = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    for step in (1, 4, 4096):
        assert (cf.shared_start(a, b, step), cf.shared_end(a, b, step)) == (start, end)
