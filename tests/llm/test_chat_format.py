from __future__ import annotations

import hashlib
import random

from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from tallyframe.llm.chat_format import (
    content_text, conversation_digests, escape, format_messages, format_turn, read_turns, text_part, unescape,
)

SNIPPETS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<|", "<|image:0|>", "<SYS", "\\", "<", "[", " ", "s>", "INST]", "é", "\n", "a"]
TEXTS = st.lists(st.sampled_from(SNIPPETS), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@cases(TEXTS)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text
    assert not any(x in escape(text) for x in SNIPPETS[:9])


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), max_size=5))
def test_conversations_read_back(turns):
    segments = [format_turn(role, [{"type": "text", "text": text}]) for role, text in turns]
    read = [(role, content_text(c)) for role, c in read_turns("".join(s["segment"] for s in segments))]
    assert read == turns
    for (role, text), s in zip(turns, segments):
        assert content_text(s["segment"][s["loss_start"]:s["loss_end"]]) == (text if role == "assistant" else "")


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        n, turns, loss = out.get(conv, (0, "", ""))
        role, text = role or "", text or ""
        out[conv] = n + 1, f"{turns}{role}\n{text}\n", loss + (text if role == "assistant" else "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in out.items()}


def digests(frame):
    out = conversation_digests(format_messages(frame.withColumn("content", text_part(frame["text"])))).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out}
    assert len(got) == len(out)
    return got


def test_given_conversations(spark, given):
    frame = given("conversations")
    assert digests(frame) == expected([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()])


def test_edges(spark):
    rng = random.Random(3)
    rows = [(i % 7, i // 7, rng.choice(["user", "assistant"]), "".join(rng.choices(SNIPPETS, k=8))) for i in range(70)]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (9, 0, "tool", ""), (9, 0, "tool", ""), (10, 0, "assistant", "w " * 100000)]
    rows += [(11, i, "assistant", f"turn {i}") for i in range(3000)]  # one long conversation
    schema = "conv_id long, turn long, role string, text string, segment string"
    assert digests(spark.createDataFrame([(*r, "clash") for r in rows], schema)) == expected(rows)
    assert digests(spark.createDataFrame([], schema)) == {}


def test_typed_parts(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see <|image:0|>"), part(type="image", ref="a.png", width=672, height=337),
             part(type="audio", ref="b.wav", seconds=2.0), part(type="text", text="and"), part(type="document", ref=None, pages=3),
             part(type=None, text="?"), part(type="image")]
    frame = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)],
                                  "conv_id long, turn long, role string, content array<struct<type: string, text: string, ref: string, "
                                  "width: int, height: int, seconds: double, pages: int>>")
    a, b = sorted(format_messages(frame).collect(), key=lambda r: r.turn)
    assert a.segment == " see <\\|image:0|><|image:0|><|audio:1|>and<|document:2|>?<|image:3|> </s>"
    assert [(x.number, x.kind, x.ref, x.tokens) for x in a.attachments] == [
        (0, "image", "a.png", 4 * 144), (1, "audio", "b.wav", 50), (2, "document", None, 3 * 512), (3, "image", None, 144)]
    assert all(a.segment[x.at:].startswith(f"<|{x.kind}:{x.number}|>") for x in a.attachments)
    assert a.part_tokens == sum(x.tokens for x in a.attachments)
    assert content_text(a.segment[a.loss_start:a.loss_end]) == "see <|image:0|>and?"
    assert (b.segment, b.attachments, b.loss_end) == ("<s>[INST]  [/INST]", [], 0)
