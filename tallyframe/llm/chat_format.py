"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor walks the
parts in order and writes them into one string: text as it is, with control strings escaped,
and each attachment as a numbered placeholder. What the placeholders stand for is recorded
beside the string: kind, reference, position, and the number of tokens that the placeholder
expands to. Assistant text is under the loss mask, as spans of code points.

    <s>[INST] text <|image:0|> [/INST] answer </s>

Every message is formatted by itself, into a segment; a conversation is the concatenation of its
segments. So a conversation of any length is split between rows, and only its digests are
taken in order, in a stream of rows that is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: tokens that a placeholder expands to --------------------------------
IMAGE_TILE, IMAGE_TOKENS = 336, 144  # every started tile of so many pixels a side, so many tokens
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 512
KINDS = ("image", "audio", "document")

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
_ATTACHMENTS = "array<struct<number: int, kind: string, ref: string, at: int, tokens: long>>"
_SEGMENT = (f"conv_id long, turn long, role string, segment string, attachments {_ATTACHMENTS}, "
            "loss_start int, loss_end int, part_tokens long")

# Control strings begin with one of < and [ in a fixed set of words. Inside texts and roles an
# escape character is put behind the first character of each, and doubled where it occurs.
ESCAPE = "\\"
_CONTROL = re.compile(r"(?:<(?=s>|/s>|\||/?SYS)|\[(?=/?INST\]|/?ROLE\])|\\)")
_ESCAPED = re.compile(r"(?:([<\[])\\|\\\\)")


def escape(text: str) -> str:
    """No control string is left; `unescape` gives the text back."""
    return _CONTROL.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or ESCAPE, text)


def part_tokens(part: dict) -> int:
    """Tokens that an attachment's placeholder expands to; unknown measures count as the least."""
    if part["type"] == "image":
        tiles = [-(-max(part.get(k) or 1, 1) // IMAGE_TILE) for k in ("width", "height")]
        return tiles[0] * tiles[1] * IMAGE_TOKENS
    if part["type"] == "audio":
        return max(1, round((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND))
    return max(part.get("pages") or 1, 1) * DOCUMENT_TOKENS_PER_PAGE


class Flattener:
    """Visits the parts of one message in order."""

    def __init__(self):
        self.pieces, self.length, self.attachments = [], 0, []

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}" if part["type"] in KINDS else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def _attach(self, part: dict) -> None:
        number, at = len(self.attachments), self.length
        self.add(f"<|{part['type']}:{number}|>")
        self.attachments.append({"number": number, "kind": part["type"], "ref": part.get("ref"), "at": at, "tokens": part_tokens(part)})

    visit_image = visit_audio = visit_document = _attach


# A turn's opening and closing. User and assistant have the usual marks; any other role is named.
def _marks(role: str) -> tuple[str, str]:
    if role == "user":
        return "<s>[INST] ", " [/INST]"
    if role == "assistant":
        return " ", " </s>"
    return f"[ROLE]{escape(role)}[/ROLE] ", " [/ROLE]"


def format_turn(role: str, parts: list[dict]) -> dict:
    """The segment of one message, its attachments and the span of its text under the loss mask."""
    before, after = _marks(role)
    visitor = Flattener()
    visitor.add(before)
    for part in parts:
        visitor.visit(part)
    inner = visitor.length
    visitor.add(after)
    loss = (len(before), inner) if role == "assistant" else (0, 0)
    return {"segment": "".join(visitor.pieces), "attachments": visitor.attachments,
            "loss_start": loss[0], "loss_end": loss[1], "part_tokens": sum(a["tokens"] for a in visitor.attachments)}


_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of formatted text, still escaped; ValueError if it isn't whole."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = "user" if m["user"] is not None else "assistant" if m["assistant"] is not None else unescape(m["role"])
        turns.append((role, next(x for x in (m["user"], m["assistant"], m["other"]) if x is not None)))
        at = m.end()
    return turns


def content_text(content: str) -> str:
    """A turn's text without placeholders, unescaped."""
    return unescape(_PLACEHOLDER.sub("", content))


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in (
            ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _format(batches):
    struct = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
                        ("attachments", pa.list_(struct)), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("part_tokens", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"] or "", **format_turn(r["role"] or "", r["content"] or [])}
                 for r in rows.to_pylist()], schema)


def format_messages(messages: DataFrame) -> DataFrame:
    """A row for each message: its segment, attachments, loss span and expanded part tokens.

    messages: conv_id, turn, role, content (a list of parts, see PART); other columns are
    ignored. Positions are code points within the segment; loss_start = loss_end where nothing
    is under the loss mask. A null role is an empty one, null content has no parts, a part of
    unknown or missing type is text, a null text is empty. Repeated rows are messages of their
    own. One pass, no shuffle.
    """
    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("content").cast(f"array<{PART}>").alias("content"))
    return slim.mapInArrow(_format, _SEGMENT)


def _digest(batches):
    """Rows sorted by conversation: one running state, whatever a conversation's length."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("part_tokens", pa.int64())])
    state, current, begun = None, None, False

    def done():
        n, turns, loss_n, loss, chars, files, tokens = state
        return {"conv_id": current, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_n,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_attachments": files, "part_tokens": tokens}

    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("conv_id", "segment", "loss_start", "loss_end", "attachments", "part_tokens")]
        for i in range(batch.num_rows):
            conv, segment, start, end, files, tokens = (c[i].as_py() for c in columns)
            if not begun or conv != current:
                if begun:
                    out.append(done())
                begun, current = True, conv
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, content in read_turns(segment):  # read back from the output
                state[0] += 1
                state[1].update(f"{role}\n{content_text(content)}\n".encode())
            loss = content_text(segment[start:end])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(segment)
            state[5] += len(files or [])
            state[6] += tokens
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if begun:
        yield pa.RecordBatch.from_pylist([done()], schema)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from their segments: one row for each conv_id.

    Turns are in the order of `turn` (missing ones first), then role, then segment. Roles and
    texts are hashed with line ends between; n_turns counts them. Missing conv_ids are one
    conversation. No rows give no rows.
    """
    order = ["conv_id", "turn", "role", "segment"]
    return (segments.repartition("conv_id").sortWithinPartitions(*order)
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, n_attachments long, part_tokens long"))
