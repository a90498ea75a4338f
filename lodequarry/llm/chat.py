"""Chat formatting with a round trip: what is rendered is parsed again by a deterministic grammar and must give the source turns.

The grammar, over whole conversations:
    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"            a user's
                 | "[OUT] " text " </s>"                an assistant's; its text is under the loss mask
                 | "<<SYS " json ">> " text " <</SYS>>" any other role, named as a JSON string
A text ends at the first closing mark of its kind that no backslash precedes. Within a text, 2k+1 backslashes before a control string stand for k backslashes
and the string itself. Every control string of a text is escaped, also where this parser would survive it bare, so that no reader of the marks meets a turn that is none; a role's
are written as JSON escapes. Each turn is parsed again and must come back as it was, each conversation too.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN = "<s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS", "<</SYS>>")
_CONTROL = "(" + "|".join(re.escape(c) for c in CONTROLS) + ")"
_BARE, _ESCAPED = re.compile(r"(\\*)" + _CONTROL), re.compile(r"(\\+)" + _CONTROL)
_CLOSE = {"user": re.compile(r" \[/INST\]"), "assistant": re.compile(r" </s>"), None: re.compile(r" <</SYS>>")}
#: Code points of rendered text that a chunk holds at most, unless one turn has more.
CHUNK = 1 << 20


class RoundTripError(ValueError):
    """Rendered text that does not parse, or not to what it was made of."""


def escape(text: str) -> str:
    return _BARE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn with its text as given, and where the text begins."""
    if role == "user":
        return f"[INST] {text} [/INST]", 7
    if role == "assistant":
        return f"[OUT] {text} </s>", 6
    name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
    head = f"<<SYS {name}>> "
    return f"{head}{text} <</SYS>>", len(head)


def parse_turn(said: str, at: int) -> tuple[str, str, int, int, int]:
    """Role, unescaped text, where the text begins and ends, and where the next turn begins."""
    if said.startswith("[INST] ", at):
        role, begin, close = "user", at + 7, _CLOSE["user"]
    elif said.startswith("[OUT] ", at):
        role, begin, close = "assistant", at + 6, _CLOSE["assistant"]
    elif said.startswith("<<SYS ", at):
        try:
            role, begin = json.JSONDecoder().raw_decode(said, at + 6)
        except ValueError as e:
            raise RoundTripError(f"no role at {at}") from e
        if not said.startswith(">> ", begin) or not isinstance(role, str):
            raise RoundTripError(f"no role at {at}")
        begin, close = begin + 3, _CLOSE[None]
    else:
        raise RoundTripError(f"no turn at {at}")
    found = close.search(said, begin)
    if found is None:
        raise RoundTripError(f"no end of the turn at {at}")
    return role, unescape(said[begin : found.start()]), begin, found.start(), found.end()


def parse(said: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    if not said.startswith(BEGIN):
        raise RoundTripError("no beginning")
    at, turns = len(BEGIN), []
    while at < len(said):
        role, text, _, _, at = parse_turn(said, at)
        turns.append((role, text))
    return turns


def _faithful(role: str, text: str, shown: str) -> bool:
    try:
        got = parse_turn(shown, 0)
    except RoundTripError:
        return False
    return got[:2] == (role, text) and got[4] == len(shown)


def faithful_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to role and text, its control strings escaped; and the span of its text."""
    said = escape(text)
    shown, begin = render_turn(role, said)
    if not _faithful(role, text, shown):
        raise RoundTripError(f"a turn of {role!r} cannot be rendered")
    return shown, begin, begin + len(said)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A whole conversation and the spans under its loss mask."""
    out, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        shown, a, b = faithful_turn(role, text)
        if role == "assistant":
            spans.append((at + a, at + b))
        out.append(shown)
        at += len(shown)
    said = "".join(out)
    if parse(said) != list(turns):
        raise RoundTripError("the conversation does not come back")
    return said, spans


def _formatter(batches):
    import pyarrow as pa

    schema = None
    conv, at, chunk, parts, source, spans, n = None, 0, 0, [], [], [], 0
    rows: list[tuple] = []

    def close():
        nonlocal parts, source, spans, chunk, n
        if parts:
            said = "".join(parts)
            if parse(said if chunk == 0 else BEGIN + said) != source:
                raise RoundTripError(f"conversation {conv} does not come back")
            rows.append((conv, chunk, at - len(said), said, len(source), spans))
            chunk, parts, source, spans, n = chunk + 1, [], [], [], 0

    def flush():
        cols = list(zip(*rows))
        kinds = [schema, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "chunk", "start", "formatted", "n_turns", "loss_spans"])
        rows.clear()
        return out

    started = False
    for batch in batches:
        schema = batch.schema.field(0).type
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not started or c != conv:
                close()
                conv, at, chunk, started = c, len(BEGIN), 0, True
                parts = [BEGIN]
            shown, a, b = faithful_turn(role, text)
            if parts and n and n + len(shown) > CHUNK:
                close()
            if role == "assistant":
                spans.append([at + a, at + b])
            parts.append(shown)
            source.append((role, text))
            at += len(shown)
            n += len(shown)
            if len(rows) >= 500:
                yield flush()
    close()
    if rows:
        yield flush()


def formatted(conversations: DataFrame) -> DataFrame:
    """Chunks of rendered conversations (conv_id, turn, role, text): conv_id, chunk, start (code points of the conversation before the chunk),
    formatted, n_turns and loss_spans (begin and end in the conversation of each assistant text).

    A conversation is the chunks' text in order; all but very long ones have one chunk. Turns are ordered by turn, nulls first, then role and text; a null
    text or role counts as empty; rows with a null conv_id are one conversation. Other columns are left aside; repeated rows are turns of
    their own. An empty table gives no rows. Turns stream through a task in order, so that a conversation needs memory for one chunk only."""
    turns = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_formatter, f"conv_id {kind}, chunk int, start long, formatted string, n_turns long, loss_spans array<array<long>>")


def _reader(batches):
    import pyarrow as pa

    state: list = []
    done: list[tuple] = []
    kind = None

    def close():
        if state:
            conv, turns, whole, n, loss, chars = state
            done.append((conv, turns, whole.hexdigest(), n, loss.hexdigest(), chars))

    def flush():
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, start, said, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if start == 0:
                close()
                state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if not state or state[0] != conv or state[5] != start:
                raise RoundTripError(f"a chunk of conversation {conv} is missing")
            at = len(BEGIN) if start == 0 else 0
            masked = []
            while at < len(said):
                role, text, a, b, at = parse_turn(said, at)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    masked.append([start + a, start + b])
            if masked != (spans or []):
                raise RoundTripError(f"the loss mask of conversation {conv} is off")
            for a, b in masked:
                text = unescape(said[a - start : b - start])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(said)
        if len(done) >= 1000:
            yield flush()
    close()
    if done:
        yield flush()


def read_back(chunks: DataFrame) -> DataFrame:
    """By conversation, what the rendered chunks say: n_turns, turns_sha256 (of role, newline, text, newline for every turn), loss_chars and
    loss_sha256 (of the unescaped text under the loss mask), formatted_chars."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "start", "formatted", "loss_spans")
    return ordered.mapInArrow(_reader, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
