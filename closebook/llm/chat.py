"""Chat formatting with a grammar round trip.

A conversation is rendered turn after turn:

    user       <s>[INST] text [/INST]
    assistant   text </s>            (a blank before and after the text)
    system     <<SYS>> text <</SYS>>
    any other  [TURN] role [/TURN] text [/END]

The marks are control strings. Rendered text is parsed again by a deterministic parser, and its
turns are compared with the source; where they differ, control strings inside texts are escaped,
until they are identical. Escaping puts a backslash behind the first character of a control string,
and one more where backslashes stand there already; the parser takes one away. The loss mask
covers the assistants' texts.

A conversation is written as one or several rows of about CHUNK characters, whole turns each, so
that one that holds a third of all turns is never held in memory. Turns are dealt by range, so many tasks
render and parse such a conversation; only its digest is one task's stream.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from closebook.session import work_folder

CHUNK = 1 << 16
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[/END]"]
NULL_ROLE = "\x00null"

_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROL))

Turn = tuple[str, str]


def _groups(m: re.Match) -> list[str]:
    return [g for g in m.groups() if g is not None]


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "{0}\\{1}{2}".format(*_groups(m)), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "{0}{1}{2}".format(*_groups(m)), text)


def wrap(role: str, text: str) -> tuple[str, int]:
    """A turn with its marks, and where its text begins."""
    head, tail = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}.get(
        role, (f"[TURN] {role} [/TURN] ", " [/END]")
    )
    return head + text + tail, len(head)


_FORMS = [
    ("user", "<s>[INST] ", " [/INST]"),
    ("system", "<<SYS>> ", " <</SYS>>"),
    (None, "[TURN] ", " [/END]"),
    ("assistant", " ", " </s>"),
]
_MARK = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, begin and end of the rendered text); None where no grammar fits.

    At each place the opening mark decides the form; its text goes to the next control string,
    which must be the closing one.
    """
    found, at = [], 0
    while at < len(rendered):
        role, head, tail = next((f for f in _FORMS if rendered.startswith(f[1], at)), (None, None, None))
        if head is None:
            return None
        begin = at + len(head)
        if role is None:
            end = _closing(rendered, begin, " [/TURN]")
            if end is None or not rendered.startswith(" [/TURN] ", end):
                return None
            role, begin = unescape(rendered[begin:end]), end + len(" [/TURN] ")
        end = _closing(rendered, begin, tail)
        if end is None:
            return None
        found.append((role, unescape(rendered[begin:end]), begin, end))
        at = end + len(tail)
    return found


def _closing(rendered: str, begin: int, tail: str) -> int | None:
    mark = _MARK.search(rendered, begin)
    if mark is None or mark[0] != tail[1:]:
        return None
    end = mark.start() - 1
    return end if end >= begin and rendered[end] == " " else None


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn whose parse is the turn: (rendered, begin, end of the text).

    Parts are escaped one after the other until it is.
    """
    for own_role, own_text in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        rendered, begin = wrap(own_role, own_text)
        turns = parse(rendered)
        if turns and [t[:2] for t in turns] == [(role, text)]:
            return rendered, begin, begin + len(own_text)
    raise ValueError(f"no rendering of a turn of role {role!r} parses back to it")


_ROWS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
FORMATTED = "conv_id long, part long, text string, loss array<struct<begin:int,end:int>>"


def format_conversations(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, text, loss): rendered text in parts, with the spans of the loss mask.

    ``conversations`` has conv_id, turn, role and text; other columns are left out. Turns come in
    order of turn, null first; equal numbers by role and text; repeated rows are repeated turns.
    A null text is empty; a null role is a role of its own; a null conv_id is a conversation. Parts
    hold at least ``chunk`` characters, but for the last of a task; a longer turn is one part. ``part`` ascends,
    with gaps: tasks take ranges of turns one after the other, and number their parts from 2^32 times their own number.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit(NULL_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ("conv_id", "turn", "role", "text")
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        current, part, texts, loss, size = (), first, [], [], 0
        out: list[dict] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if texts and ((conv,) != current or size >= chunk):
                    out.append({"conv_id": current[0], "part": part, "text": _checked(texts), "loss": loss})
                    part, texts, loss, size = part + 1, [], [], 0
                if (conv,) != current:
                    current, part = (conv,), first
                rendered, begin, end = render_turn(role, text)
                if role == "assistant":
                    loss.append({"begin": size + begin, "end": size + end})
                texts.append((role, text, rendered))
                size += len(rendered)
            if out:
                yield pa.RecordBatch.from_pylist(out, _ROWS)
                out = []
        if texts:
            yield pa.RecordBatch.from_pylist([{"conv_id": current[0], "part": part, "text": _checked(texts), "loss": loss}], _ROWS)

    return ordered.mapInArrow(run, FORMATTED)


def _checked(turns: list[tuple[str, str, str]]) -> str:
    """The rendered turns as one text, which must parse back to all of them."""
    text = "".join(t[2] for t in turns)
    parsed = parse(text)
    if parsed is None or [t[:2] for t in parsed] != [t[:2] for t in turns]:
        raise ValueError("the rendered turns do not parse back")
    return text


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its rendered parts, which are parsed where they lie; what they
    say is then streamed in order.

    ``turns_sha256`` is of role, line break, text, line break for each turn; ``loss_sha256`` of the unescaped
    texts under the mask. A null role counts as empty.
    """
    parsed = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("masked", pa.string()), ("chars", pa.int64())])
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches):
        out, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                turns = parse(text)
                said = "".join(f"{'' if role == NULL_ROLE else role}\n{words}\n" for role, words, _, _ in turns)
                masked = "".join(unescape(text[span["begin"] : span["end"]]) for span in row["loss"])
                out.append({"conv_id": row["conv_id"], "part": row["part"], "n_turns": len(turns), "turns": said, "masked": masked, "chars": len(text)})
                size += len(text)
                if size >= 64 * CHUNK:
                    yield pa.RecordBatch.from_pylist(out, parsed)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, parsed)

    def run(batches):
        current = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if current is None or row["conv_id"] != current[0]:
                    if current is not None:
                        out.append(_done(current))
                    current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                current[1] += row["n_turns"]
                current[2].update(row["turns"].encode())
                current[3] += len(row["masked"])
                current[4].update(row["masked"].encode())
                current[5] += row["chars"]
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if current is not None:
            yield pa.RecordBatch.from_pylist([_done(current)], kinds)

    said = formatted.mapInArrow(read, "conv_id long, part long, n_turns long, turns string, masked string, chars long")
    ordered = said.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _done(state: list) -> dict:
    conv, n, turns, chars, loss, size = state
    return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Write the formatted conversations to a new folder of the work folder and read them back."""
    spark = conversations.sparkSession
    path = f"{work_folder(spark)}/closebook/chat-{uuid.uuid4().hex}"
    format_conversations(conversations).write.parquet(path)
    return read_conversations(spark.read.schema(FORMATTED).parquet(path))
