"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The
operator never looks inside it: it renders the prefixes of a conversation one
turn longer each time and compares consecutive outputs. If the longer output
starts with the shorter one, what was added is the new turn's span; if it
doesn't, the template has rewritten history, which is reported with the first
turn at which that happened, and such a turn has no span. Inside a span the
text's place is found by rendering the same prefix with a probe in its stead.

Defined results: a null role or text counts as empty; turns are ordered by
turn, then role, then text (a null turn first), so ties and repeated rows have
one order and each row is one turn; rows with a null conversation key form one
conversation; extra columns are ignored; an empty table gives no conversation
but those given in `also`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_or_empty

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_PROBE = "⁂probe⁂"


def escape(text: str) -> str:
    r"""No `<|` is left: each gets a backslash more between its characters."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def _one_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _from_line(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))


def marked(turns: Turns) -> str:
    """The default template: marks around each turn, control strings escaped."""
    return "".join([f"{START}{_one_line(role)}\n{escape(text)}{END}\n" for role, text in turns])


@dataclass(frozen=True)
class Span:
    role: str
    start: int
    end: int
    #: of the text itself; both None if it can't be found
    text_start: int | None
    text_end: int | None


def spans(turns: Turns, template: Template) -> tuple[str, list[Span | None], int | None]:
    """The output for all turns, the span of each turn, the first turn that rewrote history."""
    before, found, rewrote = template([]), [], None
    for n, (role, text) in enumerate(turns, 1):
        now = template(turns[:n])
        if not now.startswith(before):
            rewrote = n - 1 if rewrote is None else rewrote
            found = [None] * n
        else:
            probed = template([*turns[: n - 1], (role, _PROBE)])
            at = probed.find(_PROBE, len(before)) if probed.startswith(before) else -1
            tail = len(probed) - at - len(_PROBE)
            ok = at >= 0 and at + tail <= len(now) and now.startswith(probed[:at]) and now.endswith(probed[len(probed) - tail :] if tail else "")
            found.append(Span(role, len(before), len(now), at if ok else None, len(now) - tail if ok else None))
        before = now
    return before, found, rewrote


def read_back(output: str) -> Turns:
    """Turns from an output of `marked` alone."""
    turns = []
    for part in output.split(START)[1:]:
        head, _, rest = part.partition("\n")
        turns.append((_from_line(head), unescape(rest[: rest.rindex(END)])))
    return turns


def conversations(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of a conversation together and in order, without gathering them in one cell."""
    order = [F.col("_key").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text"]
    picked = rows.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), text_or_empty(role).alias("_role"), text_or_empty(text).alias("_text"))
    return picked.repartition(partitions(rows.sparkSession), "_key").sortWithinPartitions(*order)


def _grouped(batches) -> Iterator[tuple[object, Turns]]:
    key, turns = None, []
    for batch in batches:
        for k, r, t in zip(batch.column("_key").to_pylist(), batch.column("_role").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            if turns and k != key:
                yield key, turns
                turns = []
            key = k
            turns.append((r, t))
    if turns:
        yield key, turns


def format_chats(rows: DataFrame, template: Template = marked, loss_roles: tuple[str, ...] = ("assistant",), key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: the formatted string, spans (start, end, text_start, text_end, loss), the first rewriting turn."""
    key_type = rows.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))

    def run(batches):
        for k, turns in _grouped(batches):
            output, found, rewrote = spans(turns, template)
            dicts = [None if s is None else s.__dict__ | {"loss": s.role in loss_roles and s.text_start is not None} for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([k], key_arrow), pa.array([output]), pa.array([dicts], span_type), pa.array([rewrote], pa.int32())], names=[key, "formatted", "spans", "rewrote_at"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(rows.schema[key].dataType)
    schema = f"`{key}` {key_type}, formatted string, spans array<struct<role: string, start: bigint, end: bigint, text_start: bigint, text_end: bigint, loss: boolean>>, rewrote_at int"
    return conversations(rows, key, turn, role, text).mapInArrow(run, schema)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader of the outputs and spans of `marked` gets back."""
    key_type = formatted.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for output, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(output)
                told = "".join([f"{r}\n{t}\n" for r, t in turns])
                loss = "".join([unescape(output[s["text_start"] : s["text_end"]]) for s in found if s and s["loss"]])
                out.append((len(turns), _sha(told), len(loss), _sha(loss), len(output)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out))], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"`{key}` {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(key, "formatted", "spans").mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
