"""Chat formatting with mappings chosen by the fingerprint of a record's schema.

Records come as JSON in unlike layouts. The sorted paths of those of their nested
fields that any layout knows are hashed, and the hash selects a declarative mapping to
canonical turns; fields that no layout knows, such as an id, say nothing, and those by
which only another layout says a turn are further turns at the end. A system turn is
there if its field is not null, and an entry of a list that is no object is a turn
without a role, so nothing that is said is lost. Turns
are rendered one by one with a template that escapes control strings reversibly
and says where loss is taken; what is read back comes from the rendered text alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)
_RENDERED = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves; items of a list share the step []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(value) -> str:
    """A field's text: nothing for null, JSON for what is no text."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns: single fields by role, a list of messages, or both."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None  # the list, its role, its text
    turn: tuple[str, str] | None = None  # a record that is one turn: role, text

    def paths(self) -> set[str]:
        found = {f".{name}" for _, names in self.fields for name in names} | {f".{name}" for name in self.turn or ()}
        if self.messages:
            items, role, text = self.messages
            found |= {f".{items}[]", f".{items}[].{role}", f".{items}[].{text}"}
        return found

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.turn:
            return [(_text(record[self.turn[0]]), _text(record[self.turn[1]]))]
        out = [(role, "\n\n".join(t for t in (_text(record[n]) for n in names) if t)) for role, names in self.fields if role != "system" or any(record[n] is not None for n in names)]
        if self.messages:
            items, role, text = self.messages
            out += [(ROLES.get(_text(m.get(role)), _text(m.get(role))), _text(m.get(text))) if isinstance(m, dict) else ("", _text(m)) for m in record[items]]
        own = {name for _, names in self.fields for name in names}
        return out + [(SPOKEN[name], _text(value)) for name, value in record.items() if name in SPOKEN and name not in own and value is not None]


#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn", turn=("role", "text")),
    Layout("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("system_messages", (("system", ("system",)),), ("messages", "role", "content")),
    Layout("conversations", messages=("conversations", "from", "value")),
)
#: Fields by which any layout says a turn, and whose turn it is.
SPOKEN = {name: role for layout in LAYOUTS for role, names in layout.fields for name in names}
BY_FINGERPRINT = {fingerprint(layout.paths()): layout for layout in LAYOUTS}
_KNOWN = frozenset().union(*(layout.paths() for layout in LAYOUTS))


@lru_cache(maxsize=10_000)
def layout_of(paths: frozenset[str]) -> Layout | None:
    """The layout whose fingerprint the known fields have, else the one with the most fields that all are there, and the first of several."""
    found = BY_FINGERPRINT.get(fingerprint(paths & _KNOWN))
    return found or max((own for own in LAYOUTS if own.paths() <= paths), key=lambda own: len(own.paths()), default=None)


def escape(text: str) -> str:
    """text without any control string; unescape gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and from where to where it takes loss (nowhere: 0, 0)."""
    head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{CLOSE}\n", *loss


def read_turn(rendered: str) -> tuple[str, str]:
    match = _RENDERED.fullmatch(rendered)
    if match is None:
        raise ValueError("not one rendered turn")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], match[1], flags=re.S)
    return role, unescape(match[2])


def _rendering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        for conv, place, payload in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "payload"))):
            record = json.loads(payload) if payload else None
            layout = layout_of(frozenset(field_paths(record))) if isinstance(record, dict) else None
            turns = layout.turns(record) if layout else []
            rows += [(conv, place, k, layout.name, *render(*turn)) for k, turn in enumerate(turns)]
            if not turns:
                rows.append((conv, place, 0, layout.name if layout else None, None, 0, 0))
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "place", "step", "layout", "formatted", "loss_start", "loss_end"])


def formatted_turns(records: DataFrame) -> DataFrame:
    """A row for each canonical turn of records (conv_id, place, payload as JSON).

    Columns: conv_id, place, step (within the record), layout, formatted, loss_start
    and loss_end in code points. A record whose layout no mapping knows, or that has
    no turns, gives one row without formatted text, so that nothing vanishes unseen.
    """
    schema = "conv_id long, place long, step int, layout string, formatted string, loss_start long, loss_end long"
    return records.select(F.col("conv_id").cast("long"), F.col("place").cast("long"), "payload").mapInArrow(_rendering, schema)


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, rows = object(), None, []

    def close():
        if state is not None:
            turns, whole, chars, loss, total = state
            rows.append((current, turns, whole.hexdigest(), chars, loss.hexdigest(), total))

    def flush():
        columns = list(zip(*rows)) if rows else [[]] * 6
        rows.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, text, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if state is None or conv != current:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if text is None:
                continue
            role, said = read_turn(text)
            learned = unescape(text[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(text)
        yield flush()
    close()
    yield flush()


def read_back(turns: DataFrame) -> DataFrame:
    """What each formatted conversation says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through in order, one at a time, so memory does not grow with a
    conversation; a digest of it is by its nature a sequence in one task. Turns of one
    place and step go by their escaped text, then by their role. Rows without a conv_id form a conversation of their own.
    """
    said = F.substring_index(F.substring_index("formatted", CLOSE, 1), OPEN, -1)  # neither stands inside a text
    body = F.expr("substring(_said, locate('\n', _said) + 1)")
    ordered = turns.withColumn("_said", said).withColumn("_body", body).repartition("conv_id").sortWithinPartitions("conv_id", "place", "step", "_body", "formatted").drop("_said", "_body")
    return ordered.mapInArrow(_digesting, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """A record for each row of a table of conv_id, turn, role and text; nulls become empty.

    Conversations come in three layouts by their id, as from several sources: single
    turns, lists of messages with an id, and lists with other names for roles. Roles
    that these names do not cover are written as single turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    messages = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = F.to_json(F.struct(F.array(F.struct(other.alias("from"), text.alias("value"))).alias("conversations"), F.lit("shared").alias("source")))
    kind = F.when(role.isin("user", "assistant", "system"), F.pmod("conv_id", F.lit(3)))
    return conversations.select("conv_id", F.col("turn").alias("place"), F.when(kind == 1, messages).when(kind == 2, shared).otherwise(plain).alias("payload"))
