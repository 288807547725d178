"""Chat formatting by schema fingerprints.

A record (a JSON object) is fingerprinted by the hash of its set of nested field
paths; the fingerprint selects a declarative mapping that turns the record's
layout into canonical turns (conversation, turn, role, text).  New layouts are
added as data, by an example of their fields, not as code.  A record that no
layout maps (null, no JSON object, an unknown fingerprint, no turns, a text that
is no string) ends nothing: it goes to ``rejects`` with the reason and its paths.

Each turn is formatted on its own: ``<|turn|>role<|text|>text<|end|>``.  Control
strings of this and of common other templates are escaped inside roles and texts
by a backslash after their first character, and backslashes are doubled, so the
text is recovered exactly.  The loss mask is one span of code points in each
formatted assistant turn: its escaped text.  A conversation is the concatenation
of its turns, so none has to fit one row, however long it is.

Defined cases: a null text or role is empty; a null turn sorts first; turns that
tie are ordered by their formatted form; a null conversation is one of its own;
repeated turns each count; an empty table gives an empty result; unmapped extra
fields change the fingerprint unless the mapping lists them as optional; texts
may have any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T

CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths: ``a.b`` for objects, ``a[]`` for arrays."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How one layout maps to turns.

    ``fields``: the paths of its records.  Either ``each`` (an array path) with ``role`` and ``text`` inside its
    objects, or ``parts``: (role, paths joined by a blank line) in order; empty parts are left out.  A layout of
    single turns gives the paths of ``turn``, ``role`` and ``text``.
    """

    name: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def prints(self) -> set[str]:
        out = [set(self.fields)]
        for o in self.optional:
            out += [x | {o} for x in out]
        return {fingerprint(x) for x in out}

    def turns(self, rec: dict):
        name = lambda r: self.roles.get(r, r)
        if self.turn:
            yield at(rec, self.turn), name(at(rec, self.role)), at(rec, self.text)
        elif self.each:
            for i, x in enumerate(at(rec, self.each)):
                yield i, name(at(x, self.role)), at(x, self.text)
        else:
            i = 0
            for role, keys in self.parts:
                found = [at(rec, k) for k in keys]
                if any(x is not None and not isinstance(x, str) for x in found):
                    raise TypeError
                text = "\n\n".join(x for x in found if x)
                if text:
                    yield i, role, text
                    i += 1


def at(value, path: str):
    """What stands at a path of objects; None where there is nothing."""
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


SHORT = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn row", ("conv_id", "turn", "role", "text"), turn="turn", role="role", text="text"),
    Layout("nested turn", ("conversation.id", "conversation.turn", "message.role", "message.content"), turn="conversation.turn", role="message.role", text="message.content"),
    Layout("from and value turn", ("id", "index", "from", "value"), turn="index", role="from", text="value", roles=SHORT),
    Layout("author turn", ("thread", "position", "author.role", "content.text"), turn="position", role="author.role", text="content.text"),
    Layout("messages", ("messages[].role", "messages[].content"), optional=("id", "conv_id"), each="messages", role="role", text="content", roles=SHORT),
    Layout("from and value", ("conversations[].from", "conversations[].value"), optional=("id", "conv_id"), each="conversations", role="from", text="value", roles=SHORT),
    Layout("instruction", ("instruction", "output"), optional=("input", "system", "id", "conv_id"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), optional=("system", "id", "conv_id"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), optional=("system", "id", "conv_id"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), optional=("context", "id", "conv_id"), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


TURNS = "conv_id long, turn long, role string, text string, layout string"


def map_records(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, layout, reason, record): the turns of JSON records by their fingerprints, with a null
    reason, and a row with a reason and the record for each record that has none."""
    by = {p: x for x in layouts for p in x.prints()}

    def one(raw):
        """(turns, layout, reason) of a record."""
        if raw is None:
            return [], None, "no record"
        try:
            rec = json.loads(raw, strict=False)
        except ValueError:
            return [], None, "no JSON"
        if not isinstance(rec, dict):
            return [], None, "no JSON object"
        found = paths(rec)
        layout = by.get(fingerprint(found))
        if layout is None:
            return [], None, f"no layout for the fields {', '.join(sorted(found))}"
        try:
            turns = [(t, r or "", x or "") for t, r, x in layout.turns(rec)]
        except TypeError:
            return [], layout.name, "a text is no string"
        if any(not isinstance(r, str) or not isinstance(x, str) for _, r, x in turns):
            return [], layout.name, "a text is no string"
        if any(t is not None and type(t) is not int for t, _, _ in turns):
            return [], layout.name, "a turn is no whole number"
        return turns, layout.name, None if turns else "no turns"

    def run(batches):
        for b in batches:
            out = []
            for i, raw in zip(T.column(b, "conv_id").to_pylist(), T.column(b, "record").to_pylist()):
                turns, layout, reason = one(raw)
                out += [(i, *t, layout, None, None) for t in turns] if reason is None else [(i, None, None, None, layout, reason, raw)]
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "turn", "role", "text", "layout", "reason", "record"])

    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record"))
    return rows.mapInArrow(run, f"{TURNS}, reason string, record string")


def canonical_turns(records: DataFrame, *args, **named) -> DataFrame:
    """(conv_id, turn, role, text, layout) of the records that a layout maps."""
    return map_records(records, *args, **named).where("reason IS NULL").drop("reason", "record")


def rejects(records: DataFrame, *args, **named) -> DataFrame:
    """(conv_id, layout, reason, record) of the records that none maps."""
    return map_records(records, *args, **named).where("reason IS NOT NULL").select("conv_id", "layout", "reason", "record")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text in code points)."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): a span of the formatted turn, empty unless an assistant speaks."""

    def run(batches):
        for b in batches:
            out = []
            for role, text in zip(T.column(b, "role").to_pylist(), T.column(b, "text").to_pylist()):
                formatted, a, z = format_turn(role or "", text or "")
                out.append((formatted, a, z if role == "assistant" else a))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [T.column(b, "conv_id"), T.column(b, "turn"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def parse_turn(formatted: str) -> tuple[str, str]:
    role, text = formatted[len(TURN) : -len(END)].split(TEXT)
    return unescape(role), unescape(text)


def _digest(batches):
    """Streams turns in order: state is kept for one conversation, of whatever length."""
    now, out, started = None, [], False

    def close():
        out.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

    def flush():
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.clear()
        return batch

    for b in batches:
        for conv, formatted, a, z in zip(*(T.column(b, c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if not started or conv != now:
                if started:
                    close()
                started, now, n, loss_n, chars, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = parse_turn(formatted)
            n, chars = n + 1, chars + len(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            said = unescape(formatted[a:z])
            loss_n += len(said)
            loss.update(said.encode())
        if len(out) > 5000:
            yield flush()
    if started:
        close()
    yield flush()


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted turns."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def row_records(conversations: DataFrame) -> DataFrame:
    """Turn rows as records of four layouts of single turns, mixed by a hash, as sources that were collected apart have them.

    Roles that the ``from`` layout would rename stay out of it.
    """
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))
    short = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    kind = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(4))
    plain = F.struct(conv, turn, role, text)
    nested = F.struct(F.struct(conv.alias("id"), turn).alias("conversation"), F.struct(role, text.alias("content")).alias("message"))
    named = F.struct(conv.alias("id"), turn.alias("index"), short.alias("from"), text.alias("value"))
    author = F.struct(conv.alias("thread"), turn.alias("position"), F.struct(role).alias("author"), F.struct(text).alias("content"))
    json_of = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    record = F.when(kind == 1, json_of(nested)).when((kind == 2) & ~F.coalesce(role.isin(*SHORT), F.lit(False)), json_of(named)).when(kind == 3, json_of(author)).otherwise(json_of(plain))
    return conversations.select("conv_id", record.alias("record"))
