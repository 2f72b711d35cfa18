"""Chat formatting: schema fingerprints select declarative mappings from heterogeneous records to canonical turns.

A record is a JSON object.  Its fingerprint is a hash of its sorted nested field paths (list positions left out), so
all records of one layout share it.  `LAYOUTS` maps the fingerprint of each known layout to a rule: either a list of
turns at a path with a role and a text field, or an ordered list of (role, path) pairs.

The template writes a turn as `### role`, a line feed, the text, `</turn>` and a line feed.  Inside roles and texts a
backslash escapes itself, `#` and `<` (and a line feed in a role), so control strings cannot occur in them and the
turns read back exactly.  The loss mask is the spans (code points) of the assistants' texts in the formatted string.

Defined cases: null records, other JSON than objects and unknown layouts get a null `formatted` and no turns, with
their fingerprint (null if there is none) for a report; empty turn lists format as the empty string; null roles and texts read as empty;
fields of a single-turn rule that are empty are left out except the last; repeated rows get equal results; other
columns pass through, whatever their names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .columns import kept, spare

#: The layouts.  "each": path of the list, role field, text field; "turns": (role, path) in order.
LAYOUTS = (
    {"name": "messages", "paths": ("messages[].role", "messages[].content"), "each": ("messages", "role", "content")},
    {"name": "system and messages", "paths": ("system", "messages[].role", "messages[].content"), "first": ("system", "system"), "each": ("messages", "role", "content")},
    {"name": "from and value", "paths": ("conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    {"name": "id, from and value", "paths": ("id", "conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    {"name": "turns", "paths": ("turns[].role", "turns[].text"), "each": ("turns", "role", "text")},
    {"name": "nested data", "paths": ("data.messages[].role", "data.messages[].content"), "each": ("data.messages", "role", "content")},
    {"name": "instruction and output", "paths": ("instruction", "output"), "turns": (("user", "instruction"), ("assistant", "output"))},
    {"name": "instruction, input and output", "paths": ("instruction", "input", "output"), "turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"name": "prompt and completion", "paths": ("prompt", "completion"), "turns": (("user", "prompt"), ("assistant", "completion"))},
    {"name": "prompt and response", "paths": ("prompt", "response"), "turns": (("user", "prompt"), ("assistant", "response"))},
    {"name": "system, prompt and response", "paths": ("system", "prompt", "response"), "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    {"name": "question and answer", "paths": ("question", "answer"), "turns": (("user", "question"), ("assistant", "answer"))},
    {"name": "nested prompt", "paths": ("input.prompt", "output.text"), "turns": (("user", "input.prompt"), ("assistant", "output.text"))},
)
#: Other names of the roles, used for layouts with a `from` field.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
ASSISTANT = "assistant"

Turn = tuple[str, str]


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """Paths of the leaves; a list adds [] once, and an empty list or object is a leaf itself."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterator[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _registry(layouts: tuple[dict, ...]) -> dict[str, dict]:
    out = {}
    for x in layouts:
        out[fingerprint(x["paths"])] = x
        if "each" in x:  # without turns, the list is the leaf
            path = x["each"][0]
            out.setdefault(fingerprint(tuple(p for p in x["paths"] if not p.startswith(f"{path}[]")) + (path,)), x)
    return out


REGISTRY = _registry(LAYOUTS)


def _at(value: object, path: str) -> object:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: object, registry: dict[str, dict] = REGISTRY) -> tuple[str | None, str | None, list[Turn] | None]:
    """Fingerprint, layout and turns of a parsed record."""
    if not isinstance(record, dict) or not record:
        return None, None, None
    mark = fingerprint(field_paths(record))
    rule = registry.get(mark)
    if rule is None:
        return mark, None, None
    turns: list[Turn] = []
    if "each" in rule:
        path, role, text = rule["each"]
        if "first" in rule and _text(_at(record, rule["first"][1])):
            turns.append((rule["first"][0], _text(_at(record, rule["first"][1]))))
        for t in _at(record, path) or []:
            name = _text(t.get(role))
            turns.append((ROLES.get(name, name) if role == "from" else name, _text(t.get(text))))
    else:
        last = len(rule["turns"]) - 1
        turns += [(r, _text(_at(record, p))) for i, (r, p) in enumerate(rule["turns"]) if i == last or _text(_at(record, p))]
    return mark, rule["name"], turns


def _escape(s: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", r"\\\g<0>", s)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {_escape(role, chr(10))}\n", _escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}</turn>\n"
        out.append(part)
        at += len(part)
    return "".join(out), spans


_TURN = re.compile(r"### ([^\\#<\n]*(?:\\.[^\\#<\n]*)*)\n([^\\#<]*(?:\\.[^\\#<]*)*)</turn>\n", re.S)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted string; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_unescape(m[1]), _unescape(m[2])))
        at = m.end()
    return turns


def masked(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(_unescape(formatted[a:b]) for a, b in spans)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FORMATTED = "fingerprint string, layout string, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"


def format_batch(records: pa.Array) -> pa.StructArray:
    cols: list[list] = [[], [], [], [], []]
    for s in records.to_pylist():
        try:
            mark, layout, turns = canonical(json.loads(s)) if s is not None else (None, None, None)
        except ValueError:
            mark = layout = turns = None
        text, spans = render(turns) if turns is not None else (None, None)
        for c, v in zip(cols, (mark, layout, None if turns is None else len(turns), text, spans and [{"start": a, "end": b} for a, b in spans]), strict=True):
            c.append(v if v is not None or c is not cols[4] else [])
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(SPAN))
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["fingerprint", "layout", "n_turns", "formatted", "loss_spans"])


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """`records` with fingerprint, layout, n_turns, formatted and loss_spans."""
    own = kept(records, ("fingerprint", "layout", "n_turns", "formatted", "loss_spans"))

    def f(col: pa.Array) -> pa.Array:
        return format_batch(col)

    mark = spare(records, "chat")
    return records.select(*own, arrow_udf(f, FORMATTED).asNondeterministic()(F.col(f"`{record_col}`")).alias(mark)).select(*own, f"{mark}.*")


def read_back(formatted: Column, spans: Column) -> Column:
    """struct(n_turns, turns_text, loss_text) read from the output; turns_text is role, line feed, text, line feed for each turn."""

    def f(text: pa.Array, loss: pa.Array) -> pa.Array:
        n, all_text, masks = [], [], []
        for s, m in zip(text.to_pylist(), loss.to_pylist(), strict=True):
            turns = parse(s or "")
            n.append(len(turns))
            all_text.append("".join(f"{r}\n{t}\n" for r, t in turns))
            masks.append(masked(s or "", [(x["start"], x["end"]) for x in m or []]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(all_text, pa.string()), pa.array(masks, pa.string())], ["n_turns", "turns_text", "loss_text"])

    return arrow_udf(f, "n_turns bigint, turns_text string, loss_text string").asNondeterministic()(formatted, spans)


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One `messages` record for each conversation of a table with a row for each turn; rows that tie go by role, then text.

    A conversation is one training example and becomes one string, so its rows meet in one group; the table's rows
    as a whole are dealt by conversation.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content"))
    grouped = rows.select(F.col(f"`{id_col}`").alias(id_col), turn.alias("t")).groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select(id_col, F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("messages"))).alias("record"))


def sql(odd_text: str, table: str = "conversations") -> str:
    """For DuckDB, what reading back the formatted conversations must give, and how long they are."""
    odd = "'" + odd_text.replace("'", "''") + "'"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM {table}
   UNION ALL SELECT -7, 0, 'user', {odd} UNION ALL SELECT -7, 1, 'assistant', {odd}),
 chats AS (SELECT conv_id, count(*) AS n_turns, string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text) AS said,
   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'), '') AS loss,
   sum(13+length(regexp_replace(role, '[\\\\#<\\n]', 'xx', 'g'))+length(regexp_replace(text, '[\\\\#<]', 'xx', 'g')))::bigint AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats"""
