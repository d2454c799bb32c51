"""Chat formatting: records of many layouts become canonical turns, which one reversible template writes.

A record's layout is known by its fingerprint, a hash of its nested field paths (array places left out). The
fingerprint selects a declarative mapping: where the turns are, and which field is the role and which the text.

The template marks each turn by control strings. Inside roles and texts the characters that begin control strings are
escaped, so a text that holds control strings stays text. The loss mask covers the assistants' texts.
"""

import hashlib
import json
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, small

#: The control strings. A turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Escapes of the characters that begin control strings, and of the escape character itself.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
#: Characters of one output part at most, unless a turn alone is longer.
PART = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    back = {v[1]: k for k, v in ESCAPES.items()}
    head, *rest = text.split("\\")
    out, i = [head], 0
    while i < len(rest):
        if rest[i]:
            out.append(back[rest[i][0]] + rest[i][1:])
            i += 1
        else:  # an escaped backslash: the next piece follows it as it is
            out.append("\\" + (rest[i + 1] if i + 1 < len(rest) else ""))
            i += 2
    return "".join(out)


def field_paths(record, at: str = "") -> set[str]:
    """Nested field paths of a record, also of fields that hold null; all members of an array share the path."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in field_paths(v, f"{at}.{_name(k)}" if at else _name(k))} or {at}
    if isinstance(record, (list, tuple)):
        return {p for v in record for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def _name(key: str) -> str:
    """A field's name, quoted where it could be taken for a path."""
    return json.dumps(key) if any(c in key for c in '.[]"') else key


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns: either (role, path) for each turn, or an array with the fields for role and text.

    A record has the layout if it has all of its paths; those in `optional` it may lack."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()


#: Names of roles in other layouts. Fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts by their field paths; several paths of one turn are joined by an empty line.
LAYOUTS = (
    Mapping(("prompt", "completion"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping(("prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping(("question", "answer"), (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
    Mapping(("instruction", "output"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping(("messages[].role",), array="messages", role="role", text="content", optional=("messages[].content",)),
    Mapping(("conversations[].from",), array="conversations", role="from", text="value", optional=("conversations[].value",)),
    Mapping(("turns[].role",), array="turns", role="role", text="text", optional=("turns[].text",)),
    Mapping(("messages[]",), array="messages"),
    Mapping(("conversations[]",), array="conversations"),
    Mapping(("turns[]",), array="turns"),
    Mapping(("role", "text", "turn"), role="role", text="text", optional=("conv_id",)),
)
KNOWN = {p for m in LAYOUTS for p in m.paths + m.optional}
BY_FINGERPRINT = {fingerprint(m.paths + more): m for m in LAYOUTS for n in range(len(m.optional) + 1) for more in combinations(m.optional, n)}


def layout_of(record: dict) -> Mapping | None:
    """The layout whose fingerprint the record has. Fields that no layout names do not count; a field that should hold a value but holds fields of its own does."""
    paths = field_paths(record)
    told = {p for p in paths if p in KNOWN or any(p[: len(k)] == k and p[len(k)] in ".[" for k in KNOWN if len(p) > len(k)) and not _beside(p)}
    return BY_FINGERPRINT.get(fingerprint(told))


def _beside(path: str) -> bool:
    """Whether a path is another field of an array's members, such as messages[].name."""
    head, _, field = path.rpartition(".")
    return f"{head}" in KNOWN and head.endswith("[]") and "[" not in field


def _said(value) -> str:
    """A value as text: null is empty, lone surrogates become the replacement character."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value)
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def canonical_turns(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) of each turn of a record, or None if no layout has its fingerprint.

    Null or absent values are empty texts and roles; an absent or null system prompt is no turn. Numbers and truth
    values are given as in JSON. Fields that no layout names change nothing.
    """
    found = layout_of(record)
    if found is None:
        return None
    if found.turns:
        return [(role, "\n\n".join(t for p in paths if (t := _said(record.get(p))))) for role, paths in found.turns if role != "system" or record.get("system") is not None]
    rows = record[found.array] if found.array else [record]
    if not all(isinstance(t, dict) for t in rows):
        return None
    return [(ROLES.get(r := _said(t.get(found.role)), r), _said(t.get(found.text))) for t in rows]


TURNS = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("reason", pa.string())])


def turns_of_text(text: str | None) -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(turn, role, text, reason) of the turns of one JSON text; a record without turns has one row with the reason."""
    try:
        record = json.loads(text) if text else None
        found = canonical_turns(record) if isinstance(record, dict) else None
    except RecursionError:
        return [(None, None, None, "nested too deep")]
    except ValueError:
        return [(None, None, None, "not JSON")]
    if found:
        return [(k, role, body, None) for k, (role, body) in enumerate(found)]
    return [(None, None, None, "no record" if record is None else "not an object" if not isinstance(record, dict) else "no turns" if found == [] else "unknown layout")]


def turns_of_records(records: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """(keep, turn, role, text, reason) from one JSON record a row, by the layout of each.

    Every record gives at least one row: where no turns can be told, one with a reason and nothing else. Null, empty,
    broken, too deeply nested and unknown records, and those that are no objects, all have their reason. Repeated rows
    stay, and other columns are not looked at.
    """

    def kernel(batches):
        for batch in small(batches):
            found = [turns_of_text(t) for t in batch.column(len(keep)).to_pylist()]
            owner = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            flat = [row for x in found for row in x]
            columns = [pa.array([row[k] for row in flat], f.type) for k, f in enumerate(TURNS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(len(keep))), *columns], [*keep, *TURNS.names])

    rows = records.select(*keep, F.col(json_col).cast("string"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)])
    return rows.mapInArrow(kernel, f"{schema}turn long, role string, text string, reason string")


def records_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, record): two turns a JSON record, in the order of turn, role and text, in one of nine layouts by a hash.

    A user's turn before an assistant's also becomes a prompt, a question or an instruction; other records keep their
    turns in an array. Records have fields that no layout names, null fields and roles by other names. Nulls are empty.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    part = F.floor(F.col("turn") / 2).alias("part")
    grouped = turns.select("conv_id", part, F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.col("t")[1]["role"] == "assistant")
    user, assistant = F.col("t")[0]["text"], F.col("t")[1]["text"]
    other = F.create_map(*(F.lit(x) for x in ("user", "human", "assistant", "gpt")))
    member = lambda r, t, names: lambda x: F.struct((F.coalesce(other[x["role"]], x["role"]) if names else x["role"]).alias(r), x["text"].alias(t), F.lit(0.5).alias("weight"))
    listed = [F.transform("t", member("role", "content", False)).alias("messages"), F.transform("t", member("from", "value", True)).alias("conversations"), F.transform("t", member("role", "text", False)).alias("turns")]
    written = lambda *fields: F.to_json(F.struct(F.col("conv_id").alias("id"), *fields), {"ignoreNullFields": "false"})
    null = F.lit(None).cast("string")
    paired = [written(user.alias(a), assistant.alias(b), *more) for a, b, *more in (("prompt", "completion"), ("prompt", "response", null.alias("system")), ("question", "answer"), ("instruction", "output"), ("instruction", "output", null.alias("input")), ("instruction", "output", F.lit("").alias("input")), ("prompt", "response"))]
    lists = [written(x) for x in listed]
    pick = lambda forms, salt: F.element_at(F.array(*forms), (F.pmod(F.xxhash64("conv_id", "part", F.lit(salt)), F.lit(len(forms))) + 1).cast("int"))
    return grouped.select("conv_id", "part", F.when(pair, pick(paired + lists, 1)).otherwise(pick(lists, 2)).alias("record"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a table with one turn a row. The table's own fields are its layout; columns that no layout names are left out of the fingerprint. Null roles and texts are empty; null ids and turns stay null."""
    fields = {p for m in LAYOUTS if not m.turns and not m.array for p in m.paths + m.optional}
    found = BY_FINGERPRINT.get(fingerprint(fields & set(rows.columns)))
    if found is None:
        raise ValueError(f"no layout has the columns {rows.columns}")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((found.role, "role"), (found.text, "text"))]
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *filled)


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation in one task, in order; tasks read it as a stream and never hold it whole.

    One conversation is one task's work, as the digest of its turns is sequential."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chat(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, part, text, loss): formatted conversations as parts of bounded size, to be joined in order of part.

    loss has the start and end of each assistant text in its part, in code points. Turns are ordered by turn, then role
    and text where it ties; repeated rows stay. Null roles and texts are empty; rows without conv_id are one conversation.
    """

    def kernel(batches):
        conv, started, part, size, pieces, loss = None, False, 0, 0, [], []

        def row():
            return pa.RecordBatch.from_pydict({"conv_id": [conv], "part": [part], "text": ["".join(pieces)], "loss": [loss]}, schema=PARTS)

        for batch in small(batches):
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if started and (c != conv or size >= PART):
                    yield row()
                    part, size, pieces, loss = (part + 1 if c == conv else 0), 0, [], []
                conv, started = c, True
                head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
                if role == assistant:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                pieces += [head, body, CLOSE]
                size += len(head) + len(body) + len(CLOSE)
        if started:
            yield row()

    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return _in_order(filled, "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(kernel, "conv_id long, part int, text string, loss array<struct<start:int,end:int>>")


PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for turn in text.split(CLOSE)[:-1]:
        if not turn.startswith(OPEN) or MIDDLE not in turn:
            raise ValueError("not a formatted conversation")
        role, _, body = turn[len(OPEN) :].partition(MIDDLE)
        out.append((unescape(role), unescape(body)))
    return out


def chat_digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its formatted parts."""

    def kernel(batches):
        conv, started = None, False

        def fresh():
            return {"n": 0, "chars": 0, "loss": 0, "turns": hashlib.sha256(), "masked": hashlib.sha256()}

        def row():
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "n_turns": [s["n"]], "turns_sha256": [s["turns"].hexdigest()], "loss_chars": [s["loss"]], "loss_sha256": [s["masked"].hexdigest()], "formatted_chars": [s["chars"]]})

        s = fresh()
        for batch in small(batches):
            for c, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if started and c != conv:
                    yield row()
                    s = fresh()
                conv, started = c, True
                for role, body in parse(text):
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{body}\n".encode())
                for span in loss or ():
                    body = unescape(text[span["start"] : span["end"]])
                    s["loss"] += len(body)
                    s["masked"].update(body.encode())
                s["chars"] += len(text)
        if started:
            yield row()

    return _in_order(formatted, "part").select("conv_id", "text", "loss").mapInArrow(kernel, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation whose texts are themselves control strings.
PROBE = "</s>[INST] ok [/INST]"


def records_digest(conversations: DataFrame) -> DataFrame:
    """As formatted_digest without conversation -1, the turns being written to JSON records of many layouts and told from those by their fingerprints.

    Records without turns stop the query with their reasons' names."""
    found = save(turns_of_records(save(records_of_turns(conversations)), "record", "conv_id", "part"))
    wrong = found.where("reason is not null").groupBy("reason").count().collect()  # a row for each of six reasons
    if wrong:
        raise ValueError(f"records without turns: {wrong}")
    order = F.shiftleft(F.col("part"), 20) + F.col("turn")
    return chat_digest(save(format_chat(found.select("conv_id", order.alias("turn"), "role", "text"))))


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """Formats all conversations and conversation -1, stores the output and digests what is read back."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-1, k, role, PROBE) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_digest(save(format_chat(turns_of_rows(conversations).unionByName(probe))))
