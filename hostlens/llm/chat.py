"""Chat formatting of heterogeneous records, chosen by their schema's fingerprint.

A record's nested field paths (its shape, without scalar types) are hashed; the
fingerprint selects a declarative ``Layout`` that says where the turns are:
a list of messages, or single fields with a role each.  The mapping turns a
record into canonical turns (role, text), which one template formats:

    <|im_start|>role \\n text <|im_end|> \\n

Control strings inside texts are escaped reversibly: every ``<``, any number of
``~``, ``|`` gets one ``~`` more, so no escaped text holds ``<|``, and taking one
``~`` away restores it.  A line end in a role is written ``<|n|>``.  The loss
mask is a list of runs (characters, in the loss or not) over the formatted text;
the texts of assistant turns are in the loss, nothing else.  All of it is
DataFrame expressions.

Defined results: a record of an unknown shape, or null, has a null layout and
null turns and formats to null; null role or text is empty; turns keep their
order, also in ties and repeats; a record without turns formats to the empty
text; ``canonical_turns`` returns the key and its own columns only, so other
columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ROLE_END = "\n"
TURNS = "array<struct<role:string,text:string>>"
#: Names that layouts use for the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``messages``: (list field, role field, text field); the text may be a list of
    parts with a field ``text`` (``parts``).  ``fields``: (role, field) pairs in
    turn order; fields of the same role in a row are joined by ``joiner`` and
    empty ones left out.  ``optional`` top-level fields and ``extra`` message
    fields may be there or not.
    """
    name: str
    messages: tuple[str, str, str] | None = None
    parts: bool = False
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    joiner: str = "\n\n"

    def shapes(self) -> list[str]:
        """Shapes of the records that this layout reads."""
        system = ["system"] if self.messages else []
        free = [x for x in (*self.optional, *system) if x not in {f for _, f in self.fields} or x in self.optional]
        fixed = [f for _, f in self.fields if f not in self.optional]
        out = []
        for n in range(len(free) + 1):
            for some in combinations(free, n):
                if not self.messages:
                    out.append(_object({f: "_" for f in (*fixed, *some)}))
                    continue
                lst, role, text = self.messages
                for k in range(len(self.extra) + 1):
                    for more in combinations(self.extra, k):
                        body = "ARRAY<OBJECT<text: _, type: _>>" if self.parts else "_"
                        item = _object({role: "_", text: body, **{m: "_" for m in more}})
                        out.append(_object({lst: f"ARRAY<{item}>", **{s: "_" for s in some}}))
                out.append(_object({lst: "ARRAY<_>", **{s: "_" for s in some}}))
        return sorted(set(out))

    def turns(self, record: Column) -> Column:
        def text_at(path: str) -> Column:
            return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))

        if self.messages:
            lst, role, text = self.messages
            kind = "array<struct<text:string>>" if self.parts else "string"
            items = F.coalesce(F.try_variant_get(record, f"$.{lst}", f"array<struct<`{role}`:string,`{text}`:{kind}>>"),
                               F.lit(None).cast(f"array<struct<`{role}`:string,`{text}`:{kind}>>"), F.array().cast(f"array<struct<`{role}`:string,`{text}`:{kind}>>"))

            def body(m: Column) -> Column:
                return F.array_join(F.transform(m[text], lambda p: F.coalesce(p["text"], F.lit(""))), "") if self.parts else m[text]

            turns = F.transform(items, lambda m: _turn(_role(m[role]), body(m)))
            head = text_at("system")
            return F.concat(F.filter(F.array(_turn(F.lit("system"), head)), lambda t: t["text"] != ""), turns)
        groups: list[tuple[str, list[str]]] = []
        for role, name in self.fields:
            if groups and groups[-1][0] == role:
                groups[-1][1].append(name)
            else:
                groups.append((role, [name]))
        made = [_turn(F.lit(role), F.array_join(F.filter(F.array(*[text_at(n) for n in names]), lambda x: x != ""), self.joiner))
                for role, names in groups]
        # a system or user part that is not there makes no turn; the answer always does
        return F.filter(F.array(*made), lambda t: (t["text"] != "") | (t["role"] == "assistant"))


#: The layouts that are known; more can be passed to ``canonical_turns``.
LAYOUTS = (
    Layout("messages", messages=("messages", "role", "content"), optional=("id",), extra=("name",)),
    Layout("message parts", messages=("messages", "role", "content"), parts=True, optional=("id",)),
    Layout("turns", messages=("turns", "role", "text"), optional=("id",), extra=("turn",)),
    Layout("conversations", messages=("conversations", "from", "value"), optional=("id",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input", "id")),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion")), optional=("id",)),
    Layout("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system", "id")),
    Layout("question and answer", fields=(("user", "context"), ("user", "question"), ("assistant", "answer")), optional=("context", "id")),
)


def _object(fields: dict[str, str]) -> str:
    return "OBJECT<" + ", ".join(f"{k}: {v}" for k, v in sorted(fields.items())) + ">"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(role, F.lit(""))), role)


def shape(record: Column) -> Column:
    """The nested field paths of a variant as text; scalars are ``_``."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]*\))?(?=[,>]|$)", "_")


def fingerprint(shape_text: Column) -> Column:
    return F.xxhash64(shape_text)


def canonical_turns(records: DataFrame, key: Column, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, turns) of each record, a variant; earlier layouts win."""
    shapes: dict[str, str] = {}
    for layout in layouts:
        for s in layout.shapes():
            shapes.setdefault(s, layout.name)
    rows = records.select(key.alias("key"), record.alias("record")).withColumn("shape", shape(F.col("record")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("shape")))
    layout_name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        mine = F.col("fingerprint").isin(*[fingerprint(F.lit(s)) for s, n in shapes.items() if n == layout.name])
        layout_name = F.when(mine, F.lit(layout.name)).otherwise(layout_name)
        turns = F.when(mine, layout.turns(F.col("record"))).otherwise(turns)
    return rows.select("key", "fingerprint", layout_name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<~$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", "<$1|")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("<|n|>")), F.lit(ROLE_END))


def formatted(turns: Column) -> Column:
    """The text of canonical turns under the template."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), escaped(t["text"]), F.lit(END + "\n"))), "")


def loss_runs(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Runs over the formatted text, three per turn: head, text, end marker."""
    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    return F.flatten(F.transform(turns, lambda t: F.array(
        run(F.length(_head(t)), F.lit(False)), run(F.length(escaped(t["text"])), t["role"].isin(*roles)),
        run(F.lit(len(END) + 1), F.lit(False)))))


def read_back(text: Column) -> Column:
    """Canonical turns of a formatted text."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ROLE_END, 1)
        rest = piece.substr(F.length(role) + 2, F.length(piece))
        role = F.replace(role.substr(F.lit(len(START) + 1), F.length(role)), F.lit("<|n|>"), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(rest).alias("text"))

    pieces = F.split(text, F.lit(r"<\|im_end\|>\n"), -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def under_loss(text: Column, runs: Column) -> Column:
    """The unescaped texts of a formatted text that its runs put in the loss, in order."""
    pieces = F.split(text, F.lit(r"<\|im_end\|>\n"), -1)
    texts = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(
        F.get(runs, 3 * i + 1)["loss"], F.get(pieces, i).substr(F.get(runs, 3 * i)["chars"].cast("int") + 1, F.get(runs, 3 * i + 1)["chars"].cast("int"))))
    return F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: unescaped(t))


def rows_to_records(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): one variant with a list of messages per conversation, ordered by
    turn (null last), then role and text.  A conversation is one record by nature."""
    item = F.struct(F.col(turn_col).isNull().alias("none"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                    F.col(text_col).cast("string").alias("content"))
    lists = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    return lists.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(records: DataFrame, key: Column, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, turns, formatted, loss_runs) of each record."""
    return (canonical_turns(records, key, record, layouts)
            .withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_runs", loss_runs(F.col("turns"))))
