"""Chat formatting by schema fingerprints, with built-in functions only.

A record arrives as a VARIANT. The set of its nested field paths, without scalar types and without paths that no layout
declares, is hashed; the hash selects one of the declared layouts, whose mapping turns the record into canonical turns
(role, text). A template then marks the turns and escapes control strings inside roles and texts reversibly, and a loss mask
covers the assistant texts.

Defined results: a null or malformed record, and one whose fingerprint no layout declares, has a null layout, null turns
and null formatted text and stays in the output; null roles and texts are empty strings; a record of a layout's list
without turns has empty formatted text; repeated rows are each formatted for themselves; very long texts are formatted
whole, a conversation within the limits of one VARIANT (128 MB); turns that tie are ordered by role, then text. Other columns
pass through, whatever their names: the operator's own columns replace columns of the same names. An empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.names import unused

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

#: A name with its colon, an opening or closing bracket, or a scalar type of a type skeleton.
_TOKEN = r"(?:`(?:[^`]++|``)*+`|[^<>,:`() ]++): |OBJECT<|ARRAY<|>|[A-Z_]++(?:\([0-9, ]++\))?"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: its nested field paths, `[]` for the elements of an array. turns: SQL over the record `r`, giving an array
    of structs of a role and a text. roles: names to replace, by lower-cased name."""

    name: str
    paths: tuple[str, ...]
    turns: str
    roles: dict[str, str] = field(default_factory=dict)


def _list_of(path: str, role: str, text: str) -> str:
    return f"transform(try_variant_get(r, '{path}', 'array<struct<{role}:string,{text}:string>>'), x -> struct(x.{role} AS role, x.{text} AS text))"


def _none_of(path: str) -> str:
    """No turns if the list is empty; a list of other things than turns gives null."""
    return f"CASE WHEN size(try_variant_get(r, '{path}', 'array<variant>')) = 0 THEN cast(array() AS {_TURNS}) END"


def _turn(role: str, text: str) -> str:
    return f"struct('{role}' AS role, {text} AS text)"


def _get(name: str) -> str:
    return f"try_variant_get(r, '$.{name}', 'string')"


_HUMAN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _list_of("$.messages", "role", "content")),
    Layout("bare_messages", ("[].content", "[].role"), _list_of("$", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _list_of("$.conversations", "`from`", "value"), _HUMAN),
    Layout("no_messages", ("messages[]",), _none_of("$.messages")),
    Layout("no_bare_messages", ("[]",), _none_of("$")),
    Layout("no_from_value", ("conversations[]",), _none_of("$.conversations")),
    Layout("instruction", ("instruction", "output"), f"array({_turn('user', _get('instruction'))}, {_turn('assistant', _get('output'))})"),
    Layout(
        "instruction_input",
        ("input", "instruction", "output"),
        f"array({_turn('user', "concat_ws('\n\n', nullif(" + _get('instruction') + ", ''), nullif(" + _get('input') + ", ''))")}, {_turn('assistant', _get('output'))})",
    ),
    Layout("prompt_response", ("prompt", "response"), f"array({_turn('user', _get('prompt'))}, {_turn('assistant', _get('response'))})"),
    Layout("prompt_completion", ("completion", "prompt"), f"array({_turn('user', _get('prompt'))}, {_turn('assistant', _get('completion'))})"),
)


def leaf_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({path for x in layouts for path in x.paths})


def _print_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fingerprint(record: Column, known: list[str]) -> Column:
    """Hash of those nested paths of a variant that end in a scalar, a null or an empty list and that some layout declares,
    at any depth; other paths do not matter, whatever lies below them.

    The type skeleton is read once from left to right: the names and brackets on the way to a value are its path."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), F.lit(0))
    begin = F.struct(F.expr("array('')").alias("open"), F.lit("").alias("at"), F.expr("cast(array() as array<string>)").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        outer = F.element_at(acc["open"], -1)
        name = F.concat(F.when(outer == "", "").otherwise(F.concat(outer, F.lit("."))), F.rtrim(F.rtrim(token), F.lit(":")))
        items = F.concat(acc["at"], F.lit("[]"))
        leaf = F.array_contains(F.lit(known), acc["at"]) & (token != "VARIANT")
        keep = lambda open=acc["open"], at=acc["at"], found=acc["found"]: F.struct(open.alias("open"), at.alias("at"), found.alias("found"))
        return (
            F.when(token == "OBJECT<", keep(open=F.array_append(acc["open"], acc["at"])))
            .when(token == "ARRAY<", keep(open=F.array_append(acc["open"], acc["at"]), at=items))
            .when(token == ">", keep(open=F.slice(acc["open"], 1, F.size(acc["open"]) - 1)))
            .when(F.endswith(token, F.lit(": ")), keep(at=name))
            .when(leaf, keep(found=F.array_append(acc["found"], acc["at"])))
            .otherwise(acc)
        )

    return _print_of(F.aggregate(tokens, begin, step, lambda acc: acc["found"]))


def escape(text: Column) -> Column:
    r"""Puts one more backslash between every `<` and the `|` that follows it, whatever backslashes stand between."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def _cleaner(names: dict[str, str]):
    roles = F.create_map(*[F.lit(y) for pair in names.items() for y in pair]) if names else None

    def clean(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        role = role if roles is None else F.coalesce(F.element_at(roles, F.lower(role)), role)
        return F.struct(role.alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return clean


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `layout` and `turns` to df, by the fingerprint of the variant column `record`."""
    (mark,) = unused(df, "_print")
    print_of = F.col(mark)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for x in reversed(layouts):
        found = F.expr(x.turns.replace("(r,", f"(`{record}`,"))
        is_it = print_of == _print_of(F.lit(list(x.paths)))
        layout = F.when(is_it, F.lit(x.name)).otherwise(layout)
        turns = F.when(is_it, F.transform(found, _cleaner(x.roles))).otherwise(turns)
    known = df.withColumn(mark, fingerprint(F.col(record), leaf_paths(layouts)))
    return known.withColumns({"layout": layout, "turns": turns}).drop(mark)


def format_chat(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `layout`, `turns`, `formatted` and `loss_mask`.

    loss_mask has an entry for each turn: the code points of the formatted turn, its start mark included, that come
    before the loss, and those under it (none unless the turn is an assistant's).
    """
    (shaped,) = unused(df, "_marked")
    marked = canonical_turns(df, record, layouts).withColumn(
        shaped,
        F.transform("turns", lambda t: F.struct(_escape_role(t["role"]).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))),
    )
    formatted = F.array_join(F.transform(shaped, lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t["body"], F.lit(END + "\n"))), "")
    mask = F.transform(
        shaped,
        lambda t: F.struct((F.char_length(t["head"]) + len(START) + 1).alias("skip"), F.when(t["loss"], F.char_length(t["body"])).otherwise(0).alias("take")),
    )
    return marked.withColumns({"formatted": formatted, "loss_mask": mask}).drop(shaped)


def read_back(df: DataFrame) -> DataFrame:
    """Adds `read_turns` and `loss_text`, parsed from `formatted` and `loss_mask` alone."""
    (held,) = unused(df, "_pieces")
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.char_length(head) + 2, F.char_length(x) - F.char_length(head) - len(END) - 2)
        return F.struct(_unescape_role(head).alias("role"), unescape(body).alias("text"))

    def under_loss(x: Column, m: Column) -> Column:
        return F.when(m["take"] > 0, unescape(F.substr(x, m["skip"] + 1 - len(START), m["take"]))).otherwise("")

    parsed = df.withColumn(held, pieces)
    return parsed.withColumns({"read_turns": F.transform(held, turn), "loss_text": F.array_join(F.zip_with(held, "loss_mask", under_loss), "")}).drop(held)


def conversations_as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation by turn, ties by role and text, as one variant of the messages
    layout. Rows without a conv_id are one conversation, of the null id."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
