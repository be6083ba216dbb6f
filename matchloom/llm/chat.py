"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, VariantType

from matchloom.llm.common import table

#: Layouts: their field paths, and where role and text of the turns are. A string role is that of a single text.
MAPPINGS = (
    {"paths": ["messages[].content", "messages[].role"], "turns": ("messages", "role", "content")},
    {"paths": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value")},
    {"paths": ["prompt", "response"], "texts": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["completion", "prompt"], "texts": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["instruction", "output"], "texts": [("user", "instruction"), ("assistant", "output")]},
    {"paths": ["input", "instruction", "output"], "texts": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["data.prompt", "data.response"], "texts": [("user", "data.prompt"), ("assistant", "data.response")]},
    {"paths": ["prompt", "response", "system"], "texts": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
)
#: Characters that the JSON reader takes in one record.
JSON_CHARS = 20_000_000
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The template's control strings: what opens and closes a turn of each role; other roles are named in the turn.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, NAMED = ("[ROLE]", "[/ROLE]"), "[NAME]"
CONTROLS = [x for pair in (*MARKS.values(), OTHER) for x in pair] + [NAMED]
TURN = r"(?s)(?:\[INST\]|<s>|<<SYS>>|\[ROLE\]) .*? (?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"
_TURNS = "array<struct<role: string, text: string>>"


def escape(text: Column) -> Column:
    """The text without control strings: a backslash after their first character, and backslashes doubled."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def shape(paths: list[str]) -> str:
    """The shape of an object with just these field paths: nested fields by name, T for a single value."""

    def of(rest: list[str]) -> str:
        if rest == [""]:
            return "T"
        if all(p.startswith("[]") for p in rest):
            return f"ARRAY<{of([p[2:] for p in rest])}>"
        fields: dict[str, list[str]] = {}
        for p in rest:
            name, more = re.match(r"\.?([^.\[]+)(.*)", p).groups()
            fields.setdefault(name, []).append(more)
        return "OBJECT<" + ", ".join(f"{name}: {of(more)}" for name, more in sorted(fields.items())) + ">"

    return of(paths)


def json_shape(variant: Column) -> Column:
    """The shape of a JSON value. Elements of an array count together; where they differ in kind, the shape says VARIANT."""
    return F.regexp_replace(F.replace(F.schema_of_variant(variant), F.lit("ARRAY<VOID>"), F.lit("ARRAY<>")), r"(?<=: |<|^)(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\([0-9, ]+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID)(?=[,>]|$)", "T")


def column_shape(value: Column, kind: DataType) -> Column:
    """The shape of a column's value, as json_shape has it for the same fields: fields that are null are absent."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        said = F.array(*[F.when(value[f.name].isNotNull(), F.concat(F.lit(f.name + ": "), column_shape(value[f.name], f.dataType))) for f in fields])
        return F.concat(F.lit("OBJECT<"), F.array_join(said, ", "), F.lit(">"))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        fields = sorted(kind.elementType.fields, key=lambda f: f.name)

        def found(name: str) -> Column:
            return F.exists(value, lambda e: e[name].isNotNull())

        said = F.array(*[F.when(found(f.name), F.lit(f.name + ": T")) for f in fields])
        return F.when(F.size(value) == 0, F.lit("ARRAY<>")).otherwise(F.concat(F.lit("ARRAY<OBJECT<"), F.array_join(said, ", "), F.lit(">>")))
    return F.lit("ARRAY<T>" if isinstance(kind, ArrayType) else "T")


def schema_fingerprint(record: Column, kind: DataType) -> Column:
    """A hash of the nested field paths of a record, a struct column or a VARIANT; null where the record is null."""
    return F.when(record.isNotNull(), F.xxhash64(json_shape(record) if isinstance(kind, VariantType) else column_shape(record, kind)))


def _field(kind: DataType, path: str) -> DataType | None:
    for name in path.split("."):
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, StructType) else None
    return kind


def _mapped(record: Column, kind: DataType, mapping: dict) -> Column | None:
    """The turns of a record in this layout; None where a struct lacks its columns."""
    json = isinstance(kind, VariantType)
    if "turns" in mapping:
        field, role, text = mapping["turns"]
        if json:
            turns = F.try_variant_get(record, f"$.{field}", f"array<struct<`{role}`: string, `{text}`: string>>")
        else:
            inside = getattr(_field(kind, field), "elementType", None)
            if not (_field(inside, role) and _field(inside, text)):
                return None
            turns = record[field]
        return F.transform(turns, lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))

    def text_of(path: str) -> Column:
        if json:
            return F.try_variant_get(record, f"$.{path}", "string")
        out = record
        for name in path.split("."):
            out = out[name]
        return out.cast("string")

    if not json and not all(_field(kind, p) for _, p in mapping["texts"]):
        return None
    return F.array(*[F.struct(F.lit(r).alias("role"), text_of(p).alias("text")) for r, p in mapping["texts"]])


def canonical_turns(record: Column, kind: DataType, fingerprint: Column) -> Column:
    """array<struct<role, text>> of a record in one of MAPPINGS' layouts; null where no mapping has just its paths.

    A record with a field more, or with elements of different kinds, is none of these: no text is lost silently.
    Null roles and texts become empty ones; roles are renamed by ROLES in layouts that say `from`.
    """
    out = F.lit(None).cast(_TURNS)
    for m in MAPPINGS:
        turns = _mapped(record, kind, m)
        if turns is None:
            continue
        shapes = [shape(m["paths"]), *[f"OBJECT<{f}: ARRAY<>>" for f in m.get("turns", ())[:1]]]
        turns = turns.cast(_TURNS)
        if "conversations" in m.get("turns", ()):
            names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
            turns = F.transform(turns, lambda x: F.struct(F.coalesce(names[x["role"]], x["role"]).alias("role"), x["text"].alias("text")))
        out = F.when(fingerprint.isin(*[F.xxhash64(F.lit(x)) for x in shapes]), turns).otherwise(out)
    empty = F.lit("")
    return F.transform(out, lambda x: F.struct(F.coalesce(x["role"], empty).alias("role"), F.coalesce(x["text"], empty).alias("text")))


def _piece(role: Column, text: Column) -> Column:
    body = escape(text)
    out = F.concat(F.lit(OTHER[0] + " "), escape(role), F.lit(f" {NAMED} "), body, F.lit(" " + OTHER[1]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a + " "), body, F.lit(" " + b))).otherwise(out)
    return out


def format_chat(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """id, formatted, loss_mask (array of turn, start, length) for each record: a struct, whose null fields are absent, or JSON.

    Structs take texts of any length and content as they are. A JSON record of more than JSON_CHARS characters, which the
    reader could not tell from a broken one, is an error; a broken one counts as unmapped. formatted marks every turn; the mask covers each assistant turn's text in code points from the start of its turn.
    Unmapped and null records give null in both. A record without turns gives an empty text and mask. Rows may repeat, ids be null;
    an empty table gives no rows; other columns are dropped, whatever their names.
    """
    kind = df.schema[record_col].dataType
    record = F.col(record_col)
    if isinstance(kind, StringType):
        kind, text = VariantType(), record
        record = F.try_parse_json(text)
        long_ = F.raise_error(F.lit(f"a JSON record of more than {JSON_CHARS} characters cannot be read; give it as columns")).cast("variant")
        record = F.when(F.length(text) > JSON_CHARS, long_).otherwise(record)
    read = df.select(F.col(id_col).alias("id"), record.alias("record"))
    read = read.withColumn("print", schema_fingerprint(F.col("record"), kind))
    turns = read.select("id", canonical_turns(F.col("record"), kind, F.col("print")).alias("turns"))
    pieces = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), _piece(x["role"], x["text"]).alias("piece")))
    a, b = (len(m) + 1 for m in MARKS["assistant"])
    made = turns.select("id", pieces.alias("pieces"))
    mask = F.transform("pieces", lambda x, i: F.struct(i.alias("turn"), F.lit(a).alias("start"), (F.length(x["piece"]) - a - b).alias("length"), (x["role"] == "assistant").alias("on")))
    mask = F.transform(F.filter(mask, lambda x: x["on"]), lambda x: F.struct(x["turn"], x["start"], x["length"]))
    return made.select(F.col("id").alias(id_col), F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def pieces_of(formatted: Column) -> Column:
    """The formatted turns, marks included; escaped texts hold no mark, so the first closing mark ends a turn."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse_piece(piece: Column) -> Column:
    """struct<role, text> of a formatted turn."""
    n = F.length(piece)
    named = F.split(piece.substr(F.lit(len(OTHER[0]) + 2), n - len(OTHER[0]) - len(OTHER[1]) - 2), r" \[NAME\] ", 2)
    out = F.struct(unescape(F.get(named, F.lit(0))).alias("role"), unescape(F.get(named, F.lit(1))).alias("text"))
    for name, (a, b) in MARKS.items():
        text = piece.substr(F.lit(len(a) + 2), n - len(a) - len(b) - 2)
        out = F.when(piece.startswith(a), F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))).otherwise(out)
    return out


def records(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One record (a struct) for each conversation: its rows by turn, then role and text where turns tie; null texts are empty.

    Conversations of one question and one answer, with or without a system text, get the layouts of such; others a list. Rows
    that repeat are turns that repeat. Null ids are one conversation.
    """
    row = F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["role"], x["content"]))
    made = df.groupBy(F.col(conv_col).alias("conv_id")).agg(rows.alias("messages"))
    roles = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"))), "")
    two, three = roles == "user\nassistant\n", roles == "system\nuser\nassistant\n"
    text = lambda i: F.get(F.col("messages"), F.lit(i))["content"]
    record = F.struct(
        F.when(three, text(0)).alias("system"), F.when(two, text(0)).when(three, text(1)).alias("prompt"),
        F.when(two, text(1)).when(three, text(2)).alias("response"), F.when(~(two | three), F.col("messages")).alias("messages"),
    )
    return made.select("conv_id", record.alias("record"))


HARD = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(HARD).alias("text")) for i, r in enumerate(("user", "assistant"))])
    hard = spark.range(-1, 0).select(F.col("id").alias("conv_id"), F.inline(said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    out = format_chat(records(rows, "conv_id", "turn", "role", "text"), "conv_id", "record")
    read = out.select("conv_id", "formatted", "loss_mask", pieces_of(F.col("formatted")).alias("pieces"))
    turns = F.transform("pieces", parse_piece)
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.transform("loss_mask", lambda m: unescape(F.get("pieces", m["turn"]).substr(m["start"] + 1, m["length"])))
    loss = F.array_join(under, "")
    return read.select(
        "conv_id", F.size("pieces").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROLS:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


_EXTRA = " ".join(f"WHEN '{r}' THEN {len(a) + len(b) + 2}" for r, (a, b) in MARKS.items())
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'),
e AS (SELECT *, length({_escaped("text")}) + CASE role {_EXTRA} ELSE length({_escaped("role")}) + {sum(map(len, OTHER)) + len(NAMED) + 4} END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
