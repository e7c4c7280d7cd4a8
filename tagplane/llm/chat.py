"""Chat formatting by schema fingerprints.

Records come as JSON in whatever layout their source uses: a prompt and a completion, an instruction
with input and output, lists of messages or of turns under various names. A record's fingerprint is a
hash of its nested field paths. Fingerprints select declarative mappings, which are Variant paths and
casts, and every layout becomes the same array of turns (role, text). A template then joins the turns
into one string with marks around each turn and reports which characters carry loss.

Control strings inside texts are escaped by one backslash after their first character (`</s>` becomes
`<\\/s>`, and `<\\/s>` becomes `<\\\\/s>`), which no mark contains; removing one backslash undoes it.

Everything is DataFrame functions over one row per conversation. Defined cases: a null text or role is
empty; a record of unknown layout has null turns and is reported by `layout`; ties of turn numbers are
ordered by role and text; repeated rows are repeated turns; a conversation without rows does not
exist, an empty table gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import table

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout by its field paths, and how to read turns from it.

    ``fields`` is the object's shape in the notation of `shape`; optional fields make several shapes.
    ``turns`` lists (role, path) for layouts with one field per turn; ``list_path`` and the fields of
    its elements serve layouts that hold a list.
    """

    name: str
    fields: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    list_path: str = ""
    role_field: str = ""
    text_field: str = ""
    order_field: str = ""
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("prompt", ("OBJECT<completion, prompt>",), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", ("OBJECT<prompt, response>",), turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", ("OBJECT<answer, question>",), turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout(
        "instruction",
        ("OBJECT<input, instruction, output>", "OBJECT<instruction, output>"),
        turns=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
    Layout("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>",), list_path="$.messages", role_field="role", text_field="content"),
    Layout("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>",), list_path="$.conversations", role_field="from", text_field="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("turn_rows", ("OBJECT<rows: ARRAY<OBJECT<role, text, turn>>>",), list_path="$.rows", role_field="role", text_field="text", order_field="turn"),
)


def shape(record: Column) -> Column:
    """Nested field paths of a Variant, without scalar types: keys are in order, lists are merged."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(\(\d+,\s?\d+\))?", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.turns:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), _text(record, path).alias("text")) for role, path in layout.turns])
        if layout.name == "instruction":
            # Without input the instruction is what the user says.
            merged = F.array(
                F.struct(F.lit("user").alias("role"), _text(record, "$.instruction").alias("text")),
                F.struct(F.lit("assistant").alias("role"), _text(record, "$.output").alias("text")),
            )
            return F.when(_text(record, "$.input") == "", merged).otherwise(turns)
        return turns
    fields = f"{layout.role_field}:string,{layout.text_field}:string" + (f",{layout.order_field}:double" if layout.order_field else "")
    rows = F.try_variant_get(record, layout.list_path, f"array<struct<{fields}>>")
    role = lambda x: F.coalesce(x[layout.role_field], F.lit(""))
    text = lambda x: F.coalesce(x[layout.text_field], F.lit(""))
    if layout.order_field:
        rows = F.array_sort(F.transform(rows, lambda x: F.struct(x[layout.order_field].alias("o"), role(x).alias(layout.role_field), text(x).alias(layout.text_field))))

    def named(x: Column) -> Column:
        found = role(x)
        for other, canonical in layout.roles:
            found = F.when(role(x) == other, F.lit(canonical)).otherwise(found)
        return F.struct(found.alias("role"), text(x).alias("text"))

    return F.transform(rows, named)


def canonical(records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records with fingerprint, layout and turns; turns are null for an unknown layout."""
    record = F.try_parse_json(F.col(payload))
    shaped = records.withColumn("_chat_record", record).withColumn("_chat_shape", shape(F.col("_chat_record")))
    shaped = shaped.withColumn("fingerprint", fingerprint(F.col("_chat_shape")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for layout in layouts:
        fits = F.lit(False)
        for x in layout.fields:
            fits = fits | (F.col("fingerprint") == fingerprint(F.lit(x)))
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, _turns(F.col("_chat_record"), layout)).otherwise(turns)
    return shaped.withColumn("layout", name).withColumn("turns", turns.cast(TURN)).drop("_chat_record", "_chat_shape")


#: The template's own marks, and control strings of public chat templates that texts
#: must not smuggle in.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROLS = r"(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<SYS>>|</SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + _CONTROLS + ")", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\(" + _CONTROLS + ")", r"$1$2$3")


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans (start, length in characters of formatted, from 0) to rows with turns."""
    body = lambda t: escape(t["text"])
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), head(t).alias("head"), body(t).alias("body")))
    marked = conversations.withColumn("_chat_pieces", pieces)
    tail = END + "\n"
    text = F.array_join(F.transform("_chat_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    sizes = F.transform(
        "_chat_pieces", lambda p: F.struct(p["loss"].alias("loss"), F.length(p["head"]).cast("long").alias("before"), F.length(p["body"]).cast("long").alias("length"))
    )
    span = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def step(done: Column, p: Column) -> Column:
        here = F.struct((done["at"] + p["before"]).alias("start"), p["length"].alias("length"))
        spans = F.when(p["loss"], F.concat(done["spans"], F.array(here))).otherwise(done["spans"])
        return F.struct((done["at"] + p["before"] + p["length"] + len(tail)).alias("at"), spans.alias("spans"))

    folded = F.aggregate(F.col("_chat_sizes"), start, step, lambda done: done["spans"])
    return marked.withColumn("_chat_sizes", sizes).withColumn("formatted", text).withColumn("loss_spans", folded).drop("_chat_pieces", "_chat_sizes")


def read_turns(text: Column) -> Column:
    """The turns that a formatted string holds."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    cut = len(START)

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        role = F.url_decode(F.substring(p, F.lit(cut + 1), at - (cut + 1)))
        return F.struct(role.alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and payload: the rows of each conversation as one JSON record of the turn-rows layout."""
    row = F.struct(
        F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload"))


def op4_fingerprinted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    )
    out = formatted(canonical(conversation_records(rows.unionByName(probe))))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Escaping adds a backslash for each control string; `url_encode` leaves the roles of the table alone.
OP4_ORACLE = r"""
with rows as (
  select conv_id, coalesce(turn, 0) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, length(text) + length(regexp_extract_all(text,
  '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<SYS>>|</SYS>>|/?INST\])')) as escaped from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(role) + 1 + escaped + 11) as bigint) as formatted_chars
from sized group by conv_id
"""
