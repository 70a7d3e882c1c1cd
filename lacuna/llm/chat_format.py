r"""Chat formatting by schema fingerprints (DataFrame functions only).

Records arrive as VARIANT payloads in unlike layouts (prompt and response,
instruction with input and output, message lists).  The nested field paths of
a payload, without the value types, are hashed to a fingerprint; a
fingerprint selects one declarative ``Mapping`` that turns the payload into
canonical turns ``array<struct<role, text>>``.

Template: each turn is ``<s>`` role ``[INST]`` text, closed by ``</s>`` if the
role is the one that is learned and by ``[/INST]`` otherwise.  Control strings
begin with ``<`` or ``[``; inside roles and texts a backslash, ``<`` and ``[``
become ``\e``, ``\l`` and ``\b``, so no control string can occur there, and the
three replacements undone in reverse order give the text back.

Scale: one shuffle by conversation id; the explode, the running offsets and
the regrouping keep that partitioning.  A conversation is one training row, so
its turns meet in one row; copies of a conversation have ids of their own.

Cases: null roles and texts read as empty; turns sort by turn, role, text, and
repeated rows stay; a null id is a conversation of its own; a payload whose
fingerprint has no mapping gives no turns and ``layout`` null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN, BODY, END_CONTEXT, END_LEARNED = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
_CODES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout and where its turns are: either ``fields`` (role, path) in the
    order of speaking, or ``items`` (a list's path with the names of its role
    and text members)."""

    name: str
    paths: str
    fields: list = field(default_factory=list)
    items: tuple | None = None

    def turns(self, payload):
        if self.items is not None:
            path, role, text = self.items
            got = F.try_variant_get(payload, path, f"array<struct<{role}:string,{text}:string>>")
            return F.transform(got, lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))).cast(_TURNS)
        return F.array(*[F.struct(F.lit(r).alias("role"), F.try_variant_get(payload, p, "string").alias("text"))
                         for r, p in self.fields]).cast(_TURNS)


MAPPINGS = [
    Mapping("prompt_response", "OBJECT<prompt, response>",
            fields=[("user", "$.prompt"), ("assistant", "$.response")]),
    Mapping("instruction", "OBJECT<input, instruction, output>",
            fields=[("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")]),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>",
            items=("$.messages", "role", "content")),
    Mapping("no_messages", "OBJECT<messages: ARRAY>", items=("$.messages", "role", "content")),
]


def field_paths(payload):
    """Nested field paths of a VARIANT, without value types."""
    shape = F.schema_of_variant(payload)
    scalar = r"(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+, ?[0-9]+\))"
    untyped = F.regexp_replace(shape, ": " + scalar, "")
    return F.regexp_replace(untyped, "ARRAY<" + scalar + ">", "ARRAY")


def canonical(records: DataFrame, payload: str = "payload", mappings=None) -> DataFrame:
    """Adds fingerprint, layout and turns to records with a VARIANT payload."""
    mappings = MAPPINGS if mappings is None else mappings
    out = records.withColumn("fingerprint", F.xxhash64(field_paths(F.col(payload))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        hit = F.col("fingerprint") == F.xxhash64(F.lit(m.paths))
        name = F.when(hit, F.lit(m.name)).otherwise(name)
        turns = F.when(hit, m.turns(F.col(payload))).otherwise(turns)
    return out.withColumn("layout", name).withColumn("turns", turns)


def escape(c):
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c):
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, formatted, loss_spans (code points in ``formatted``, end exclusive)
    of records with canonical ``turns``."""
    at = Window.partitionBy(id_col).orderBy("pos")
    t = records.select(id_col, F.posexplode_outer("turns").alias("pos", "t"))
    learned = F.col("role") == LEARNED_ROLE
    t = (t.select(id_col, "pos", F.coalesce("t.role", F.lit("")).alias("role"),
                  escape(F.coalesce("t.text", F.lit(""))).alias("body"))
         .withColumn("head", F.when(F.col("pos").isNotNull(), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
                     .otherwise(F.lit("")))
         .withColumn("tail", F.when(F.col("pos").isNull(), F.lit(""))
                     .when(learned, F.lit(END_LEARNED)).otherwise(F.lit(END_CONTEXT)))
         .withColumn("size", F.length("head") + F.length("body") + F.length("tail"))
         .withColumn("before", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    start = F.col("before") + F.length("head")
    t = t.withColumn("span", F.when(F.col("pos").isNotNull() & learned, F.struct(
        start.alias("start"), (start + F.length("body")).alias("end"))))
    g = t.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", "tail").alias("segment")))).alias("segments"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return g.select(id_col, F.array_join(F.col("segments.segment"), "").alias("formatted"), "loss_spans")


def read_back(formatted):
    """Turns of a formatted conversation: array of (role, text, learned)."""
    segments = F.filter(F.split(formatted, TURN), lambda s: s != "")

    def turn(s):
        body = F.substring(s, F.instr(s, BODY) + len(BODY), F.length(s))
        learned = F.endswith(s, F.lit(END_LEARNED))
        closing = F.when(learned, F.lit(len(END_LEARNED))).otherwise(F.lit(len(END_CONTEXT)))
        return F.struct(unescape(F.substring_index(s, BODY, 1)).alias("role"),
                        unescape(F.substring(body, F.lit(1), F.length(body) - closing)).alias("text"),
                        learned.alias("learned"))

    return F.transform(segments, turn)


def loss_text(formatted, spans):
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversation rows by turn as one payload per conversation, in the
    layout that its sequence of roles calls for."""
    rows = conversations.select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    roles, text = F.col("ms.role"), lambda i: F.col("ms")[i]["text"]
    pair = F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    triple = F.to_variant_object(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")))
    messages = F.to_variant_object(F.struct(F.transform("ms", lambda m: F.struct(
        m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    is_pair = F.coalesce(roles == F.array(F.lit("user"), F.lit("assistant")), F.lit(False))
    is_triple = F.coalesce(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.lit(False))
    return g.select("conv_id", F.when(is_pair, pair).when(is_triple, triple).otherwise(messages).alias("payload"))


def digests(conversations: DataFrame) -> DataFrame:
    """The formatted conversations, read back and digested."""
    f = format_turns(canonical(records_of(conversations)))
    turns, masked = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    f = f.withColumn("back", turns).withColumn("masked", masked)
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("back").cast("long").alias("n_turns"),
                    F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                    F.length("masked").cast("long").alias("loss_chars"),
                    F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
