"""Chat formatting in Spark expressions only.

Turns are collected as structs, sorted, and neighbours of one role are merged by array
expressions into one block: a block is the slice from one change of role to the next. A formatted conversation is::

    <|open|>role<|text|>first text<|next|>second text<|close|>...

Control strings inside roles and texts are escaped: ``~`` becomes ``~0``, and the n-th control
string ``~n;``. The ``;`` ends the number, so nothing that follows can change it. Every ``~``
left in a text begins an escape, so unescaping in the opposite order gives the text back.

Turns are first merged within ranges of turn numbers, then the ranges of a conversation are
put together: one very long conversation is escaped and merged in many tasks, and only its
finished blocks meet in the row that is the result. All work on that row is in proportion to its
length: places come from sums within groups of GROUP pieces and sums of whole groups, and texts are
cut out of slices of slices.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

OPEN, TEXT, NEXT, CLOSE = "<|open|>", "<|text|>", "<|next|>", "<|close|>"
#: The template's own marks, and those of other templates that a text may hold.
CONTROLS = (OPEN, TEXT, NEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Turns of a conversation that are merged in one task before they meet the others.
RANGE = 256
#: Pieces of a conversation whose lengths are added up together, and spans that are cut out of one slice.
GROUP = 64


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    for n, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(control), F.lit(f"~{n};"))
    return text


def unescape(text: Column) -> Column:
    for n, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(f"~{n};"), F.lit(control))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def _merge(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows(*keys, blocks)`` with neighbouring blocks of one role as one with all their texts."""
    changes = F.filter(
        F.sequence(F.lit(0), F.size("blocks") - 1),
        lambda i: (i == 0) | (F.get("blocks", i)["role"] != F.get("blocks", i - 1)["role"]),
    )
    block = lambda at, n: F.struct(
        F.get("blocks", at)["role"].alias("role"),
        F.flatten(F.transform(F.slice("blocks", at + 1, F.coalesce(F.get("changes", n + 1), F.size("blocks")) - at), lambda b: b["texts"])).alias("texts"),
    )
    return rows.select(*keys, "blocks", changes.alias("changes")).select(*keys, F.transform("changes", block).alias("blocks"))


def _grouped(array: Column, size: Column) -> Column:
    """An array in slices of GROUP."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(float(GROUP))).cast("int") - 1, F.lit(0))), lambda g: F.slice(array, g * GROUP + 1, GROUP))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation in ``turns(conv_id, turn, role, text)``.

    loss_spans are (start, end) in code points of ``formatted``, end exclusive, one for each text
    of ``loss_roles``. Turns go by turn, nulls first; equal turns by role and text; repeated
    rows stay. Null roles and texts are empty. Rows without conv_id are one conversation. An
    empty table gives an empty one; other columns are not read.
    """
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    parts = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / RANGE).alias("range"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", "range", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), F.array(escape(t["text"])).alias("texts"))).alias("blocks"))
    )
    ranges = _merge(parts, "conv_id", "range").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "blocks"))).alias("parts"))
    whole = _merge(ranges.select("conv_id", F.flatten("parts.blocks").alias("blocks")), "conv_id")
    head = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(TEXT))
    formatted = F.concat_ws("", F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))))
    piece = lambda b: lambda t, i: F.struct(
        F.length(F.when(i == 0, head(b)).otherwise(F.lit(NEXT))).alias("before"),
        F.length(t).alias("size"),
        F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("after"),
        b["role"].isin(*loss_roles).alias("learnt"),
    )
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], piece(b))))
    chars = lambda p: p["before"] + p["size"] + p["after"]
    # What a lambda looks up for each element is its argument or short, as Spark may put an expression in a column's place.
    spans = F.zip_with(
        "groups",
        "begins",
        lambda group, begin: F.transform(
            group,
            lambda p, i: F.struct(p["learnt"].alias("learnt"), (begin + _total(F.transform(F.slice(group, 1, i), chars)) + p["before"]).alias("start"), p["size"].alias("size")),
        ),
    )
    begins = F.transform("sums", lambda _, g: _total(F.slice("higher", 1, F.floor(g / GROUP).cast("int"))) + _total(F.slice("sums", F.floor(g / GROUP).cast("int") * GROUP + 1, g % GROUP)))
    learnt = F.transform(F.filter(F.flatten("spans"), lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("end")))
    kept = ("conv_id", "formatted")
    return (
        whole.select("conv_id", formatted.alias("formatted"), pieces.alias("pieces"))
        .select(*kept, _grouped(F.col("pieces"), F.size("pieces")).alias("groups"))
        .select(*kept, "groups", F.transform("groups", lambda group: _total(F.transform(group, chars))).alias("sums"))
        .select(*kept, "groups", "sums", F.transform(_grouped(F.col("sums"), F.size("sums")), _total).alias("higher"))
        .select(*kept, "groups", begins.alias("begins"))
        .select(*kept, spans.alias("spans"))
        .select(*kept, learnt.alias("loss_spans"))
    )


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before merging."""
    blocks = F.filter(F.split(formatted, _quoted(CLOSE)), lambda b: F.startswith(b, F.lit(OPEN)))

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(OPEN) + 1)), _quoted(TEXT), 2)
        return F.transform(F.split(halves[1], _quoted(NEXT)), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def _quoted(text: str) -> str:
    return functools.reduce(lambda s, c: s.replace(c, "\\" + c), "|", text)


def loss_text(rows: DataFrame) -> DataFrame:
    """``rows`` with ``loss``, all text of ``formatted`` under its ``loss_spans``, unescaped, in order.

    To find a character in a string takes time in proportion to its place, so spans are cut out of the
    slice that GROUP of them share, and that out of the slice of GROUP such groups.
    """
    names = rows.columns

    def cut(text: Column, base: Column, spans: Column) -> Column:
        """A slice from the first to the last of ``spans``, and where it starts."""
        start, end = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
        return F.struct(F.substr(text, start - base + 1, end - start).alias("text"), start.alias("start"), spans.alias("spans"))

    groups = _grouped(F.col("loss_spans"), F.size("loss_spans"))
    large = F.transform("__groups", lambda many: cut(F.col("formatted"), F.lit(0), F.flatten(many)))
    small = F.flatten(F.transform("__large", lambda s: F.transform(F.transform(F.sequence(F.lit(0), F.ceil(F.size(s["spans"]) / F.lit(float(GROUP))).cast("int") - 1), lambda g: F.slice(s["spans"], g * GROUP + 1, GROUP)), lambda spans: cut(s["text"], s["start"], spans))))
    texts = F.flatten(F.transform("__small", lambda s: F.transform(s["spans"], lambda x: unescape(F.substr(s["text"], x["start"] - s["start"] + 1, x["end"] - x["start"])))))
    grouped = rows.withColumn("__groups", groups)
    grouped = grouped.withColumn("__groups", F.filter(_grouped(F.col("__groups"), F.size("__groups")), lambda many: F.size(F.flatten(many)) > 0))
    return grouped.withColumn("__large", large).withColumn("__small", small).withColumn("loss", F.concat_ws("", texts)).select(*names, "loss")


def digests(turns: DataFrame) -> DataFrame:
    done = format_chats(turns)
    read = loss_text(done).select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), "loss")
    listed = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


def _sql() -> str:
    escaped = lambda c: functools.reduce(lambda s, n: f"replace({s}, '{CONTROLS[n]}', '~{n + 1};')", range(len(CONTROLS)), f"replace({c}, '~', '~0')")
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS joined, length({escaped("role")}) AS role_chars, length({escaped("text")}) AS text_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(text_chars + CASE WHEN joined THEN {len(NEXT)} ELSE role_chars + {len(OPEN) + len(TEXT) + len(CLOSE)} END) AS formatted_chars
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c"""


SQL = _sql()
