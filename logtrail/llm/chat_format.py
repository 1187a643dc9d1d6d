"""Conversations to training texts and back, by Spark expressions alone.

The turns of a conversation are collected as structs and sorted; neighbours of one role become one block, cut out of
the array by where the role changes; blocks are concatenated between control strings. Control strings inside texts
are broken by an escape character, so that they are never taken for the template's own and come back unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import table

#: Control strings of other common templates: broken in texts too, so that the output is safe with any of them.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


@dataclass(frozen=True)
class Template:
    """open role text t1 also t2 ... close, for each block; texts of the role `learned` are under the loss mask."""

    open: str = "<|turn|>"
    text: str = "<|text|>"
    also: str = "<|also|>"
    close: str = "<|end|>"
    learned: str = "assistant"
    foreign: tuple[str, ...] = FOREIGN

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.text, self.also, self.close, *self.foreign)


DEFAULT = Template()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often, and in whatever loops, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Backslashes doubled, then one set after the first character of each control string, overlapping ones included."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(f"(?:{starts})"), F.lit("$0\\\\"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are one; a single one, which only breaks a control string, goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def running(lengths: Column) -> Column:
    """Sums before each element, in steps of the root of the array's size: no array grows element by element."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def stepped(size: Column) -> Column:
        def offsets(before: Column) -> Column:
            def at(_: Column, i: Column) -> Column:
                step = F.floor(i / size).cast("int")
                return F.get(before, step) + total(F.slice(lengths, step * size + 1, i - step * size))

            return F.transform(lengths, at)

        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda j: total(F.slice(lengths, j * size + 1, size)))
        return let(let(sums, lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j)))), offsets)

    return F.when(F.size(lengths) > 0, let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), stepped)).otherwise(lengths)


def merged(turns: Column) -> Column:
    """array<struct<role, texts>> of sorted turns: neighbours of one role as one block."""

    def cut(starts: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            part = F.slice(turns, start + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - start)
            return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(part, lambda t: t["text"]).alias("texts"))

        return F.transform(starts, block)

    changes = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(changes, cut)


def pieces(blocks: Column, template: Template = DEFAULT) -> Column:
    """array<struct<s, loss>> whose strings in turn are the formatted text; loss: a learned text."""
    piece = lambda s, loss: F.struct((F.lit(s) if isinstance(s, str) else s).alias("s"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def block(b: Column) -> Column:
        head = piece(F.concat(F.lit(template.open), escape(b["role"], template), F.lit(template.text)), False)
        one = lambda t: piece(escape(t, template), b["role"] == template.learned)
        texts = F.transform(b["texts"], lambda t, j: F.when(j > 0, F.array(piece(template.also, False), one(t))).otherwise(F.array(one(t))))
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(template.close, False)))

    return F.flatten(F.transform(blocks, block))


def formatted(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, loss (array<struct<start, length>> in UTF-8 bytes of formatted) of rows (conv_id, turn, role, text).

    Turns are in order of turn, null first, then role and text; null roles and texts are empty. Repeated rows are
    turns of their own. Rows of a null conv_id are one conversation. Other columns are left aside. A conversation is
    one text, so its turns, and no more, come together in one row; an empty table gives none.
    """
    t = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.select("conv_id", t.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def whole(p: Column) -> Column:
        spans = let(running(F.transform(p, lambda x: F.octet_length(x["s"]).cast("long"))), lambda at: F.transform(p, lambda x, i: F.when(x["loss"], F.struct(F.get(at, i).alias("start"), F.octet_length(x["s"]).cast("long").alias("length")))))
        return F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), F.array_compact(spans).alias("loss"))

    out = let(F.col("turns"), lambda turns: let(pieces(merged(turns), template), whole))
    return rows.select("conv_id", out.alias("_out")).select("conv_id", "_out.formatted", "_out.loss")


def read_back(outputs: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """outputs (formatted, loss, others) with turns (array<struct<role, text>>) and loss_text, unescaped, from those two alone."""
    quoted = lambda c: re.escape(c)

    def block(b: Column) -> Column:
        def parts(p: Column) -> Column:
            role = unescape(F.substring(p[0], F.lit(len(template.open) + 1), F.length(p[0])))
            return let(role, lambda r: F.transform(F.split(p[1], quoted(template.also)), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

        return let(F.split(b, quoted(template.text), 2), parts)

    blocks = let(F.split("formatted", quoted(template.close)), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    learned = let(F.col("formatted").cast("binary"), lambda x: F.transform("loss", lambda s: unescape(F.substring(x, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string"))))
    return outputs.withColumn("turns", F.flatten(F.transform(blocks, block))).withColumn("loss_text", F.array_join(learned, ""))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of a template."""
    i = F.col("id")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), i.alias("turn"), F.when(i == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -7, formatted and read back; see formatted and read_back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(planted(spark))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read_back(formatted(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(c: str, template: Template = DEFAULT) -> str:
    count = lambda x: f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}"
    return " + ".join([f"length({c})", *(count(x) for x in ("\\", *template.controls))])


#: Turns put in order by a window; the formatted length is that of all escaped texts, and of marks for each block and turn.
ORACLE_SQL = f"""
WITH raw AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w AS rn, COALESCE(LAG(role) OVER w <> role, true) AS opens FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role = '{DEFAULT.learned}'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY rn) FILTER (role = '{DEFAULT.learned}'), '')) AS loss_sha256,
  CAST(SUM({_escaped_length("text")} + CASE WHEN opens THEN {len(DEFAULT.open + DEFAULT.text + DEFAULT.close)} + {_escaped_length("role")} ELSE {len(DEFAULT.also)} END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
