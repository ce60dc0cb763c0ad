"""Chat formatting with Spark expressions only: sorted turn structs, merged, escaped and concatenated."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format. Each begins with ``<``, which texts cannot hold once escaped.

    A block is opener, role, after_role, its turns joined by ``between``, closer. Adjacent turns of one
    role share a block, and ``between`` keeps where one ends and the next begins.
    """

    opener: str = "<|turn:"
    after_role: str = "|>"
    between: str = "<|and|>"
    closer: str = "<|end|>\n"

    def __post_init__(self):
        if not all(x.startswith("<") for x in (self.opener, self.between, self.closer)) or "&" in self.after_role + self.opener:
            raise ValueError("opener, between and closer begin with <, and no control string holds &")


DEFAULT = Template()
LOSS_ROLES = ("assistant",)


def escape(col):
    """Reversible: & and < and the | of a role's end become references, so no text holds a control string."""
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("|"), F.lit("&bar;"))


def unescape(col):
    return F.replace(F.replace(F.replace(col, F.lit("&bar;"), F.lit("|")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _blocks(turns):
    """Array aggregation over sorted turns: a turn of the last block's role joins that block."""
    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")

    def step(done, turn):
        last = F.element_at(done, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(turns, empty, step)


def format_conversations(turns: DataFrame, template: Template = DEFAULT, loss_roles: tuple = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation, and where in it the loss applies, as
    (start, length) in code points, one span for each turn of a role in ``loss_roles``.

    Turns are sorted by turn, then role and text, nulls first, so ties and repeated rows have one order
    and all stay. Null text: empty; null role: the empty role. Null conv_id: one conversation of its own.
    Texts of any length stay whole; a conversation is one row, so its turns meet in one task, whatever
    its length. Further columns are ignored. An empty table gives no rows.
    """
    each = turns.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = sorted_turns.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    def head(b):
        return F.concat(F.lit(template.opener), escape(b["role"]), F.lit(template.after_role))

    def body(b):
        return F.array_join(F.transform(b["texts"], escape), template.between)

    parts = F.transform("blocks", lambda b: F.struct(
        head(b).alias("head"), F.transform(b["texts"], escape).alias("texts"), b["role"].isin(*loss_roles).alias("loss")))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), body(b), F.lit(template.closer))), "")

    start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def place(state, b):
        at = state["at"] + F.char_length(b["head"])
        inner = F.aggregate(
            b["texts"], F.struct(at.alias("at"), state["spans"].alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + F.char_length(x) + len(template.between)).cast("long").alias("at"),
                F.when(b["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].cast("long").alias("start"), F.char_length(x).cast("long").alias("length")))))
                .otherwise(s["spans"]).alias("spans"),
            ),
        )
        return F.struct((inner["at"] - len(template.between) + len(template.closer)).cast("long").alias("at"), inner["spans"].alias("spans"))

    return blocks.select("conv_id", text.alias("formatted"), F.aggregate(parts, start, place)["spans"].alias("loss_spans"))


def parse(formatted, template: Template = DEFAULT):
    """The turns in a formatted text: an array of (role, text), one for each turn that went in."""
    blocks = F.filter(F.split(formatted, _quoted(template.closer), -1), lambda x: x != "")
    heads = F.transform(blocks, lambda b: _parsed(b, template))
    return F.flatten(F.transform(heads, lambda h: F.transform(h["texts"], lambda t: F.struct(h["role"].alias("role"), unescape(t).alias("text")))))


def _parsed(b, template: Template):
    rest = F.substr(b, F.lit(len(template.opener) + 1))
    role = F.substring_index(rest, template.after_role, 1)
    body = F.substr(rest, F.char_length(role) + len(template.after_role) + 1)
    return F.struct(unescape(role).alias("role"), F.split(body, _quoted(template.between), -1).alias("texts"))


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Adds ``turns`` and ``loss_text``, both taken from the formatted text."""
    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", parse(F.col("formatted"), template)).withColumn("loss_text", F.array_join(spans, ""))


#: A conversation whose texts hold another format's control strings.
PROBE = (-7, ("user", "assistant"), "</s>[INST] ok [/INST]")


def query(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id").select("conv_id", "turn", "role", "text")
    conv, roles, text = PROBE
    probe = spark.range(len(roles)).select(
        F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("id") + 1).cast("int")).alias("role"), F.lit(text).alias("text"),
    )
    out = read_back(format_conversations(turns.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '|', '&bar;') AS e,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;') AS er,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + CASE WHEN prior = role THEN length('<|and|>') ELSE length('<|turn:') + length(er) + length('|>') + length('<|end|>') + 1 END)::BIGINT
         AS formatted_chars
FROM escaped GROUP BY conv_id
"""
