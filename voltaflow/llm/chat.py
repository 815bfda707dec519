"""Chat formatting by grammar round trip (operator 9); DataFrame functions only.

A conversation is rendered as turns `### role: text</turn>` and a newline. The grammar allows no
control string (`###`, `</turn>`) inside a text. A turn is first rendered as it is and parsed again;
if the parser doesn't give back the same turn, its text is escaped (backslashes doubled, control
strings broken by a backslash) and its header says so: `###\\ role: text</turn>`. The rendered
conversation is then parsed as a whole; should it still differ, all of its turns are escaped.

Defined results: null roles and texts count as empty; turns are ordered by turn (nulls first), then
role, then text, repeated rows stay; a null conv_id is a conversation of its own; an empty table gives
no rows; other columns aren't read. A conversation is one row of output, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, TAIL, SLASH = "###", "</turn>", "\\"
#: The conversation that the contract adds (fixed value).
PROBE = (-7, [(0, "user"), (1, "assistant")], "\\### Assistant: </turn> ok")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def escape_text(text: Column) -> Column:
    doubled = F.replace(text, F.lit(SLASH), F.lit(SLASH * 2))
    return F.replace(F.replace(doubled, F.lit(TAIL), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit(SLASH), F.lit(SLASH * 2))
    for c in (":", "<", "#"):
        out = F.replace(out, F.lit(c), F.lit(SLASH + c))
    return out


def header(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(HEAD), F.when(escaped, SLASH).otherwise(""), F.lit(" "), escape_role(role), F.lit(": "))


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    return F.concat(header(role, escaped), F.when(escaped, escape_text(text)).otherwise(text), F.lit(TAIL + "\n"))


def parse(formatted: Column) -> Column:
    """Array of (role, text, escaped, head): head is the header's length; text is null where the grammar doesn't allow it."""

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?s)^###\\? (?:[^:\\]++|\\.)*+: ", 0)

        def fields(h: Column) -> Column:
            escaped = F.substring(h, 4, 1) == SLASH
            role = F.substring(h, F.when(escaped, 6).otherwise(5), F.length(h) - F.when(escaped, 7).otherwise(6))
            body = F.substring(piece, F.length(h) + 1, F.length(piece))
            legal = (F.length(h) > 0) & ~body.contains(HEAD) & ~body.contains(TAIL)
            return F.struct(
                unescape(role).alias("role"), F.when(legal, F.when(escaped, unescape(body)).otherwise(body)).alias("text"),
                escaped.alias("escaped"), F.length(h).alias("head"), F.length(piece).alias("size"),
            )

        return let(head, fields)

    return let(F.split(formatted, TAIL + "\n"), lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))


def same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"], t["text"])) == F.transform(turns, lambda t: F.struct(t["role"], t["text"]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, loss_spans (start, end, escaped; code points of `formatted`, end exclusive)."""
    src = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))

    def marked(t: Column) -> Column:
        once = let(render_turn(t["role"], t["text"], F.lit(False)), parse)
        back = let(once, lambda p: (F.size(p) == 1) & F.coalesce((p[0]["role"] == t["role"]) & (p[0]["text"] == t["text"]), F.lit(False)))
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), (~back).alias("escaped"))

    def render(escaped) -> Column:
        return F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"], escaped(t))), "")

    convs = src.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", marked)).withColumn("formatted", render(lambda t: t["escaped"]))
    ok = let(parse(F.col("formatted")), lambda p: F.coalesce(same(p, F.col("turns")), F.lit(False)))
    convs = convs.withColumn("formatted", F.when(ok, F.col("formatted")).otherwise(render(lambda t: F.lit(True))))
    return convs.withColumn("loss_spans", loss_spans(parse(F.col("formatted"))))


def loss_spans(parsed: Column) -> Column:
    """Spans of the assistant's texts in the rendered conversation."""
    empty = F.array().cast("array<struct<start:int,end:int,escaped:boolean>>")

    def step(acc: Column, t: Column) -> Column:
        at, size = acc["at"], t["size"]
        span = F.struct((at + t["head"]).alias("start"), (at + size).alias("end"), t["escaped"].alias("escaped"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((at + size + len(TAIL) + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(parsed, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the contract's probe, formatted and read back from the output."""
    conv_id, turns, text = PROBE
    roles = F.array(*(F.lit(role) for _, role in turns))
    probe = spark.range(len(turns)).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(roles, (F.col("id") + 1).cast("int")).alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = format_conversations(rows.unionByName(probe)).withColumn("back", parse(F.col("formatted")))

    def masked(s: Column) -> Column:
        part = F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])
        return F.when(s["escaped"], unescape(part)).otherwise(part)

    spelled = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", F.array_join(F.transform("loss_spans", masked), ""))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, contains(text, '###') OR contains(text, '</turn>') AS esc,
    length(replace(replace(replace(replace(role, '\', '\\'), ':', '\:'), '<', '\<'), '#', '\#')) AS role_len,
    length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) AS esc_len
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + 1 + role_len + 2 + 8 + CASE WHEN esc THEN 1 + esc_len ELSE length(text) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
