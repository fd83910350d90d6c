r"""Chat formatting: typed content parts flattened into one marked-up string, native Spark only.

Template of a turn: ``<|start|>role<|sep|>content<|end|>`` and a line feed. In
roles and texts ``\`` is written ``\s`` and ``<`` is written ``\l``; a ``<`` in
the output is therefore always the template's own, whatever control strings a
text holds, and replacing ``\l`` then ``\s`` gives the text back.

The visitor maps each part by its kind: text to its escaped text, image, audio
and document to an ordered placeholder (``<|image|>`` ...) with one entry in
``attachments`` in the same order, which holds the reference and the number of
tokens the placeholder expands to. A part of another kind is kept as a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import table

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 256
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", "image", "audio"), p["kind"]).otherwise(F.lit("document"))


def _render(p: Column) -> Column:
    return F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))


def _tokens(p: Column) -> Column:
    """Tokens a placeholder expands to; a missing measure counts as zero."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(PATCH))
    image = side(p["width"]) * side(p["height"])
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(AUDIO_TOKENS_A_SECOND))
    return F.when(_kind(p) == "image", image).when(_kind(p) == "audio", audio).otherwise(F.coalesce(p["pages"], F.lit(0)) * F.lit(TOKENS_A_PAGE)).cast("long")


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) or (..., parts array of PART) -> a row a conversation:

    conv_id, formatted, loss_mask array<struct<segment, start, end>>, attachments
    array<struct<ordinal, kind, uri, tokens>>, expanded_tokens.

    ``loss_mask`` spans count code points (end exclusive) inside a segment, which
    is what stands before one end marker; every text part of an assistant's turn
    is under the mask. Turns are ordered by turn (null first); ties by role, then
    text. A null text or role is empty, null parts are no part, a null conv_id is
    a conversation of its own, repeated rows are repeated turns, no rows give no
    rows. A conversation is one output value, so its rows meet in one task; long
    ones are bounded by what one string can hold. Further columns are ignored.
    """
    if "parts" not in messages.columns:
        one = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
        messages = messages.withColumn("parts", F.array(one))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", "parts", F.transform("parts", _render).alias("shown"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    starts = lambda i: F.length(head) + F.aggregate(F.slice("shown", 1, i), F.lit(0), lambda n, x: n + F.length(x))
    spans = F.transform("parts", lambda p, i: F.when(_kind(p) == "text", F.struct(starts(i).alias("start"), (starts(i) + F.length(F.get("shown", i))).alias("end"))))
    mask = F.when(F.col("role") == "assistant", F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    kept = F.filter("parts", lambda p: _kind(p) != "text")
    attached = F.transform(kept, lambda p: F.struct(_kind(p).alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")))
    rows = rows.select("conv_id", "turn", "role", "shown", F.concat(head, F.array_join("shown", ""), F.lit(END)).alias("piece"), mask.alias("mask"), attached.alias("attached"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "piece")) - 1
    rows = rows.select("conv_id", F.struct(place.alias("segment"), "piece", "mask", "attached").alias("m"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    spans = F.flatten(F.transform("m", lambda m: F.transform(m["mask"], lambda s: F.struct(m["segment"].alias("segment"), s["start"].alias("start"), s["end"].alias("end")))))
    whole = whole.select("conv_id", F.array_join(F.col("m.piece"), "").alias("formatted"), spans.alias("loss_mask"), F.flatten("m.attached").alias("attached"))
    numbered = F.transform("attached", lambda a, i: F.struct((i + 1).alias("ordinal"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    return whole.select("conv_id", "formatted", "loss_mask", numbered.alias("attachments"), F.aggregate("attached", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from the formatted string alone.

    (conv_id, formatted, loss_mask) -> conv_id, turns array<struct<role, text>>,
    loss array<string>, formatted_chars; placeholders stay as written.
    """
    parts = F.split("formatted", r"<\|end\|>\n")
    rows = formatted.select("conv_id", "loss_mask", F.length("formatted").cast("long").alias("formatted_chars"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("segments"))
    head = lambda s: F.substring_index(s, SEP, 1)
    turn = lambda s: F.struct(unescape(F.substr(head(s), F.lit(len(START) + 1))).alias("role"), unescape(F.substr(s, F.length(head(s)) + F.lit(len(SEP) + 1))).alias("text"))
    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.get("segments", m["segment"]), m["start"] + 1, m["end"] - m["start"])))
    return rows.select("conv_id", F.transform("segments", turn).alias("turns"), loss.alias("loss"), "formatted_chars")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digests of every conversation and of conversation -7, read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = read_back(format_conversations(rows.unionByName(extra)))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 24 + length(role) + length(text)
            + length(role) - length(replace(replace(role, '\', ''), '<', ''))
            + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS chars
  FROM m
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
