"""Chat formatting of turns made of typed parts, in DataFrame functions only.

A turn is a role and a list of parts of kind text, image, audio or document. A visitor
per kind flattens the parts in order: a text is written with its control strings escaped,
any other part leaves a placeholder and is recorded as an attachment with its reference
and the number of tokens that the placeholder expands to. The nth placeholder of a
conversation stands for its nth attachment.

A turn is written as ``<|turn|>role<|text|>parts<|end|>``. In texts and roles every
``<`` that backslashes, or none, separate from a ``|`` gets one backslash more, so they
hold no control string and are read back by taking one away; other text stays as it is.

Lengths and attachments before a turn are running sums over the conversation's turns, so
the loss mask and all offsets cost one exchange, of written turns, by conversation. A
conversation is one row of the result and has to fit one: its turns meet in one task.

Defined results: turns follow their number, equal numbers their role, then their text;
null numbers come first. A null id is a conversation of its own. Null roles, texts, lists
of parts and parts count as empty, and rows that repeat are turns of their own. A part of
any other kind, or none, counts as text. A part without units has one. Further columns
are not looked at, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"

#: Tokens that a unit of a part expands to: an image tile, a second, a page.
EXPANSION = {"image": 576, "audio": 25, "document": 1024}
PLACEHOLDERS = {kind: f"<|{kind}|>" for kind in EXPANSION}

TURN_PATTERN, FIELD_PATTERN = r"<\|turn\|>", r"<\|(?:text|end)\|>"
PLACEHOLDER_PATTERN = rf"<\|(?:{'|'.join(EXPANSION)})\|>"

#: A reference within a text, as Markdown writes it.
REFERENCE = r"!\[[^\[\]\n]*\]\(([^()\s]+)\)"
AUDIO_NAME = r"(?i)\.(?:wav|mp3|flac|ogg|m4a)(?:[?#].*)?$"
DOCUMENT_NAME = r"(?i)\.(?:pdf|docx?|pptx?|xlsx?|txt|md|html?)(?:[?#].*)?$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def part(kind: Column, text: Column, ref: Column, units: Column) -> Column:
    """A part: what it is, its text or its form in a text, where it lies, its size."""
    return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), units.cast("long").alias("units"))


def typed_parts(text: Column) -> Column:
    """A text as parts, with the references in it as attachments."""
    nothing = F.lit(None).cast("string")

    def reference(source: Column) -> Column:
        url = F.regexp_extract(source, REFERENCE, 1)
        kind = F.when(url.rlike(AUDIO_NAME), "audio").when(url.rlike(DOCUMENT_NAME), "document").otherwise("image")
        return part(kind, source, url, F.lit(1))

    whole = F.coalesce(text, F.lit(""))
    both = F.zip_with(
        F.split(whole, REFERENCE, -1), F.regexp_extract_all(whole, F.lit(REFERENCE), F.lit(0)),
        lambda before, source: F.array(
            part(F.lit("text"), before, nothing, F.lit(None)), F.when(source.isNotNull(), reference(source))))
    return F.filter(F.flatten(both), lambda p: p.isNotNull())


def is_attachment(p: Column) -> Column:
    return F.coalesce(p["kind"].isin(*EXPANSION), F.lit(False))


def visited(p: Column) -> Column:
    """What a part leaves in the text: the visitor of its kind."""
    out = escape(F.coalesce(p["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        out = F.when(p["kind"] == kind, F.lit(placeholder)).otherwise(out)
    return out


def recorded(p: Column, expansion: dict[str, int]) -> Column:
    """An attachment: its kind and reference, its form in a text, its token count."""
    each = F.coalesce(*(F.when(p["kind"] == kind, F.lit(n)) for kind, n in expansion.items()))
    return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["text"].alias("source"),
                    (each * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens"))


def formatted_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",),
                    expansion: dict[str, int] | None = None) -> DataFrame:
    """One row per conversation of ``turns``, which have conv_id, turn, role and parts.

    ``formatted`` is its text, ``attachments`` what its placeholders stand for, and
    ``loss`` the stretches to learn from: start and end in code points, the attachments
    before and within. A role outside ``loss_roles`` gives no stretch.
    """
    expansion = EXPANSION | (expansion or {})
    parts = F.filter(F.coalesce("parts", F.array()), lambda p: p.isNotNull())
    role = F.coalesce("role", F.lit(""))
    written = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts")).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        F.array_join(F.transform("parts", visited), "").alias("body"),
        F.transform(F.filter("parts", is_attachment), lambda p: recorded(p, expansion)).alias("attachments"))
    # Equal turns, equal bodies: what their parts stand for decides.
    before = Window.partitionBy("conv_id").orderBy(
        "turn", "role", "body", F.to_json("attachments")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(END)
    count = F.size("attachments")
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0))
    first = F.coalesce(F.sum(count.cast("long")).over(before), F.lit(0))
    placed = written.select("conv_id", F.struct(
        start.alias("at"), F.concat("head", "body", F.lit(END)).alias("text"), F.col("attachments"),
        F.col("role").isin(*loss_roles).alias("learn"),
        F.struct(
            (start + F.char_length("head")).alias("start"),
            (start + F.char_length("head") + F.char_length("body")).alias("end"),
            first.alias("first"), count.alias("count")).alias("span")).alias("turn"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("turns.text"), "").alias("formatted"),
        F.flatten("turns.attachments").alias("attachments"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss"))


def restored(text: Column, attachments: Column) -> Column:
    """A written text with its placeholders as the forms they came from, escaped."""
    pieces = F.split(text, PLACEHOLDER_PATTERN, -1)
    return F.array_join(F.flatten(F.zip_with(pieces, attachments, lambda piece, a: F.array(
        piece, escape(F.coalesce(a["source"], F.lit("")))))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """The turns, role and text, and the text under the loss mask, from written chats."""
    # Bound once, or the text would be written again for each stretch.
    bound = F.array(F.struct("formatted", "attachments", "loss"))

    def read(chat: Column) -> Column:
        written = F.split(restored(chat["formatted"], chat["attachments"]), TURN_PATTERN, -1)
        turns = F.transform(
            F.filter(written, lambda _, i: i > 0),
            lambda turn: F.transform(F.slice(F.split(turn, FIELD_PATTERN, -1), 1, 2), unescape))
        learnt = F.transform(chat["loss"], lambda s: unescape(restored(
            F.substring(chat["formatted"], s["start"] + 1, s["end"] - s["start"]),
            F.slice(chat["attachments"], (s["first"] + 1).cast("int"), s["count"]))))
        return F.struct(turns.alias("turns"), F.array_join(learnt, "").alias("learnt"))

    return chats.withColumn("read", F.get(F.transform(bound, read), F.lit(0))).select("*", "read.*").drop("read")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Sizes and digests of all conversations and of one that spells control strings,
    read back from what was written."""
    odd = "\\### Assistant: </turn> ok"
    more = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionAll(more)
    chats = read_back(formatted_chats(rows.withColumn("parts", typed_parts(F.col("text")))))
    lines = F.transform("turns", lambda t: F.concat(t[0], F.lit("\n"), t[1], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), cut AS (
  SELECT *, [role] || regexp_split_to_array(text, '!\[[^\[\]\n]*\]\([^()\s]+\)') AS pieces,
    list_transform(regexp_extract_all(text, '!\[[^\[\]\n]*\]\(([^()\s]+)\)', 1), lambda url: CASE
      WHEN regexp_matches(url, '(?i)\.(wav|mp3|flac|ogg|m4a)([?#].*)?$') THEN 'audio'
      WHEN regexp_matches(url, '(?i)\.(pdf|docx?|pptx?|xlsx?|txt|md|html?)([?#].*)?$') THEN 'document'
      ELSE 'image' END) AS kinds
  FROM turns
), sized AS (
  SELECT *, 23 + list_sum(list_transform(pieces, lambda p: length(p) + len(regexp_extract_all(p, '<\\*\|'))))
      + coalesce(list_sum(list_transform(kinds, lambda k: length(k) + 4)), 0) AS chars,
    coalesce(list_sum(list_transform(kinds, lambda k: CASE k WHEN 'image' THEN 576 WHEN 'audio' THEN 25 ELSE 1024 END)), 0) AS tokens
  FROM cut
), joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, sum(len(kinds)) AS n, sum(tokens) AS tokens,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(n AS BIGINT) AS n_attachments,
  CAST(tokens AS BIGINT) AS expanded_tokens
FROM joined
"""
