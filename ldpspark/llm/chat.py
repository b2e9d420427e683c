"""Chat formatting with typed content parts.

A message is a list of parts. The visitor turns each part into text in order: text is escaped, an image, a sound or a
document becomes a numbered placeholder, and its reference and expanded token count are recorded. The formatted
conversation is one string; the loss mask is a list of byte ranges in it. All of it is columns: no Python per row.

Control strings all begin with ``<|``. In texts and roles ``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, so no text
can hold a control string, and parsing by plain splits gives back exactly what went in. Adjacent text parts are joined
before they are escaped: what one begins and the next one ends is no control string either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
# how attachments of any other kind are written; the record keeps their kind
OTHER = "other"
# an attachment stands for so many tokens at most, so that sums of many fit a long
MOST_TOKENS = 1 << 40


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for: square image patches, sound frames a second, tokens a page."""

    patch: int = 14
    frames: float = 25.0
    page: int = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """A message body of one text part."""
    empty = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[c.alias(f) for f, c in empty.items()]))


def _tokens(part: Column, size: Expansion) -> Column:
    """Expanded tokens of an attachment, from 1 to MOST_TOKENS; a missing or negative size, and another kind, count 1."""
    most = F.lit(float(MOST_TOKENS))
    sides = [F.ceil(F.coalesce(part[s], F.lit(0)) / F.lit(size.patch)).cast("double") for s in ("width", "height")]
    seconds = F.nanvl(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
    counts = {
        "image": F.greatest(sides[0], F.lit(0.0)) * sides[1],
        "audio": F.least(seconds * F.lit(size.frames), most),
        "document": F.coalesce(part["pages"], F.lit(0)).cast("double") * F.lit(size.page),
    }
    chosen = F.lit(1.0)
    for kind, count in counts.items():
        chosen = F.when(part["kind"] == kind, count).otherwise(chosen)
    return F.ceil(F.greatest(F.least(chosen, most), F.lit(1.0))).cast("bigint")


def _is_text(part: Column) -> Column:
    return part["kind"].isNull() | (part["kind"] == "text")


def _placeholder(part: Column, number: Column) -> Column:
    kind = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise(OTHER)
    return F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))


def visited(messages: DataFrame, size: Expansion = Expansion()) -> DataFrame:
    """Adds ``body`` (escaped text and placeholders in order) and ``attachments``, numbered within the message. A part
    without kind is text; every part that is not text is an attachment."""
    numbered = F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    # what is written, and the text since the last attachment
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    step = lambda a, x: F.when(
        _is_text(x["p"]), F.struct(a["done"].alias("done"), F.concat(a["text"], F.coalesce(x["p"]["text"], F.lit(""))).alias("text"))
    ).otherwise(F.struct(F.concat(a["done"], escape(a["text"]), _placeholder(x["p"], x["i"])).alias("done"), F.lit("").alias("text")))
    body = F.aggregate(numbered, start, step, lambda a: F.concat(a["done"], escape(a["text"])))
    attached = F.transform(
        F.filter(numbered, lambda x: ~_is_text(x["p"])),
        lambda x: F.struct(
            x["i"].alias("part"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), _tokens(x["p"], size).alias("tokens")
        ),
    )
    none = F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>")
    return messages.withColumns({"body": F.coalesce(body, F.lit("")), "attachments": F.coalesce(attached, none)})


def format_chat(messages: DataFrame, size: Expansion = Expansion(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages ``(conv_id, turn, role, parts)`` to one row per conversation.

    ``formatted`` is the whole text, ``loss`` the byte ranges ``(start, length)`` of the bodies of the ``learned`` roles,
    ``attachments`` the references ``(message, part, kind, ref, tokens)`` in order, ``media_tokens`` their sum.

    Messages are in the order of ``turn`` (NULL first), then role and text, so ties and repeated rows have a fixed place.
    NULL roles, parts and texts are empty; messages without ``conv_id`` form one conversation. Other columns are not
    read. A conversation is one string, so it must fit one task; conversations do not wait for each other.
    """
    seen = visited(messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts"), size)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    cut = seen.withColumns({"head": head, "bytes": F.octet_length(F.concat(head, "body", F.lit(END))).cast("bigint")})
    placed = cut.withColumns(
        {
            "number": F.row_number().over(in_order) - 1,
            "start": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + F.octet_length("head"),
        }
    )
    entry = F.struct(
        "number",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        "start",
        F.octet_length("body").cast("bigint").alias("length"),
        F.col("role").isin(*learned).alias("learned"),
        "attachments",
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    media = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["attachments"],
                lambda a: F.struct(t["number"].alias("message"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        loss.alias("loss"),
        media.alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def turns_of(formatted: Column) -> Column:
    """The formatted text back to an array of ``(role, text)``. Placeholders stay as they are in the text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), BODY, 1)).alias("role"),
            unescape(F.substring_index(p, BODY, -1)).alias("text"),
        ),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    data = F.encode(formatted, "UTF-8")
    cut = lambda r: unescape(F.decode(F.substring(data, (r["start"] + 1).cast("int"), r["length"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(loss, cut), "")
