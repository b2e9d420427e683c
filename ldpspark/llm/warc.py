"""Not-modified revisits in web captures.

A revisit says that a page had not changed; its content is that of the latest earlier full response for the same
canonical URL. The join is an as-of join: captures are range-partitioned by URL and time, each slice carries the latest
response forward, and what a slice inherits comes from a table of one row per slice. A URL with any number of captures
may so span many slices. The revisit counts only if its validators agree with the response, and the headers that a
not-modified answer may change are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldpspark.operators.ordered import slices

from .urlfilter import normal_form

# Fields that a stored response keeps although a not-modified answer may name them.
KEPT_FIELDS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)


def header_fields(block: str | Column) -> Column:
    """A header block (a status line, then ``Name: value`` lines) to a map of lower-case names. Lines without a colon
    are left out; values of a repeated name are joined by a comma, in order."""
    block = F.col(block) if isinstance(block, str) else block
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n", -1), lambda x: F.regexp_like(x, F.lit(r"^[^\s:]+:")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value")),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = lambda name: F.array_join(F.transform(F.filter(pairs, lambda p: p["name"] == name), lambda p: p["value"]), ", ")
    return F.map_from_arrays(names, F.transform(names, values))


def merged(stored: Column, update: Column) -> Column:
    """Stored header fields with those of a not-modified answer in their place, sorted by name. A map of many fields is
    searched field by field: headers are short."""
    fresh = F.map_filter(update, lambda k, v: ~k.isin(*KEPT_FIELDS))
    old = F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, fresh))))


def _etag(fields: str) -> Column:
    return F.regexp_replace(F.element_at(fields, F.lit("etag")), "^W/", "")


def validators(fields: str, digest: str) -> Column:
    return F.struct(
        _etag(fields).alias("etag"), F.element_at(fields, F.lit("last-modified")).alias("modified"), F.col(digest).alias("digest")
    )


def agreement(mine: Column, theirs: Column) -> Column:
    """``resolved`` if the strongest validator that both sides have is equal (entity tag, then payload digest, then
    date of change), ``mismatch`` if it differs, ``unverified`` if they share none."""
    verdict = F.lit("unverified")
    for name in ("modified", "digest", "etag"):
        both = mine[name].isNotNull() & theirs[name].isNotNull()
        verdict = F.when(both, F.when(mine[name] == theirs[name], "resolved").otherwise("mismatch")).otherwise(verdict)
    return verdict


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, url, response_id, outcome, headers, payload_digest`` of every revisit.

    ``records`` has ``record_id, kind`` (response or revisit), ``url, captured`` (timestamp), ``http_headers`` (text) and
    ``payload_digest``. ``outcome`` is resolved, mismatch, unverified (no validator in common) or missing (no earlier
    response, or no URL). Only a resolved revisit has headers and the digest of its response; ``response_id`` names the
    response looked at. Earlier means a smaller time; at equal times none is earlier. A NULL time is the earliest of
    all. Among responses of one URL and time the largest ``record_id`` is the latest. Other kinds and columns are not
    read; repeated rows are resolved each; NULL headers are no headers.
    """
    seen = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        (F.col("kind") == "response").alias("full"),
        "url",
        normal_form(F.col("url")).alias("address"),
        F.coalesce(F.col("captured").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("captured"),
        header_fields("http_headers").alias("fields"),
        "payload_digest",
    )
    # at equal times revisits come first: they may not see a response of the same moment
    order = [F.col("captured"), F.col("full"), F.col("record_id")]
    own = F.when(
        F.col("full"),
        F.struct("record_id", "fields", "payload_digest", validators("fields", "payload_digest").alias("checks")),
    )
    placed = slices(seen.where("address is not null").withColumn("own", own), ["address"], order)
    inside = Window.partitionBy("__slice", "address").orderBy(*order)
    latest = placed.withColumn("near", F.last("own", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # what each slice hands on for its last address, carried over slices without a response of that address
    ends = placed.groupBy("__slice").agg(F.max("address").alias("address"))
    handed = placed.where("full").groupBy("__slice", "address").agg(F.max_by("own", F.struct("captured", "record_id")).alias("own"))
    handed = ends.join(handed, ["__slice", "address"], "left")
    carry = Window.partitionBy("address").orderBy("__slice")
    starts = placed.groupBy("__slice").agg(F.min("address").alias("address"))
    wanted = starts.select("__slice", "address", F.lit(None).cast(handed.schema["own"].dataType).alias("own"), F.lit(0).alias("hand"))
    passed = handed.select("__slice", "address", "own", F.lit(1).alias("hand")).unionByName(wanted)
    passed = passed.withColumn(
        "far", F.last("own", ignorenulls=True).over(carry.orderBy("__slice", "hand").rowsBetween(Window.unboundedPreceding, -1))
    ).where("hand = 0").select("__slice", "address", "far")
    joined = latest.where("not full").join(passed, ["__slice", "address"], "left")
    found = joined.withColumn("of", F.coalesce("near", "far"))
    outcome = F.when(F.col("of").isNull(), "missing").otherwise(
        agreement(validators("fields", "payload_digest"), F.col("of.checks"))
    )
    out = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    resolved = out.select(
        "record_id",
        "url",
        F.col("of.record_id").alias("response_id"),
        "outcome",
        F.when(good, merged(F.col("of.fields"), F.col("fields"))).alias("headers"),
        F.when(good, F.col("of.payload_digest")).alias("payload_digest"),
    )
    lost = seen.where("address is null and not full")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in resolved.schema}
    return resolved.unionByName(
        lost.select("record_id", "url", empty["response_id"], F.lit("missing").alias("outcome"), empty["headers"], empty["payload_digest"])
    )
