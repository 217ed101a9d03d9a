"""Not-modified captures resolved against earlier full ones, with DataFrame functions.

A capture whose server answered "not modified" has no body. It is given the
latest earlier full response of the same canonical URL if their validators
agree, and that response's headers with those that such an answer may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .licenses import LOWER, UPPER

# Headers of a not-modified answer that update the stored ones, and tracking parameters of URLs.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"

HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """Host and path by which captures of one page meet; null for a null URL or one without ``://``.

    Scheme, user, fragment, ``www.``, default ports, trailing slashes and
    tracking parameters are left out, A-Z of the host are lower-cased and the
    other parameters sorted.
    """
    rest = F.regexp_extract(url, r"^[^:/?#]*://([^#]*)", 1)
    host = F.translate(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.rlike(r"^[^:/?#]*://"), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))))


def tag(etag: Column) -> Column:
    """An entity tag for weak comparison: without the mark of a weak one."""
    return F.regexp_replace(etag, r"^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the fresh answer in place of
    their namesakes; names lower-cased, ordered by name and value."""
    low = lambda hs: F.transform(F.coalesce(hs, F.array().cast(HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    new = F.filter(low(fresh), lambda h: h["name"].isin(*PERMITTED))
    old = F.filter(low(stored), lambda h: ~F.coalesce(F.array_contains(F.transform(new, lambda x: x["name"]), h["name"]), F.lit(False)))
    return F.array_sort(F.concat(old, new))


def resolve(captures: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """One row for every not-modified capture (status 304).

    ``captures`` has capture_id long, url string, ts long (seconds), status
    int, etag string, last_modified string, headers (array of name, value)
    and payload string; other columns are not read. Full responses are those
    of status 200 with a payload, a URL and a time; other rows are ignored.

    Returns (capture_id, url_key, ts, response_id, outcome, headers,
    payload_md5, payload_length). The response is the latest with an earlier
    time (not the same second; of responses in one second, the greatest id).
    ``outcome`` is ``resolved``; ``mismatch`` (validators differ: the entity
    tags by weak comparison where both have one, else the last-modified
    dates); ``unvalidated`` (no validator in both); ``orphan`` (no earlier
    response); or ``unplaced`` (no canonical URL or no time). Headers and
    payload columns are null unless resolved; response_id is null for the
    last two. Repeated rows come out as often as they came in.

    A URL may hold any share of the rows: captures are first reduced to one
    row a URL and second, in the tasks; running "latest" values are then taken
    within slots of an hour, and over the slots of a URL, so no window holds
    more than a slot's seconds or a URL's hours.
    """
    url = canonical(captures["url"].cast("string"))
    rows = captures.select("capture_id", url.alias("url_key"), F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified", "headers", F.col("payload").cast("string").alias("payload"))
    asked = rows.where("status = 304").drop("payload", "status")
    full = rows.where("status = 200 and payload is not null and url_key is not null and ts is not null")
    body = F.struct("ts", F.col("capture_id").alias("id"), "etag", "last_modified", "headers", F.md5(F.col("payload").cast("binary")).alias("md5"),
                    F.octet_length("payload").cast("long").alias("length"))
    known = full.select("url_key", "ts", F.col("capture_id").alias("id"), body.alias("r"))
    wanted = asked.where("url_key is not null and ts is not null").select("url_key", "ts", F.lit(None).cast("long").alias("id"), F.lit(None).cast(known.schema["r"].dataType).alias("r"))
    # max_by passes over rows whose order is null, so a second without a response has a null r
    seconds = known.unionByName(wanted).groupBy("url_key", "ts").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.struct(F.col("id").isNotNull(), "id"))).alias("r"))
    seconds = seconds.withColumn("slot", F.floor(F.col("ts") / slot_seconds))

    in_slot = Window.partitionBy("url_key", "slot").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    in_url = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = seconds.groupBy("url_key", "slot").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("ts"))).alias("r"))
    slots = slots.select("url_key", "slot", F.last("r", ignorenulls=True).over(in_url).alias("carried"))
    latest = (seconds.withColumn("near", F.last("r", ignorenulls=True).over(in_slot)).join(slots, ["url_key", "slot"])
              .select("url_key", "ts", F.coalesce("near", "carried").alias("r")))

    out = asked.join(latest, ["url_key", "ts"], "left")
    same_tag, same_date = tag(F.col("etag")) == tag(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified")
    agree = F.coalesce(same_tag, same_date)
    outcome = (F.when(F.col("url_key").isNull() | F.col("ts").isNull(), "unplaced").when(F.col("r").isNull(), "orphan")
               .when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch"))
    good = F.col("outcome") == "resolved"
    return out.withColumn("outcome", outcome).select(
        "capture_id", "url_key", "ts", F.col("r.id").alias("response_id"), "outcome", F.when(good, merged(F.col("r.headers"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("r.md5")).alias("payload_md5"), F.when(good, F.col("r.length")).alias("payload_length"))
