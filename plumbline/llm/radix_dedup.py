"""Exact duplicates by distributed most-significant-digit radix partitioning.

Every text is read as bytes, led by its length. A round splits the groups of the round before by the
next slice of bytes; groups of one row and groups whose bytes have ended leave. Equality is decided by
the bytes themselves, digests take no part. Slices grow by a constant factor, so a text of n bytes takes
about log(n) rounds and each of its bytes is compared once. Only texts that still share everything read
so far are carried on; after the first round these are the copies and the texts that begin like another.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.util import SPACE, salt, stored, whole_text, with_group

FIRST_BYTES, GROWTH = 32, 8


def squeeze(text: Column | str = "text") -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(whole_text(text), SPACE, " ")


def radix_groups(rows: DataFrame, ident: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ident, *keep, gid, n_same): rows with equal ``value`` (string, not null) share ``gid``.

    ``gid`` is null for rows that are alone. Null and repeated identifiers are ordinary rows. An empty
    table gives an empty table.
    """
    b = F.col(value).cast("binary")
    n = F.octet_length(F.col(value))
    first = rows.select(
        F.col(ident).alias("id"), *keep, n.alias("n"), F.substring(b, 1, FIRST_BYTES).alias("head"), F.col(value).alias("text"),
    )
    first = with_group(first, ["n", "head"], salt("id", *keep), same=(F.lit(1), "sum"))
    rest = (F.col("same") > 1) & (F.col("n") > FIRST_BYTES)
    table = stored(
        first.withColumn("text", F.when(rest, F.col("text"))).withColumn("uid", F.monotonically_increasing_id()), "radix",
    )
    slim = ["uid", "id", *keep, "n"]
    live = with_group(table.where("same > 1").drop("text", "same"), ["n", "head"], salt("uid"), gid=(F.col("uid"), "min"), same=(F.lit(1), "sum"))
    live = stored(live.select(*slim, "gid", "same"), "radix")
    done = [table.where("same = 1").select(*slim, F.lit(None).cast("bigint").alias("gid"), "same"), live.where(F.col("n") <= FIRST_BYTES)]
    longest = table.where("text is not null").agg(F.max("n")).first()[0] or 0
    at, width = FIRST_BYTES, FIRST_BYTES * GROWTH
    while at < longest:
        texts = table.where(F.col("text").isNotNull() & (F.col("n") > at)).select("uid", F.substring(F.col("text").cast("binary"), at + 1, width).alias("piece"))
        going = live.where((F.col("n") > at) & (F.col("same") > 1)).drop("same")
        split = with_group(going.join(texts, "uid").withColumnRenamed("gid", "old"), ["old", "piece"], salt("uid"), gid=(F.col("uid"), "min"), same=(F.lit(1), "sum"))
        at, width = at + width, width * GROWTH
        live = stored(split.select(*slim, "gid", "same"), "radix")
        done.append(live.where((F.col("same") == 1) | (F.col("n") <= at)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("uid", "id", *keep, F.when(F.col("same") > 1, F.col("gid")).alias("gid"), F.col("same").cast("bigint").alias("n_same"))


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row.

    Texts are equal when they are identical after white space runs become one space; null counts as
    empty, so null, empty and no other texts are one group (blanks alone give one space, another group).
    Of equal texts the row with the smallest id stays; null ids come last; of repeated ids one row stays.
    Other columns of the table are ignored. The digest is output only.
    """
    norm = squeeze(text)
    rows = docs.select(F.col(ident).alias("doc_id"), norm.alias("_norm"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    groups = radix_groups(rows, "doc_id", "_norm", ("text_sha256",))
    alone = groups.where("gid is null").select("id", F.col("id").alias("keep_id"), "n_same", F.lit(True).alias("kept"), "text_sha256")
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    many = with_group(groups.where("gid is not null"), ["gid"], salt("uid"), best=(order, "min"))
    many = many.select("id", F.col("best.id").alias("keep_id"), "n_same", (F.col("best.uid") == F.col("uid")).alias("kept"), "text_sha256")
    return alone.unionByName(many).select(F.col("id").alias("doc_id"), "keep_id", F.col("n_same").alias("group_size"), "kept", "text_sha256")


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
