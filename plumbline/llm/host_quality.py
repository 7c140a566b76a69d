"""Quality rules by document and by host.

Rules are counted in each document; failures of the soft rules are summed by host (the source), the hosts'
failure rates are shrunk towards a beta prior fitted to all hosts by moments, and the verdicts go back to the
documents: on a bad host a document must pass the soft rules too, elsewhere only the base rules. A host is bad
if its posterior mean lies more than ``BAD_SPREADS`` posterior standard deviations above the prior's mean. A single
failing document on a small host hardly moves its rate, and a document that passes every rule is always kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.util import SPACE, WORD, lookup, salt, stored, whole_text

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT, MIN_MEAN_CHARS, MAX_MEAN_CHARS = 10, 30, 3, 12
BAD_SPREADS = 1.0
BROADCAST_HOSTS = 100_000  # verdicts that are broadcast; more are joined by salted keys


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by hash with their start; neighbours with the same hash are compared word by word.
    """
    at = lambda w, i: F.get(w, i)
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(at(words, i), at(words, i + 1), at(words, i + 2)).alias("h"), i.alias("i"))))
    return F.when(F.size(words) >= 4, windows)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = whole_text(text)
    d = docs.withColumn("_w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    d = d.withColumn("_win", _repeated(F.col("_w")))
    w, win = F.col("_w"), F.col("_win")
    same = lambda i, j: (F.get(win, i)["h"] == F.get(win, j)["h"]) & (
        F.slice(w, F.get(win, i)["i"] + 1, 3) == F.slice(w, F.get(win, j)["i"] + 1, 3))
    hit = F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(win) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))),
        lambda k: F.get(win, k)["i"]))
    d = d.withColumn("_hit", F.coalesce(F.when(F.size(win) > 1, hit), F.array().cast("array<int>")))
    hits = F.col("_hit")
    covered = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counts = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": covered.cast("bigint"),
        "_lines": F.size(lines),
    }
    # One generated row each: a filter on a count cannot be moved below and repeat its costly expression.
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in counts.items()]))))


def _soft() -> Column:
    """Whether a document breaks a soft rule: symbols, repeated lines, mean word length."""
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("_lines"))
        | (F.col("word_chars") < MIN_MEAN_CHARS * F.col("n_words"))
        | (F.col("word_chars") > MAX_MEAN_CHARS * F.col("n_words"))
    )


def host_rates(rows: DataFrame, host: str) -> DataFrame:
    """(_host, bad_host): failure rates by host, shrunk by a beta prior that is fitted to all hosts.

    The prior's mean is the mean of the hosts' rates and its strength follows from their variance, held
    between 2 and 1000; hosts that do not differ, or a single host, give the least strength.
    """
    sums = rows.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n"), F.count_if("soft_failed").alias("failed"))
    sums = stored(sums, "hosts")
    rate = F.col("failed") / F.col("n")
    prior = sums.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).select(
        "mean", F.when(F.col("var") > 0, F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(2.0)), F.lit(1000.0))).otherwise(2.0).alias("strength"))
    mean, strength = (prior.select(c).scalar() for c in ("mean", "strength"))
    weight = F.col("n") + strength
    rate = (F.col("failed") + mean * strength) / weight
    return sums.select("_host", (rate - mean > BAD_SPREADS * F.sqrt(rate * (1 - rate) / (weight + 1))).alias("bad_host"))


def judged(docs: DataFrame, ident: str = "doc_id", host: str = "source", text: str = "text", carry_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``carry_text``) with the counts, base_failed, soft_failed, bad_host, host_decided and kept.

    The rules are counted once: the counted rows are stored, and both the hosts' rates and the verdicts read them.

    kept: not base_failed, and not (soft_failed on a bad host); host_decided: the host alone turned the verdict. A null text has no words and fails; a null
    host is a host of its own; repeated rows count as often as they come; an empty table gives an empty
    table. Columns with the names of the results are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "bad_host", "host_decided", "kept"]
    rows = features(docs.drop(*[c for c in made if c in docs.columns]), text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("soft_failed", F.col("base_failed") | _soft()).drop("_lines")
    # Null is a host too: the key is made not null, and the flag keeps it apart from a host of that name.
    rows = rows.withColumn("_key", F.concat(F.when(F.col(host).isNull(), "0").otherwise("1"), F.coalesce(F.col(host).cast("string"), F.lit(""))))
    rows = stored(rows if carry_text else rows.drop(text), "quality-counts")
    hosts = stored(host_rates(rows, "_key").withColumnRenamed("_host", "_key"), "host-verdicts")
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(hosts), "_key")
    else:
        out = lookup(rows, hosts, ["_key"], salt(ident, "n_words", "word_chars"))
    out = out.drop("_key").withColumn("host_decided", ~F.col("base_failed") & F.col("soft_failed") & F.col("bad_host"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_decided"))


def quality_query(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "source", "text"), carry_text=False).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dups
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
             OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS soft_failed FROM g),
s AS (SELECT source, count(*) AS n, count_if(soft_failed) AS failed FROM h GROUP BY source),
p AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM s),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 2.0 END AS k FROM p),
r AS (SELECT source, m, n + k AS w, (failed + m * k) / (n + k) AS r FROM s, q),
b AS (SELECT source, r - m > sqrt(r * (1 - r) / (w + 1)) AS bad_host FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, bad_host,
       NOT base_failed AND soft_failed AND bad_host AS host_decided, NOT base_failed AND NOT (soft_failed AND bad_host) AS kept
FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
"""
