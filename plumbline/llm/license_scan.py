"""License scans: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a line of a text as the set of its words, a template the set of the words of a licence notice. A
block matches a template T if it holds at least ``THRESHOLD`` of T's words. Tokens are put in one global order,
rarest first over all blocks, which gives three exact filters: a block with fewer template words than any
template needs is dropped (length); a match must share one of T's first |T| - need + 1 tokens with the first
|B| - need + 1 of the block (prefix); and the place of their first common token bounds what can still follow
(positional). What passes is verified by the sets. Tokens outside all templates are never counted as common,
so they are dropped before the join, and neither order nor filters see them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.util import stored, whole_text

THRESHOLD = 0.8
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2.0",
    "public-domain": "this work is dedicated to the public domain",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: Column) -> Column:
    """A-Z in lower case, lines kept, every other run of non-word characters one space."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def template_words(text: str) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def _need(size: int, threshold: float) -> int:
    """Least number of common words that is ``threshold`` of a template of ``size`` words."""
    return -(-size * round(threshold * 1000) // 1000)


def _n_words(spaced: Column) -> Column:
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))


def _places(one: Column, n_words: Column) -> dict[str, Column]:
    """label -> struct(n, first, last) of the places of its phrase in ``one`` (words with one space around each); null if none."""
    out = {}
    for phrase, label in PHRASES.items():
        words = phrase.split(" ")
        # With two spaces between words every place has its own, so places that touch are all found.
        parts = F.split(F.replace(one, F.lit(" "), F.lit("  ")), " " + "  ".join(words) + " ")
        found = F.struct(
            (F.size(parts) - 1).cast("bigint").alias("n"), _n_words(F.get(parts, F.lit(0))).cast("bigint").alias("first"),
            (n_words - _n_words(F.element_at(parts, -1)) - len(words)).cast("bigint").alias("last"))
        out[label] = F.when(F.contains(one, F.lit(f" {phrase} ")), found)
    return out


def matching_blocks(blocks: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(uid, label, share): every block whose words hold at least ``threshold`` of a template's words.

    ``blocks``: uid, words (distinct template words of the block). The templates are a parameter of the
    caller; only their words are counted, and only their prefixes are broadcast.
    """
    sets = {label: template_words(t) for label, t in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    slim = blocks.withColumn("bid", F.monotonically_increasing_id())
    slim = stored(slim, "license-blocks")
    count = {r.word: r.n for r in slim.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    ranked = slim.select("uid", "bid", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w))).alias("r"))
    prefixes = []
    for label, s in sets.items():
        r, need = sorted(rank[w] for w in s), _need(len(s), threshold)
        prefixes += [(label, r, need, token, at) for at, token in enumerate(r[:len(r) - need + 1])]
    index = blocks.sparkSession.createDataFrame(prefixes, "label string, t array<int>, need int, token int, at int")
    met = ranked.select("uid", "bid", "r", F.posexplode("r").alias("pos", "token")).join(F.broadcast(index), "token")
    n = F.size("r")
    met = met.where((n >= F.col("need")) & (F.col("pos") <= n - F.col("need")) & (F.least(n - F.col("pos"), F.size("t") - F.col("at")) >= F.col("need")))
    common = F.size(F.array_intersect("r", "t"))
    return met.where(common >= F.col("need")).select("uid", "label", (common / F.size("t")).alias("share"))


def licenses(docs: DataFrame, ident: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    A null or empty text has no words, no places and empty label lists. A line holds a template when it holds
    enough of its words, in any order and with others between. score: 1 with a phrase, else the largest share
    of a matched template, else 0. Rows are judged one by one: repeated rows and ids each keep their own
    result, other columns are ignored, an empty table gives an empty table.
    """
    templates = templates or TEMPLATES
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    least = min(_need(len(template_words(t)), threshold) for t in templates.values())
    rows = docs.select(F.col(ident).alias("doc_id"), _folded(whole_text(text)).alias("_t"))
    rows = rows.withColumn("_one", F.regexp_replace(F.concat(F.lit(" "), F.col("_t"), F.lit(" ")), r"[ \n]+", " "))
    rows = rows.withColumn("n_words", (F.length("_one") - F.length(F.replace("_one", F.lit(" "))) - 1).cast("bigint"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    lines = F.filter(F.transform(F.split("_t", "\n"), lambda x: F.array_intersect(F.split(x, " "), known)), lambda x: F.size(x) >= least)
    places = _places(F.col("_one"), F.col("n_words"))
    rows = stored(rows.select(
        "doc_id", "n_words", lines.alias("_lines"), *[c.alias(label) for label, c in places.items()], F.monotonically_increasing_id().alias("uid")), "license-rows")
    blocks = rows.select("uid", F.explode("_lines").alias("words"))
    found = matching_blocks(blocks, templates, threshold).groupBy("uid").agg(F.collect_set("label").alias("_found"), F.max("share").alias("_share"))
    of = lambda field: [F.col(f"`{label}`.{field}") for label in places]
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`{label}`").isNotNull(), F.lit(label)) for label in places])))
    out = rows.join(found, "uid", "left")
    n_base = sum((F.coalesce(c, F.lit(0)) for c in of("n")), F.lit(0)).cast("bigint")
    both = F.array_sort(F.array_union(base, F.coalesce("_found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.least(*of("first")).alias("first_word"), F.greatest(*of("last")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))


def _oracle() -> str:
    word = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rows = ", ".join(f"('{k}', [{', '.join(chr(39) + w + chr(39) for w in template_words(t))}])" for k, t in TEMPLATES.items())
    hits = [(label, p.split(" ")) for p, label in PHRASES.items()]
    starts = ", ".join(f"[i for i in range(1, len(w) + 1) if {' AND '.join(f'w[i + {j}] = {chr(39)}{x}{chr(39)}' for j, x in enumerate(p))}] AS p{k}" for k, (_, p) in enumerate(hits))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(hits))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {word.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {starts} FROM d),
q AS (SELECT doc_id, n_words, list_concat(list_concat(p0, p1), p2) AS s, [x for x in [{labels}] if x IS NOT NULL] AS base FROM p),
tpl(label, words) AS (VALUES {rows}),
lin AS (SELECT doc_id, list_distinct({word.format("l")}) AS words FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
met AS (SELECT doc_id, label, len(list_intersect(lin.words, tpl.words)) AS c, len(tpl.words) AS n FROM lin, tpl),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(c / n) AS share FROM met WHERE 1000 * c >= {round(THRESHOLD * 1000)} * n GROUP BY doc_id)
SELECT q.doc_id, n_words, len(s) AS n_base, list_min(s) - 1 AS first_word, list_max(s) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, []::VARCHAR[])))), ',') AS labels,
       CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN f ON q.doc_id = f.doc_id
"""


ORACLE = _oracle()
