"""Row features from text: token sets, shingle fingerprints, key sets, descriptors, packed bits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.core import md5_number

WIDE = None  # no folding: elements are 60-bit hashes, so that every rare shingle stays rare

# The regular expressions of the key dictionary (name, pattern).
KEY_PATTERNS = (
    ("has_digit", r"[0-9]"),
    ("has_long_number", r"[0-9]{4,}"),
    ("has_upper_run", r"[A-Z]{2,}"),
    ("has_accent", r"[àâçéèêëîïôûùüÿñæœáíóúöäß]"),
    ("has_exclaim", r"!"),
    ("has_question", r"\?"),
    ("has_at_sign", r"@"),
    ("has_url", r"https?://"),
    ("has_newline", r"\n"),
    ("has_pipe", r"\|"),
    ("has_hash_run", r"#{3,}"),
    ("has_symbol_run", r"[$%&*]{3,}"),
    ("has_quote", r"\""),
    ("has_hyphen", r"-"),
    ("has_colon", r":"),
    ("has_long_word", r"[A-Za-z]{12,}"),
)

SPACES = "[ \\t\\r\\n]+"


def tokens(text: Column) -> Column:
    """Lower-case words in order, repeats kept."""
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def token_set(text: Column) -> Column:
    # without a null among them, sort_array gives the order of array_sort without its comparator
    return F.sort_array(F.array_distinct(tokens(text)))


def n_types(text: Column) -> Column:
    """Size of the token set, which need not be sorted for it."""
    return F.size(F.array_remove(F.array_distinct(F.split(F.lower(text), SPACES)), ""))


def _let(value: Column, body) -> Column:
    """Evaluate a costly expression once and use it several times (the optimizer merges projections)."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _fold(bits: Column, nbits: int | None) -> Column:
    return bits if nbits is None else bits % F.lit(nbits)


def shingles(words: Column, r: int) -> Column:
    """All runs of 1..r neighbouring tokens, joined by one space, repeats kept."""
    runs = [words]
    for n in range(2, r + 1):
        # a run of n is a run of n - 1 joined to the token that follows it
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs.append(
            F.zip_with(F.slice(runs[-1], F.lit(1), count), F.slice(words, F.lit(n), count),
                       lambda a, w: F.concat_ws(" ", a, w))
        )
    return F.concat(*runs)


def shingle_bits(df: DataFrame, ident: str, text: str, r: int = 2, nbits: int | None = 2048) -> DataFrame:
    """(id, bits): the distinct hashed shingles of each text, sorted."""
    # hashed after the explode, where the expressions are compiled; a text was one row, so its set is one too
    runs = _let(tokens(F.col(text)), lambda w: F.array_distinct(shingles(w, r)))
    each = df.select(F.col(ident), F.explode_outer(runs).alias("_s"))
    bit = _fold(md5_number(F.col("_s"), 15), nbits)
    if nbits is None:
        return each.groupBy(ident).agg(F.array_sort(F.collect_set(bit)).alias("bits"))
    # packed words have a fixed size and travel instead of the bits, which are read off again where a text's words meet
    words = each.select(ident, bit.alias("_b")).groupBy(ident, F.floor(F.col("_b") / 64).alias("_w")).agg(F.bit_or(_one("_b")).alias("_m"))
    held = F.sort_array(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("_w", "_m"))))
    places = F.sequence(F.lit(0), F.lit(63))
    read = lambda x: F.transform(F.filter(places, lambda i: F.call_function("getbit", x["_m"], i) == 1), lambda i: x["_w"] * 64 + i)
    return words.groupBy(ident).agg(held.alias("_h")).select(ident, F.flatten(F.transform("_h", read)).alias("bits"))


def shingle_counts(df: DataFrame, ident: str, text: str, r: int = 2, nbits: int | None = 2048) -> DataFrame:
    """(id, bit, n): how often each hashed shingle occurs."""
    each = df.select(F.col(ident), F.explode(_let(tokens(F.col(text)), lambda w: shingles(w, r))).alias("_s"))
    return (
        each.select(ident, _fold(md5_number(F.col("_s"), 15), nbits).alias("bit"))
        .groupBy(ident, "bit")
        .agg(F.count("*").alias("n"))
    )


def keyset_bits(text: Column, patterns=KEY_PATTERNS) -> Column:
    """Positions (from 0) of the dictionary patterns that occur in the text."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(i)) for i, (_, p) in enumerate(patterns)])
    return F.filter(hits, lambda b: b.isNotNull())


def descriptors(text: Column) -> dict[str, Column]:
    """Numeric descriptors of a text; a descriptor that is undefined for a row is null."""
    chars = F.length(text)
    n = F.when(chars > 0, chars)
    words = tokens(text)
    n_tok = F.when(F.size(words) > 0, F.size(words))

    def share(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(text, pattern, ""))) / n

    return {
        "n_chars": chars.cast("bigint"),
        "n_tokens": F.size(words).cast("bigint"),
        "n_types": F.size(F.array_distinct(words)).cast("bigint"),
        "type_token_ratio": F.size(F.array_distinct(words)) / n_tok,
        "mean_token_length": F.aggregate(
            words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w).cast("bigint")
        ) / n_tok,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "space_share": share("[ \\t\\r\\n]"),
        "punct_share": share("[.,;:!?]"),
    }


# The words the template key leaves out.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "a", "der", "die", "und", "de", "la", "le", "et", "el", "en", "y")
NO_TEMPLATE = "<none>"


def template_key(text: Column) -> Column:
    """Skeleton of a whole text without digits, punctuation and stop words, as an md5; one key where nothing is left."""
    plain = F.regexp_replace(F.lower(text), r"[0-9.,;:!?|#$%&*\"'()<>/@_=+-]+", " ")
    words = F.filter(F.split(plain, SPACES), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    key = lambda k: F.when(text.isNull() | (k == ""), F.lit(NO_TEMPLATE)).otherwise(F.md5(k))
    return _let(F.array_join(words, " "), key)


# ---------------------------------------------------------------- packed bits
def pack_bits(df: DataFrame, ident: str, bits: str, nbits: int = 2048) -> DataFrame:
    """(id, fp): set positions as ``nbits/64`` 64-bit words."""
    each = df.select(F.col(ident).alias("id"), F.explode_outer(bits).alias("b"))
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("b") / 64) == w, _one("b"))), F.lit(0).cast("bigint")) for w in range(nbits // 64)
    ]
    return each.groupBy("id").agg(F.array(*words).alias("fp"))


def _one(bit: str) -> Column:
    """A 64-bit word with the place of ``bit`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(bit) % 64).cast("int"))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto of two packed fingerprints; two empty ones have similarity 0."""
    both = popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = popcount(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return both / F.greatest(either, F.lit(1))
