"""Operators for training data against brute force, on small tables with nulls, empty texts, ties and repeats."""
import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, context_mix, host_quality, license_scan, line_chunks, mixing, radix_dedup, simhash, suffix_dedup, warc

DOCS = "doc_id long, text string, source string, size long, kept string, shard string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empties, a long text, repeated rows and ids, clashing extra columns."""
    base = [words(80, i) for i in range(12)]
    long = "\n".join(words(30, 100 + i) for i in range(200))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[3]), (21, base[3].replace(" ", " \t ")), (22, base[4] + " tail"), (23, None), (24, ""), (25, "  \n "), (26, "short"), (27, "Short"),
             (28, long), (29, long + "\nlast line"), (20, base[3]), (31, "é" * 60 + " ünï " + base[5]), (None, base[6]), (None, "only here " + words(60, 77)), (33, "\n".join([words(9, 5)] * 8))]
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else f"s{k % 3}", 1, "x", "y") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- exact duplicates
def test_radix_dedup(docs, empty):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in radix_dedup.exact_dedup(docs).collect())
    kept = [r for r in radix_dedup.exact_dedup(docs).collect() if r.kept]
    rows = [(i, SPACE.sub(" ", t or "")) for i, t in pairs(docs)]
    size = Counter(t for _, t in rows)
    least = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in size}
    assert got == Counter((i, least[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter(r.text_sha256 for r in kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in size)
    assert radix_dedup.exact_dedup(empty).count() == 0


def test_radix_dedup_splits_late(spark):
    """Texts of one length that differ in the last byte only, in groups larger than one."""
    body = "a" * 5000
    rows = [(i, body + "xyz"[i % 3]) for i in range(9)] + [(9, body + "w")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 3, 3) for i in range(9)} | {9: (9, 1)}


# ---------------------------------------------------------------- near duplicates
def brute_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints, k):
    """Fingerprint -> smallest index reachable."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            low = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= k)
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("width,k,parts", [(3, 2, 3), (3, 2, 5), (2, 6, None)])
def test_near_duplicates(docs, width, k, parts):
    rows = pairs(docs)
    prints = [brute_fingerprint(t, width) for _, t in rows]
    label = components(prints, k)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = Counter((rows[i][0], f"{prints[i]:016x}", least[label[i]]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, width=width, k=k, parts=parts).collect()) == want


def test_near_duplicates_hot_value_and_empty(spark, empty):
    """A dense cloud of fingerprints around one, more than a cell holds: links equal those of all pairs."""
    rng = np.random.default_rng(3)
    prints = {0} | {sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(1500)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(a, b) for a, b in simhash.near_links(fps, 1, 3).collect()]
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() >= 1 for a, b in links)
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        label[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == components(prints, 1)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_representatives_keep_one(docs):
    kept = simhash.representatives(docs)
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)


def test_thresholds_are_complete():
    """Whatever the counts, thresholds add up to k - m + 1."""
    rng = np.random.default_rng(0)
    for k, widths in ((2, [22, 21, 21]), (5, [13] * 5), (3, [32, 32])):
        t = simhash._choose(rng.integers(1, 10**6, (50, len(widths))).astype(float), widths, k)
        assert (t.sum(axis=1) == k - len(widths) + 1).all() and t.min() >= -1


# ---------------------------------------------------------------- byte-level BPE
@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Encoder(data, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(encoder):
    ours, theirs = encoder
    r = random.Random(1)
    texts = ["", "a", "ab", "a" * 4097, "<|endoftext|>", "naïve  \t\n 日本語 🙂‍↔️ \x00\x1c\x85", "the " * 500]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xA0, 0x500), r.randrange(0x4E00, 0x4F00)))) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    texts += ["a" * k for k in range(1, 70)] + ["".join(r.choice("abßé漢q") for _ in range(r.randrange(1, 90))) for _ in range(400)]
    for t, (ids, written) in zip(texts, ours.encode(texts), strict=True):
        assert ids == theirs.encode_ordinary(t) and written == ",".join(map(str, ids)) and ours.decode(ids) == t.encode()


def test_bpe_in_lockstep_is_bpe_one_by_one(encoder):
    r = random.Random(2)
    for leaves in (2, 4, 8, 64):
        pieces = ["".join(r.choice("abest éq") for _ in range(leaves)).encode()[:r.randrange(leaves // 2 + 1, leaves + 1)] for _ in range(200)]
        assert encoder[0].merged_together(pieces, leaves) == [encoder[0].merged(p) for p in pieces]


def test_bpe_remembers_two_generations(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = [words(30, s, vocabulary=400) + " qxz" * s for s in range(12)]
    ours = bpe.Encoder.__new__(bpe.Encoder)
    ours.__dict__.update(encoder[0].__dict__, known={}, before={})
    assert [ids for t in texts for ids, _ in ours.encode([t])] == [encoder[1].encode_ordinary(t) for t in texts]
    assert len(ours.known) <= 5 and len(ours.before) <= 5


def test_tokenized_with_and_without_ids(spark, encoder):
    rows = [(i, None if i % 7 == 3 else words(i % 50, i)) for i in range(300)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {i: encoder[1].encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: r.ids for r in bpe.tokenized(df, path, public_tokenizers.PATTERN).collect()} == want
    assert {r.doc_id: r.n_tokens for r in bpe.tokenized(df, path, public_tokenizers.PATTERN, with_ids=False).collect()} == {i: len(x) for i, x in want.items()}


def test_tokenized(docs, empty, encoder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.tokenized(docs, path, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "source", "size", "kept", "shard", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = Counter((i, tuple(encoder[1].encode_ordinary(t or ""))) for i, t in pairs(docs))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in got.collect())
    assert bpe.tokenized(empty, path, public_tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- quality rules
def test_quality(docs, empty):
    def brute(t):
        t = t or ""
        w = [x for x in SPACE.split(t) if x]
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)

    got = host_quality.judged(docs).collect()
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[k] for k in keys)) for r in got) == Counter((i, *brute(t)) for i, t in pairs(docs))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert host_quality.judged(empty).count() == 0


def test_bad_host_rejects_soft_failures_only(spark):
    good, noisy = words(80, 1, 10**6), words(60, 2, 10**6) + " ###" * 40
    rows = [(i, noisy if i % 10 else words(80, i, 10**6), "bad") for i in range(60)] + [(100 + i, words(80, 200 + i, 10**6) if i else noisy, "fine") for i in range(60)] + [(200, good, "tiny")]
    got = {r.doc_id: r for r in host_quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1].kept and got[0].kept and got[100].kept and got[100].soft_failed and got[200].kept and got[1].bad_host and not got[100].bad_host


def test_host_verdict_follows_the_prior(spark):
    """Hosts of equal rates reject nothing; of hosts at realistic rates only the one that stands out does."""
    good, junk = " ".join(f"word{i}" for i in range(70)), " ".join(f"word{i} ####" for i in range(70))
    rows = [(1000 * h + i, junk if i < (60 if h == 7 else 20) else good, f"h{h}") for h in range(10) for i in range(200)]
    got = host_quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source for r in got if r.bad_host} == {"h7"}
    assert sorted(r.doc_id for r in got if not r.kept) == list(range(7000, 7060)) == sorted(r.doc_id for r in got if r.host_decided)
    even = [(i, t, h) for i, t, h in rows if h != "h7"]
    assert all(r.kept for r in host_quality.judged(spark.createDataFrame(even, "doc_id long, text string, source string")).collect())


# ---------------------------------------------------------------- licences
def test_licenses(spark, docs, empty):
    texts = ["Licensed CC-BY, cc by\ncc by 4", "GNU general\npublic license; All Rights reserved.", "x Released under the MIT license", "license the under mit released y", "cc by cc", "", None]
    got = [tuple(r) for r in license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == (0, 8, 3, 1, 5, "cc-by", "cc-by", 1.0)
    assert got[1][1:6] == (7, 2, 1, 4, "gpl,reserved") and got[2][5:] == ("", "mit", 1.0) and got[3][5:] == ("", "mit", 1.0)
    assert got[4][2:5] == (1, 0, 0) and got[5] == got[6]._replace(0) if hasattr(got[5], "_replace") else got[5][1:] == got[6][1:] == (0, 0, None, None, "", "", 0.0)
    assert license_scan.licenses(docs).count() == docs.count() and license_scan.licenses(empty).count() == 0


def test_similarity_join_is_exact(spark):
    r = random.Random(4)
    templates = {f"t{k}": " ".join(r.sample([f"v{i}" for i in range(30)], r.randrange(4, 9))) for k in range(6)}
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    blocks = [(i, r.sample(vocabulary, r.randrange(1, len(vocabulary)))) for i in range(200)]
    got = {(x.uid, x.label) for x in license_scan.matching_blocks(spark.createDataFrame(blocks, "uid long, words array<string>"), templates, 0.7).collect()}
    want = {(i, k) for i, w in blocks for k, t in templates.items() if len(set(w) & set(t.split())) * 1000 >= 700 * len(set(t.split()))}
    assert got == want


# ---------------------------------------------------------------- line chunks
def brute_chunks(rows, window, divisor, least):
    def ends(lines):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
        out = []
        for i in range(len(lines)):
            mix = xxhash.xxh64_intdigest(struct.pack("<q", 0), 42)
            if i >= window - 1:
                mix = 0
                for back in range(window):
                    seed = xxhash.xxh64_intdigest(struct.pack("<q", mix), 42)
                    mix = xxhash.xxh64_intdigest(struct.pack("<Q", h[i - back]), seed)
                    mix = mix - (1 << 64) if mix >> 63 else mix
            if i == len(lines) - 1 or i >= window - 1 and mix % divisor == 0:
                out.append(i)
        return out

    texts = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda x: (x[0], x[1] or 0))
    places = {}
    for no, i, t in texts:
        lines, start = t.split("\n"), 0
        for e in ends(lines):
            chunk = "\n".join(lines[start:e + 1])
            if e - start + 1 >= least and SPACE.sub("", chunk):
                places.setdefault(chunk, []).append((no, i, t, start, e - start + 1))
            start = e + 1
    gone = {}
    for at in places.values():
        first = min(at, key=lambda x: (x[0], x[1] or 0, x[3]))
        for no, i, t, start, n in at:
            if (no, i, t, start) != first[:4]:
                gone.setdefault((i, t), set()).update(range(start, start + n))
    return Counter((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in ((i, t or "") for i, t in rows))


def test_line_chunks(spark, empty):
    r = random.Random(8)
    pool = [words(6, k) for k in range(60)]
    passage = pool[:12]
    rows = [(i, "\n".join([words(5, 1000 + i)] * (i % 2) + [r.choice(pool) for _ in range(r.randrange(3))] + passage + [words(4, 2000 + i)])) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n\n"), (43, "\n\n\n"), (5, rows[5][1]), (None, rows[7][1]), (44, "one line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_chunks.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks"]
    assert Counter((x.doc_id, x.text or "") for x in got.collect()) == brute_chunks(rows, line_chunks.WINDOW, line_chunks.DIVISOR, line_chunks.MIN_LINES)
    clashing = line_chunks.dedup_lines(df, digest=lambda c: F.length(c).cast("bigint") % 7)  # several texts to a hash
    assert sorted(clashing.collect(), key=str) == sorted(got.collect(), key=str)
    assert got.agg(F.sum("n_removed_lines")).first()[0] > 30 and got.where("text is null").count() == 1
    assert line_chunks.dedup_lines(empty).count() == 0


# ---------------------------------------------------------------- mixing
def test_targets_share_the_excess():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 2010, 3) == pytest.approx([30, 1320, 660])
    assert mixing.targets([], [5, 2, 1], 0, 3) == [] and mixing.targets([0, 0], [5, 2], 0, 3) == [0, 0]


def test_splitting_tree_is_exact():
    quotas = np.array([7, 0, 1000, 31])
    got = mixing.split_quotas(quotas, 13, np.random.Generator(np.random.PCG64(1)))
    assert (got.sum(axis=0) == quotas).all() and got.min() >= 0 and np.ptp(got.sum(axis=1)) <= 4


def test_mixed_query_returns_what_the_tree_drew(spark):
    docs = spark.createDataFrame([(i, words(20 + i % 50, i), "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(3000)], "doc_id long, text string, source string")
    size = F.regexp_count("text", F.lit(r"\S+")).cast("bigint")
    plans = {p.source: p for p in mixing.plan(mixing._keyed(docs, "doc_id", "source", size, 9), "source", (5, 2, 1), 3.0, 32, 9)}
    source = {r.doc_id: r.source for r in docs.collect()}
    block = {r.doc_id: r._block for r in mixing._keyed(docs, "doc_id", "source", size, 9).collect()}
    for r in mixing.mixed_query(docs).collect():
        p = plans[source[r.doc_id]]
        want = [str(s[block[r.doc_id]]) for s in p.shards[:r.n_copies]]
        assert r.shards.split(",") == want if want else r.shards == ""
    owed = {s: sum(map(len, p.shards)) for s, p in plans.items()}
    drawn = mixing.split_quotas(np.array([owed[s] for s in plans]), 32, np.random.Generator(np.random.PCG64(9)))
    for k, p in enumerate(plans.values()):
        assert Counter(x for c in p.shards for x in c) == Counter({s: int(n) for s, n in enumerate(drawn[:, k]) if n})


def test_mixed(spark, docs, empty):
    many = spark.createDataFrame([(i, words(20 + i % 50, i), "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.mixed(many)
    rows = mix.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    aim = dict(zip(names, mixing.targets([sizes[s] for s in names], [5, 2, 1, 5], sum(sizes.values()), 3)))
    taken = Counter()
    for r in rows:
        taken[r.source] += r.size * len(r.copies)
        assert len(r.copies) <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(aim[r.source])
    assert all(abs(taken[s] - aim[s]) <= 0.01 * aim[s] + 70 for s in names)
    again = {r.doc_id: r.copies for r in mixing.mixed(many.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert mixing.emit(mix).count() == sum(len(r.copies) for r in rows)
    shards = Counter(c.shard for r in rows for c in r.copies)
    assert len(shards) == 32 and max(shards.values()) < 1.6 * min(shards.values())
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(empty).count() == 0


# ---------------------------------------------------------------- WARC
def test_warc_many_records(spark):
    """Record separators fall on the ends of read buffers, behind bodies that end in line ends."""
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("concat(id, repeat('a', cast(id % 61 as int)), '\\r\\n')").alias("html")).coalesce(1)
    got = warc.archived_pages(pages)
    assert got.count() == 12_000 and got.where("problem is not null or record_type <> 'response'").count() == 0


def test_warc_round_trip(spark):
    tricky = "x" * 5 + "\r\n\r\nWARC/1.1\r\n" + "é" * 30_000 + "WARC/1.1\r\n\r\n"
    rows = [(1, "http://a/", "one"), (2, "http://b/\r\nX: y", "one"), (3, None, tricky), (4, "http://d/", tricky), (5, "u", None), (6, "u", ""), (7, "v", "z" * 100_000), (None, "n", "null id"), (8, "r", "same"), (8, "r", "same")]
    got = Counter(tuple(r) for r in warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=8_000).collect())
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        response = i == top[h or ""] or top[h or ""] == -1
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""], None)] += 1
    assert got == want
    few = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), revisit_bytes=4)
    assert {r.page_id for r in few.collect() if r.record_type == "revisit"} == {3}
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reassembly_reports_faults():
    page = {"uuid": "u", "url": "x", "payload": b"p" * 50_000, "page_id": 1, "revisits": False, "refers_to": 1}
    parts = [dict(zip(warc.READ.names, warc.parse_record((r + b"\n").removeprefix(warc.VERSION)))) for r in warc.records(page, 9_000)]
    assert [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and {p["origin"] for p in parts} == {"<urn:uuid:u>"}
    random.Random(1).shuffle(parts)
    block, problem = warc.reassemble(parts)
    assert problem is None and warc.body(block) == page["payload"]
    last = max(parts, key=lambda p: p["segment"])
    assert warc.reassemble([p for p in parts if p["segment"] != 2])[1] and warc.reassemble([p for p in parts if p is not last])[1]
    assert warc.reassemble([*parts, parts[0]])[0] == block
    assert warc.reassemble([p | {"total": 3} if p is last else p for p in parts])[1] == "total length differs"
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nabc")
    assert warc.unframe(b"3;x=y\r\nabc\r\n0\r\nTrailer: v\r\n\r\n") == b"abc"


# ---------------------------------------------------------------- context mixing
def test_context_mixing(spark, docs, empty):
    rows = pairs(docs)
    got = context_mix.scored(docs).collect()
    train = [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t.encode().lower().split(), 1])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), 1]
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and (r.n_bytes == 0) == (r.bits_per_byte is None) for r in got)
    assert np.mean([r.bits_per_byte for r in got if r.n_bytes > 300]) < 4
    assert context_mix.scored(empty).count() == 0


def test_weights_are_learned_from_all_training_texts(spark, monkeypatch):
    seen = []

    def learn(texts, counts):
        seen.append(texts.count())
        raise StopIteration

    monkeypatch.setattr(context_mix, "train_mixer", learn)
    monkeypatch.setattr(context_mix, "train_counts", lambda texts: np.zeros((2, 1), np.float32))
    big = spark.range(70).selectExpr("id AS doc_id", "repeat('some words ', 100000) AS text")
    with pytest.raises(StopIteration):
        context_mix.scored(big)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(70))]


def test_mini_batches_grow_and_hold_every_byte():
    texts = [b"x" * 1000] * 400
    sizes = [sum(len(p[2]) for p in parts) for parts in context_mix._batches_of(iter(texts), 4000, 20_000)]
    assert sum(sizes) == 400 * 1001 and sizes[0] < 6000 and max(sizes) > 19_000 and max(sizes) < 22_000


def test_bits_are_a_distribution():
    """Over all next bytes the probabilities add up to one, and a text cut in parts scores as a whole."""
    counts = np.zeros((2, context_mix.STARTS[-1]), np.float32)
    texts = [words(400, s).encode() for s in range(4)]
    for parts in context_mix.grouped_parts(texts):
        g, w, _ = context_mix.contexts(parts)
        order, first, times = context_mix.distinct(g, w)
        context_mix.count_bits(g[order[first]], w[order[first]], times, counts)
    learner = context_mix.Mixer(counts)
    learner.learn(g, w, np.ones(len(g), np.int64))
    mixer = context_mix.Mixer.frozen(*context_mix.log_odds(counts), learner.weights, learner.refined)
    grams, word = g[1000] & ~np.uint64(0xFF) | np.arange(256, dtype=np.uint64), np.full(256, w[1000])
    assert (10 ** mixer.cost(grams, word)).sum() == pytest.approx(1, abs=1e-3)
    whole = context_mix.score_texts(texts, mixer)
    cut = context_mix.PIECE
    try:
        context_mix.PIECE = 700
        assert context_mix.score_texts(texts, mixer) == pytest.approx(whole)
    finally:
        context_mix.PIECE = cut


def test_neighbours_share_the_bits_in_which_they_agree():
    """Contexts are ordered so that common bits are looked up once; costs are those of each context alone."""
    parts = [p for ps in context_mix.grouped_parts([words(400, s).encode() for s in range(4)]) for p in ps]
    g, w, _ = context_mix.contexts(parts)
    order, first, times = context_mix.distinct(g, w)
    assert times.sum() == len(g) and len(first) == len(set(zip(g.tolist(), w.tolist())))
    g, w = g[order[first]], w[order[first]]
    assert sum(map(len, context_mix.shared_bits(g, w))) < 7 * len(g)
    counts = np.zeros((2, context_mix.STARTS[-1]), np.float32)
    context_mix.count_bits(g, w, times, counts)
    mixer = context_mix.Mixer.frozen(*context_mix.log_odds(counts))
    some = slice(100, 140)
    assert mixer.cost(g, w)[some] == pytest.approx(np.concatenate([mixer.cost(g[i:i + 1], w[i:i + 1]) for i in range(100, 140)]))
    odds, level = context_mix.without_own(np.array([[3, 1], [1, 0]], np.float32))
    assert odds == pytest.approx(np.log([1.4 / 2.4, 0.4 / 0.4, 0.4 / 3.4, 0.4 / 1.4])) and level.tolist() == [2, 0, 2, 1]



def test_slots_hold_log_odds_and_levels_side_by_side():
    counts = np.array([[3, 0, 900, 0], [1, 0, 0, 70]], np.float32)
    for odds, level in (context_mix.log_odds(counts), context_mix.without_own(counts)):
        slots, kind = context_mix.side_by_side(odds, level), f"{odds.itemsize}"
        assert slots.itemsize == 2 * odds.itemsize and len(slots) == len(odds)
        assert slots.astype("u" + kind).view("f" + kind).tolist() == odds.tolist()
        assert (slots >> slots.dtype.type(8 * odds.itemsize)).tolist() == level.tolist()


# ---------------------------------------------------------------- substrings
def brute_removed(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b, hit = (t or "").encode(), set()
        fresh = []
        for at in range(len(b) - width + 1):
            s = b[at:at + width]
            if s in seen or s in fresh_set(fresh, at):
                hit.update(range(at, at + width))
            fresh.append(s)
        seen.update(fresh)
        out[i] = (len(b), hit, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in hit)).hexdigest())
    return out


def fresh_set(fresh, at):
    if not hasattr(fresh_set, "of") or fresh_set.of[0] is not fresh:
        fresh_set.of = (fresh, set(), 0)
    own, done = fresh_set.of[1], fresh_set.of[2]
    own.update(fresh[done:at])
    fresh_set.of = (fresh, own, at)
    return own


def test_suffix_dedup(spark, empty):
    r = random.Random(5)
    passage, other = words(40, 1), words(70, 2)
    rows = [(k, " ".join([words(r.randrange(1, 60), 50 + k), passage if k % 2 else other[r.randrange(50):], words(r.randrange(1, 40), 90 + k)])) for k in range(24)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, None), (33, ""), (34, "ab" * 300), (35, "z" * 99), (36, "z" * 100), (37, "z" * 101), (38, "é" * 90), (39, "é" * 60), (40, passage + "x" + passage)]
    got = {x.doc_id: x for x in suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (n, hit, sha) in brute_removed(rows, 100).items():
        spans = sum(k - 1 not in hit for k in hit)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, len(hit), spans, sha), i
    assert suffix_dedup.substring_dedup(empty).count() == 0


def test_suffix_dedup_repeated_and_null_ids(spark):
    t = words(60, 9)
    got = [(x.doc_id, x.n_removed) for x in suffix_dedup.substring_dedup(spark.createDataFrame([(None, t), (2, t), (2, t)], "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(2, 0), (2, len(t)), (None, len(t))], key=str)


def test_suffix_dedup_cuts_common_classes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)  # every class with two bundles is cut into single strings
    line = words(20, 3)[:60]
    rows = [(k, f"{words(12, 200 + k)} {line} {words(12, 300 + k // 2)}") for k in range(30)] + [(40, words(60, 4)), (41, words(60, 4))]
    got = {x.doc_id: x for x in suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (n, hit, sha) in brute_removed(rows, 100).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (n, len(hit), sha), i
    assert got[1].n_removed > 100 and got[41].n_removed == len(rows[-1][1])


def test_suffix_dedup_packs_suffixes(spark, tmp_path, monkeypatch):
    # One row per place and level took many times the text; a row now holds the suffixes of a bundle.
    rows = [(k, words(150, k) + " " + words(150, 500 + k // 3)) for k in range(60)]
    spaces = iter(range(100))
    monkeypatch.setattr("plumbline.sources.tables.scratch_path", lambda spark, name: str(tmp_path / f"{next(spaces)}"))
    monkeypatch.setattr("plumbline.llm.util.scratch_path", lambda spark, name: str(tmp_path / f"{next(spaces)}"))
    got = suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg({"n_removed": "sum"}).first()[0]
    assert got == sum(len(hit) for _, hit, _ in brute_removed(rows, 100).values()) > 0
    stored = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert stored < 3 * sum(len(t) for _, t in rows)


def test_suffix_order_and_bundles_by_brute_force(monkeypatch):
    r = random.Random(8)
    for alphabet, width, n in ((b"ab", 9, 700), (b"abc", 20, 900), (b"a", 100, 300), (bytes(range(256)), 100, 400), (b"ab", 5, 60)):
        data = bytes(r.choice(alphabet) for _ in range(n))
        data += data[n // 3:n // 2] + data[:n // 4]
        starts = np.array(sorted(r.sample(range(len(data) - width + 1), max(1, (len(data) - width) // 2))))
        seen, want = set(), []
        for s in starts.tolist():
            want.append(data[s:s + width] in seen)
            seen.add(data[s:s + width])
        assert suffix_dedup.repeated_places(data, starts, width).tolist() == want
    texts = [words(r.randrange(1, 90), s).encode() for s in range(9)] + [b"z" * 300, b"", b"z" * 99]
    want = sorted((i, s, t[s:s + 100]) for i, t in enumerate(texts) for s in range(len(t) - 99))
    for piece in (1 << 20, 150):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        got, classes = [], {}
        for data, lengths, numbers, firsts in suffix_dedup.pieces(texts, 100):
            begin = np.cumsum(lengths) - lengths
            _, owner, start, n, h = suffix_dedup.bundles(data, lengths, 100, 24)
            for o, s, m, c in zip(owner.tolist(), start.tolist(), n.tolist(), h.tolist()):
                for at in range(s, s + m):
                    got.append((numbers[o], at - int(begin[o]) + firsts[o], data[at:at + 100]))
                    assert classes.setdefault(data[at:at + 100], c) == c  # equal strings meet in one class
        assert sorted(got) == want
