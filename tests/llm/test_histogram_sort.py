"""Sharding by exact histograms against a sort in plain Python."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import histogram_sort as H

SCHEMA = "doc_id long, text string, shard string, _bucket int"


def bits(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def brute(rows, shards):
    """(doc_id, size, crc, shard) of every row, by the place of its middle byte in the whole sorted table."""
    rows = sorted(rows, key=lambda r: (bits(r[1] or ""), bits("" if r[0] is None else str(r[0]))))
    size = [len((t or "").encode()) + 8 for _, t in rows]
    total, below, out = sum(size), 0, []
    for (i, t), n in zip(rows, size):
        out.append((i, n, zlib.crc32((t or "").encode()), (2 * below + n) * shards // (2 * total)))
        below += n
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("aé𝄞bcd") * 3 for _ in range(n))
    hot = text(60)
    out = [(i, text(r.randrange(1, 90))) for i in range(500)] + [(500 + i, hot) for i in range(400)]  # one text in nearly half the rows
    out += [(7, "same row")] * 150  # rows that agree in id and text
    return out + [(2000, None), (2001, ""), (None, "no id"), (None, None), (2002, "x" * 20_000)]


@pytest.mark.parametrize("probes", [2, 256])
def test_sharded_equals_sort(spark, rows, probes):
    df = spark.createDataFrame([(i, t, "old", 5) for i, t in rows], SCHEMA).repartition(7)
    got = H.sharded(df, probes=probes).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == Counter(brute(rows, 24))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert {t for r in got for t in [r.text]} == {t for _, t in rows}
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 24
    hot = [k for k in range(24) if abs(size[k] - mean) > 600]
    assert len(hot) <= 7  # only around the one text that is larger than five shards


def test_buckets_do_not_show(spark, rows):
    """Many buckets in a shard give the same shards and gapless places."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.sharded(df, shards=5, with_text=False, bucket_bytes=2_000).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == Counter(brute(rows, 5))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r))
    for s in slots.values():
        s.sort(key=lambda x: x[0])
        assert [n for n, _ in s] == list(range(len(s)))
    order = [(r.doc_id, r.text_crc32) for k in sorted(slots) for _, r in slots[k]]
    assert order == [(i, c) for i, _, c, _ in brute(rows, 5)]


def test_tolerance_ends_early(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = Counter()
    for r in H.sharded(df, shards=4, tolerance=0.2, probes=4).collect():
        size[r.shard] += r.size
    mean = sum(size.values()) / 4
    assert all(abs(size[k] - mean) < 0.5 * mean for k in range(4))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.sharded(empty).count() == 0
    assert H.sharded(empty).columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    one = H.sharded(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r.size, r.text_crc32, r.shard, r.slot) for r in one] == [(8, 0, 12, 0)]
    with pytest.raises(ValueError):
        H.find_splitters(spark.range(3).selectExpr("id _k_text", "id _k_id", "id _k_row", "0 size"), 2, "size", 0.0)
