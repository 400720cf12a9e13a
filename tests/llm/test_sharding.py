import zlib

from linecensus.llm import sharding as S
from tests.llm import frames


def test_awkward_rows(spark):
    rows = S.histogram_shards(frames.docs(spark), 4).collect()
    assert len(rows) == len(frames.ROWS)
    texts = sorted((r.text or "").encode() for r in rows)
    assert texts == sorted((t or "").encode() for _, t, _ in frames.ROWS)
    places = {}
    for row in rows:
        data = (row.text or "").encode()
        assert row.size == len(data) + 16
        assert row.text_crc32 == zlib.crc32(data)
        places.setdefault(row.shard, []).append(row.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values())
    assert set(places) <= set(range(4))


def test_empty_table(spark):
    assert S.histogram_shards(frames.empty(spark), 4).collect() == []


def test_bytes_are_even_with_a_third_of_all_rows_equal(spark):
    rows = [(i, "the same text of a large group" if i % 3 == 0 else frames.invented(5, i), "en") for i in range(6000)]
    found = S.histogram_shards(frames.docs(spark, rows, clashing=False), 10)
    sizes = {r[0]: r[1] for r in found.groupBy("shard").agg({"size": "sum"}).collect()}
    largest = max(r.size for r in found.select("size").distinct().collect())
    share = sum(sizes.values()) / 10
    assert len(sizes) == 10
    assert all(abs(size - share) <= 2 * (largest + S.TOLERANCE * share) for size in sizes.values())


def test_small_groups_of_copies_stay_together(spark):
    rows = [(i, frames.invented(20, i // 3), "en") for i in range(9000)]
    found = S.histogram_shards(frames.docs(spark, rows, clashing=False), 8)
    parted = found.groupBy("text").agg({"shard": "max"}).join(
        found.groupBy("text").agg({"shard": "min"}), "text"
    )
    assert parted.filter("`max(shard)` <> `min(shard)`").count() == 0


def test_splitters_against_sorting(spark):
    rows = [(i, frames.invented(1 + i % 30, i), "en") for i in range(2000)]
    docs = frames.docs(spark, rows, clashing=False)
    keyed = docs.select(S.shard_key().alias("key"), S.row_size().alias("size"))
    pairs = sorted((r.key, r.size) for r in keyed.collect())
    total, below = sum(size for _, size in pairs), 0
    for i, bound in enumerate(S.splitters(keyed, 5, tolerance=0), start=1):
        below = sum(size for key, size in pairs if key < bound)
        best = min(
            abs(total * i / 5 - sum(size for _, size in pairs[:k])) for k in range(len(pairs) + 1)
        )
        assert abs(below - total * i / 5) == best
