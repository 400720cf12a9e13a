import hashlib
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from linecensus.operators import incremental as C
from linecensus.operators import stats as S
from linecensus.plans.analyze import analyze_tree
from linecensus.sinks import cache_table as CA
from linecensus.sources import content as CT
from linecensus.sources.tree import scan_tree

MANIFEST = "root_id string, path string, size bigint, mtime bigint"


def entries(spark, rows, root="r", version=None):
    df = spark.createDataFrame(
        [(root, p, s, m, lang, n, n, 0, 0, s) for p, s, m, lang, n in rows],
        MANIFEST + ", language string, lines bigint, code bigint, comments bigint, blanks bigint, "
        "bytes bigint",
    )
    made = C.cache_entries(df, cached_at=1)
    return made if version is None else made.withColumn("version", C.F.lit(version))


@pytest.fixture
def cache(spark):
    return entries(spark, [("same", 1, 10, "Lua", 5), ("size", 1, 10, "Rust", 6),
                           ("mtime", 1, 10, "Rust", 7), ("gone", 1, 10, "Rust", 8)])


@pytest.fixture
def manifest(spark):
    rows = [("r", "same", 1, 10), ("r", "size", 2, 10), ("r", "mtime", 1, 11), ("r", "new", 1, 10)]
    return spark.createDataFrame(rows, MANIFEST)


def test_probe_hits_and_misses(spark, manifest, cache):
    probed = C.cache_probe(manifest, cache)
    assert {r.path: r.hit for r in probed.collect()} == {
        "same": True, "size": False, "mtime": False, "new": False,
    }
    hit = C.cache_hits(probed).first()
    assert (hit.path, hit.language, hit.lines) == ("same", "Lua", 5)  # the stored language
    assert {r.path for r in C.cache_misses(manifest, cache).collect()} == {"size", "mtime", "new"}
    rate = C.cache_hit_rate(probed).first()
    assert tuple(rate) == (1, 3, 3, 25.0)


def test_hit_rate_of_nothing_is_zero(spark, manifest, cache):
    assert C.cache_hit_rate(C.cache_probe(manifest.limit(0), cache)).first().hit_rate == 0.0
    empty = C.cache_probe(manifest, cache.limit(0))
    assert tuple(C.cache_hit_rate(empty).first()) == (0, 4, 4, 0.0)


def test_upsert_cleanup_validate(spark, manifest, cache):
    new = entries(spark, [("size", 2, 10, "Rust", 60), ("new", 1, 10, "Rust", 1)])
    merged = {r.path: r.stats.lines for r in C.cache_upsert(cache, new).collect()}
    assert merged == {"same": 5, "size": 60, "mtime": 7, "gone": 8, "new": 1}
    assert {r.path for r in C.cache_cleanup(cache, manifest).collect()} == {"same", "size", "mtime"}
    old = entries(spark, [("x", 1, 1, "Rust", 1)], version=0)
    other = entries(spark, [("y", 1, 1, "Rust", 1)], root="other")
    mixed = cache.unionByName(old).unionByName(other)
    assert C.cache_validate(mixed, "r").count() == 4


def test_modes(cache):
    assert C.cache_mode(cache, "reuse").count() == 4
    assert C.cache_mode(cache, "fresh").count() == C.cache_mode(cache, "rebuild").count() == 0
    with pytest.raises(ValueError):
        C.cache_mode(cache, "other")


def test_root_id(spark):
    row = spark.range(1).select(C.root_id(C.F.lit("/a/b")).alias("id")).first()
    assert row.id == "aee31d71a4dce5fe24481547cc863476"


def test_cache_table(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "cache")
    assert CA.load(spark, where, "r").count() == 0
    CA.save(spark, where, "r", entries(spark, [("a", 1, 1, "Rust", 1), ("b", 1, 1, "Rust", 1)]), False)
    CA.save(spark, where, "r", entries(spark, [("b", 2, 2, "Rust", 2)]), False)
    stored = {r.path: r.size for r in CA.load(spark, where, "r").collect()}
    assert stored == {"a": 1, "b": 2}
    assert CA.load(spark, where, "other").count() == 0
    # A run that failed before its commit is not read, and its number is not used again.
    os.makedirs(f"{where}/r/00000002-base")
    assert CA.load(spark, where, "r").count() == 2
    monkeypatch.setattr(CA, "MAX_DELTAS", 1)
    CA.save(spark, where, "r", entries(spark, [("c", 3, 3, "Rust", 3)]), False)
    kinds = [(number, kind) for number, kind, _, _ in CA._folders(spark, where, "r")]
    assert kinds == [(0, "base"), (1, "delta"), (2, "base"), (3, "base")]
    assert {r.path: r.size for r in CA.load(spark, where, "r").collect()} == {"a": 1, "b": 2, "c": 3}
    CA.save(spark, where, "r", entries(spark, [("d", 4, 4, "Rust", 4)]), True)
    assert {r.path for r in CA.load(spark, where, "r").collect()} == {"d"}


def test_damaged_cache_means_counting_again(spark, tmp_path):
    where = str(tmp_path / "cache")
    CA.save(spark, where, "r", entries(spark, [("a", 1, 1, "Rust", 1)]), False)
    folder = tmp_path / "cache/r/00000000-base"
    for part in folder.glob("*.parquet"):
        part.write_bytes(b"damaged")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert CA.load(spark, where, "r").count() == 0


def test_reuse_equals_fresh_after_edits(spark, tmp_path):
    rng = random.Random(5)
    root, where = tmp_path / "root", str(tmp_path / "cache")
    root.mkdir()
    clock = 1_700_000_000

    def write(name):
        nonlocal clock
        clock += 1
        text = "\n".join(rng.choice(["x", "// c", "", "/* o", "*/"]) for _ in range(rng.randrange(9)))
        (root / name).write_text(text)
        os.utime(root / name, (clock, clock))

    def rows(census):
        return sorted(tuple(r) for r in census.files.collect())

    for i in range(30):
        write(f"f{i}.rs")
    expected_hits = 0
    for _ in range(3):
        reuse = analyze_tree(spark, str(root), cache_dir=where)
        assert rows(reuse) == rows(analyze_tree(spark, str(root), mode="fresh"))
        assert reuse.reuse.first().hits == expected_hits
        names = sorted(p.name for p in root.iterdir())
        edited, deleted = rng.sample(names[:-3], 4), names[-3:]
        for name in edited:
            write(name)
        for name in deleted:
            (root / name).unlink()
        write(f"g{rng.randrange(10**9)}.py")
        expected_hits = len(names) - 4 - 3


def test_fresh_and_rebuild(spark, tmp_path):
    root, where = tmp_path / "root", str(tmp_path / "cache")
    root.mkdir()
    (root / "a.rs").write_text("x\n")
    analyze_tree(spark, str(root), cache_dir=where, mode="fresh")
    assert not os.path.exists(where)
    analyze_tree(spark, str(root), cache_dir=where)
    (root / "a.rs").rename(root / "b.rs")
    analyze_tree(spark, str(root), cache_dir=where)
    identity = os.listdir(where)[0]
    assert {r.path for r in CA.load(spark, where, identity).collect()} == {"a.rs", "b.rs"}  # stale stays
    rebuilt = analyze_tree(spark, str(root), cache_dir=where, mode="rebuild")
    assert rebuilt.reuse.first().hits == 0
    assert {r.path for r in CA.load(spark, where, identity).collect()} == {"b.rs"}


def test_second_granular_times_can_give_a_false_hit(spark, tmp_path):
    root, where = tmp_path / "root", str(tmp_path / "cache")
    root.mkdir()
    for text in ("x\n\n", "//\n"):
        (root / "a.rs").write_text(text)
        os.utime(root / "a.rs", ns=(0, 5_000_000_000 + len(text)))
        census = analyze_tree(spark, str(root), cache_dir=where)
    row = census.files.first()
    assert (row.code, row.comments) == (1, 0)  # still the counts of the first text


def test_unchanged_runs_write_nothing_and_old_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CA, "MAX_DELTAS", 2)
    root, cache = tmp_path / "root", tmp_path / "cache"
    root.mkdir()
    for run in range(9):
        (root / f"f{run}.rs").write_text("x\n" * (run + 1))
        for _ in range(2):  # the second time there is nothing new
            assert analyze_tree(spark, str(root), cache_dir=str(cache)).files.count() == run + 1
    (kept,) = [os.listdir(cache / name) for name in os.listdir(cache)]
    numbers = sorted(int(name.split("-")[0]) for name in kept)
    assert numbers == list(range(numbers[0], 9))  # one folder per run with something new
    assert sum(name.endswith("base") for name in kept) == 2


def test_a_cache_that_cannot_be_used_does_not_end_the_run(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root/a.rs").write_text("x\n")
    (tmp_path / "file").write_text("not a folder")
    with pytest.warns(UserWarning, match="cache could not be"):
        census = analyze_tree(spark, str(tmp_path / "root"), cache_dir=str(tmp_path / "file"))
    assert census.files.first().lines == 1


def test_verify_notices_an_edit_of_equal_size_and_second(spark, tmp_path):
    root, where = tmp_path / "root", str(tmp_path / "cache")
    root.mkdir()
    (root / "same.rs").write_text("x\n")
    hits = []
    for text in ("x\n\n", "//\n", "//\n"):
        (root / "a.rs").write_text(text)
        os.utime(root / "a.rs", ns=(0, 5_000_000_000))
        census = analyze_tree(spark, str(root), cache_dir=where, mode="verify")
        assert census.languages.first().comments == (text == "//\n")
        hits.append(census.reuse.first().hits)
    assert hits == [0, 1, 2]
    # Entries without a digest are no hits for verify, and those with one are for reuse.
    assert analyze_tree(spark, str(root), cache_dir=where).reuse.first().hits == 2
    (root / "b.rs").write_text("y\n")
    analyze_tree(spark, str(root), cache_dir=where)
    assert analyze_tree(spark, str(root), cache_dir=where, mode="verify").reuse.first().hits == 2
    assert analyze_tree(spark, str(root), cache_dir=where, mode="verify").reuse.first().hits == 3


def test_digest_of_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CT, "PIECE_BYTES", 10)
    texts = {"a.rs": b"0123456789" * 3 + b"x", "b.rs": b"", "c.rs": b"9876543210" + b"0123456789" * 2 + b"x"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    manifest = scan_tree(spark, str(tmp_path))
    (tmp_path / "c.rs").unlink()
    found = {r.path: r.digest for r in CT.content_digest(manifest, str(tmp_path)).collect()}
    for name in ("a.rs", "b.rs"):
        number = 0
        for at in range(0, max(1, len(texts[name])), 10):
            piece = hashlib.sha256(at.to_bytes(8, "big") + texts[name][at : at + 10]).digest()
            number ^= int.from_bytes(piece, "big")
        assert found[name] == f"{number:064x}"
    assert found["c.rs"] is None


def _entries(spark, names, code=1):
    rows = [("r", name, 1, 1, "Rust", (code, code, 0, 0, 1), 1, C.CACHE_VERSION) for name in names]
    return spark.createDataFrame(rows, C.CACHE_SCHEMA)


def test_runs_that_save_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CA, "MAX_DELTAS", 3)
    where = str(tmp_path)

    def save(i):
        CA.save(spark, where, "r", _entries(spark, [f"f{i}", f"g{i}"]), rebuild=False)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(save, range(18)))
    assert {r.path for r in CA.load(spark, where, "r").collect()} == {f"{c}{i}" for c in "fg" for i in range(18)}
    assert not [name for name in os.listdir(tmp_path / "r") if name.startswith("_run-")]


def test_entries_saved_while_a_base_is_written_stay_and_are_newer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CA, "MAX_DELTAS", 1)
    where, stage = str(tmp_path), CA._stage
    for name in "ab":
        CA.save(spark, where, "r", _entries(spark, [name]), rebuild=False)

    def staged_late(entries, home):
        target = stage(entries, home)
        monkeypatch.setattr(CA, "_stage", stage)
        monkeypatch.setattr(CA, "MAX_DELTAS", 9)
        CA.save(spark, where, "r", _entries(spark, ["a", "d"], code=7), rebuild=False)
        return target

    monkeypatch.setattr(CA, "_stage", staged_late)
    CA.save(spark, where, "r", _entries(spark, ["c"]), rebuild=False)
    assert {r.path: r.stats.code for r in CA.load(spark, where, "r").collect()} == {"a": 7, "b": 1, "c": 1, "d": 7}
    assert sorted(n for n in os.listdir(tmp_path / "r")) == ["00000000-base", "00000001-delta", "00000002-base", "00000002-delta"]


def test_a_name_that_is_taken_is_not_claimed(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "_SUCCESS").write_text(name)
    assert CA._claim(spark, str(tmp_path / "one"), str(tmp_path / "0"))
    assert not CA._claim(spark, str(tmp_path / "two"), str(tmp_path / "0"))
    assert sorted(os.listdir(tmp_path / "0")) == ["_SUCCESS"]
    assert (tmp_path / "two/_SUCCESS").read_text() == "two"


def test_tasks_have_equal_weight(spark, monkeypatch):
    monkeypatch.setattr(CT, "TASK_BYTES", 64 * 1024 * 1024)
    heavy = F.when(F.col("id") % 10 == 3, CT.PIECE_BYTES).otherwise(100_000)
    manifest = spark.range(3000).select(F.format_string("f%05d", "id").alias("path"), heavy.cast("bigint").alias("size"))
    packed = CT.pack_by_size(manifest)
    assert sorted(packed.columns) == ["path", "size"]
    weights = packed.groupBy(F.spark_partition_id()).agg(F.sum(F.col("size") + CT.OPEN_COST_BYTES).alias("w")).collect()
    assert packed.count() == 3000 and packed.select("path").distinct().count() == 3000
    weights = [r.w for r in weights]
    assert len(weights) > 8
    assert max(weights) <= 1.2 * sum(weights) / len(weights)
    assert CT.pack_by_size(manifest.limit(0)).count() == 0


def _totals_and_count(spark, where, root="r"):
    """Totals as stored, or None where they would be counted, and a full count of the entries."""
    current = CA.state(spark, where, root)
    stored = os.path.isdir(CA._totals_path(current[-1], current[:-1]).removeprefix("file:"))
    full = S.language_stats(C.entry_counts(CA.load(spark, where, root)))
    rows = [sorted(map(tuple, df.collect())) for df in (CA.totals(spark, where, root), full)]
    return stored, *rows


def test_running_totals_equal_a_full_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CA, "MAX_DELTAS", 3)
    where, chance = str(tmp_path), random.Random(2)
    assert CA.totals(spark, where, "r").collect() == []
    for run in range(6):
        rows = [(f"f{i}", i, run, chance.choice(["Rust", "Lua", "Go"]), run + i) for i in chance.sample(range(9), 3)]
        CA.save(spark, where, "r", entries(spark, rows), rebuild=run == 5)
        stored, running, full = _totals_and_count(spark, where)
        assert stored and running == full
    # The last file of a language goes.
    CA.save(spark, where, "r", entries(spark, [(row[0], 1, 9, "C", 4) for row in rows]), rebuild=False)
    assert [tuple(r)[:3] for r in CA.totals(spark, where, "r").collect()] == [("C", 3, 12)]


def test_totals_of_another_state_are_not_used(spark, tmp_path):
    where = str(tmp_path)
    for names in ("a", "b"):
        CA.save(spark, where, "r", _entries(spark, [names]), rebuild=False)
    # Another run's entries come between, as when a base is written at the same time.
    _entries(spark, ["a", "c"], code=5).withColumn("digest", F.lit(None).cast("string")).write.parquet(f"{where}/r/00000001-base")
    stored, running, full = _totals_and_count(spark, where)
    assert not stored and running == full
    CA.save(spark, where, "r", _entries(spark, ["d"]), rebuild=False)
    stored, running, full = _totals_and_count(spark, where)
    assert stored and running == full and running[0][1] == 4


def test_totals_of_a_tree_need_no_look_at_old_entries(spark, tmp_path, monkeypatch):
    where, tree = str(tmp_path / "cache"), tmp_path / "tree"
    tree.mkdir()
    for i in range(8):
        (tree / f"f{i}.rs").write_text("fn a() {}\n" * (i + 1))
    run = lambda: analyze_tree(spark, str(tree), cache_dir=where).files.count()
    run()
    root = hashlib.md5(os.fsencode(os.path.realpath(tree))).hexdigest()
    (tree / "f3.rs").write_text("// one\n\n")
    (tree / "new.lua").write_text("print(1)\n")
    loads, load = [], CA.load
    monkeypatch.setattr(CA, "load", lambda *args, **named: loads.append(args) or load(*args, **named))
    run()
    assert len(loads) == 1
    stored, running, full = _totals_and_count(spark, where, root)
    assert stored and running == full and [row[:3] for row in running] == [("Lua", 1, 1), ("Rust", 8, 34)]
