import hashlib
import re

from pyspark.sql import functions as F

from linecensus.llm import exact_dedup as D
from tests.llm import frames


def brute_force(rows):
    """(doc_id, keep_id, group_size, kept, digest) sorted."""
    groups = {}
    for doc_id, text, *_ in rows:
        norm = re.sub("[\\x20\\x09-\\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = members[0][3]
        for i, member in enumerate(members):
            digest = hashlib.sha256(norm.encode()).hexdigest()
            out.append((member[3], keep, len(members), i == 0, digest))
    return sorted(out, key=repr)


def collected(frame):
    columns = ("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_awkward_rows(spark):
    assert collected(D.exact_dedup(frames.docs(spark))) == brute_force(frames.ROWS)


def test_empty_table(spark):
    assert D.exact_dedup(frames.empty(spark)).collect() == []


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = [(i, text, "en") for i, text in enumerate(["ab", "cd", "a b", "ab", "ef", "c\td"])]
    weak = lambda text: F.unhex(F.lpad(F.char_length(text).cast("string"), 4, "0"))
    found = D.exact_dedup(frames.docs(spark, rows), digest=weak)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()}
    expected = {r[0]: r[1:4] for r in brute_force(rows)}
    assert got == expected


def test_state_is_kept_between_calls(spark, tmp_path):
    """A later call adds files to the fingerprints it has seen; nothing expires."""
    folder, checkpoint = str(tmp_path / "prints"), str(tmp_path / "state")
    for part in ([(5, "same text", "en"), (6, "other", "en")], [(3, "same  text", "en"), (9, "other", "en")]):
        D.fingerprints(frames.docs(spark, part)).write.mode("append").parquet(folder)
        D.update_state(spark, spark.read.parquet(folder), folder, checkpoint)
    state = {r.keep_id: r.group_size for r in D.read_state(spark, checkpoint).collect()}
    assert state == {3: 2, 6: 2}
    assert D.read_state(spark, checkpoint).select("keep_file").distinct().count() == 2


def test_large_groups_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "COMPARED_ROWS", 10)
    texts = ["ab"] * 95 + ["a b"] * 4 + ["cd"] * 25 + ["ef g"]
    rows = [(i * 7 % 125, text, "en") for i, text in enumerate(texts)]
    weak = lambda text: F.unhex(F.lit("00"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_dedup(frames.docs(spark, rows), weak).collect()}
    assert got == {r[0]: r[1:4] for r in brute_force(rows)}


def test_identifiers_of_any_type(spark):
    named = frames.docs(spark).withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id")))
    name = lambda doc_id: None if doc_id is None else f"n{doc_id}"
    expected = [(name(a), name(b), *rest) for a, b, *rest in brute_force(frames.ROWS)]
    assert collected(D.exact_dedup(named)) == sorted(expected, key=repr)
