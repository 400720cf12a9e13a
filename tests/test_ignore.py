import random
import re

import pytest

from linecensus.functions.globs import glob_to_regex, parse_rule
from linecensus.operators import ignore as I

PATHS = [
    "a.py", "a.pyc", "build/x.rs", "src/build/y.rs", "src/a.py", "src/keep/a.pyc", "docs/x.md",
    "docs/sub/x.md", "src/main.rs", "src/deep/er/main.rs", "build.rs", "src/foo1.rs", "src/a[b.rs",
    ".hid/x.rs", "src/.x.rs", "node/mod/z.js", "node/mod/min/z.js",
]


def kept(spark, rules, paths=PATHS):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in I.ignore_rules(df, rules).collect()}


# Lines of a root ignore file and the paths they drop.
DROPPED = [
    (["*.pyc"], {"a.pyc", "src/keep/a.pyc"}),
    (["build/"], {"build/x.rs", "src/build/y.rs"}),
    (["/build/"], {"build/x.rs"}),
    (["build"], {"build/x.rs", "src/build/y.rs"}),
    (["docs/*.md"], {"docs/x.md"}),
    (["docs/**/*.md"], {"docs/x.md", "docs/sub/x.md"}),
    (["docs/**"], {"docs/x.md", "docs/sub/x.md"}),
    (["**/er/main.rs"], {"src/deep/er/main.rs"}),
    (["src/**/main.rs"], {"src/main.rs", "src/deep/er/main.rs"}),
    (["main.rs", "!/src/main.rs"], {"src/deep/er/main.rs"}),
    (["src/deep", "!src/deep/er/main.rs"], {"src/deep/er/main.rs"}),  # its directory stays ignored
    (["foo[0-9].rs", "a\\[b.rs"], {"src/foo1.rs", "src/a[b.rs"}),
    (["foo?.rs"], {"src/foo1.rs"}),
    (["# a.py", "", "   "], set()),
    (["a.py  "], {"a.py", "src/a.py"}),
    (["*.{js,md}"], {"docs/x.md", "docs/sub/x.md", "node/mod/z.js", "node/mod/min/z.js"}),
    (["[z"], set()),
    (["*", "!*.py", "!src/"], set(PATHS) - {"a.py", "src/a.py"}),
]


@pytest.mark.parametrize("lines, dropped", DROPPED)
def test_root_rules(spark, lines, dropped):
    assert kept(spark, I.parse_rules(spark, lines)) == set(PATHS) - dropped


def test_deeper_directory_and_higher_rank_win(spark):
    root = I.parse_rules(spark, ["*.rs"], "", I.RANK_GITIGNORE)
    deeper = I.parse_rules(spark, ["!main.rs"], "src", I.RANK_GITIGNORE)
    rs = {p for p in PATHS if p.endswith(".rs")}
    back = {"src/main.rs", "src/deep/er/main.rs"}
    assert kept(spark, root.unionByName(deeper)) == set(PATHS) - rs | back
    top = I.parse_rules(spark, ["main.rs"], "", I.RANK_IGNORE)
    assert kept(spark, root.unionByName(deeper).unionByName(top)) == set(PATHS) - rs


def test_shuffled_and_broadcast_rules_agree(spark):
    rules = I.parse_rules(spark, ["*.rs", "!/src/**"]).unionByName(
        I.parse_rules(spark, ["a*", "!*.py"], "src")
    )
    expected = kept(spark, rules)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert kept(spark, rules) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "globs, dropped",
    [
        (["*.pyc", "*.md"], {"a.pyc", "src/keep/a.pyc", "docs/x.md", "docs/sub/x.md"}),
        (["build/"], {"build/x.rs", "src/build/y.rs"}),
        (["build.rs/"], set()),
        (["/src/**"], {p for p in PATHS if p.startswith("src/")}),
        (["*.py*", "!*.py"], {"a.pyc", "src/keep/a.pyc"}),
        (["min"], {"node/mod/min/z.js"}),
    ],
)
def test_exclude_globs(spark, globs, dropped):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    assert {r.path for r in I.exclude_globs(df, globs).collect()} == set(PATHS) - dropped


def test_hidden_filter(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    shown = {r.path for r in I.hidden_filter(df).collect()}
    assert shown == set(PATHS) - {".hid/x.rs", "src/.x.rs"}
    assert I.hidden_filter(df, hidden=True).count() == len(PATHS)


def test_malformed_globs():
    assert glob_to_regex("[a") is None and glob_to_regex("{a") is None
    assert parse_rule("\\") is None and parse_rule("/") is None and parse_rule("#x") is None
    assert parse_rule("\\#x").pattern_regex == r"(?s)^(?:.*/)?#x\z"
    assert parse_rule("!a/").negated and parse_rule("!a/").dir_only


def test_rules_that_every_path_meets_need_no_join_key(spark):
    """Every file is below the root, so the rules there that have no key must not be met through one."""
    manifest = spark.range(200).selectExpr("concat('d', id % 3, '/f', id, '.rs') AS path")
    rules = I.parse_rules(spark, ["*[13579].rs", "*2.rs"])
    rows = rules.collect()
    assert [r.way for r in rows] == ["extension", "extension"]
    rules = rules.unionByName(I.parse_rules(spark, ["*[68].r?", "!*"], base_dir="d2"))
    rules = rules.unionByName(I.parse_rules(spark, ["*0.?s"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = {r.path for r in I.ignore_rules(manifest, rules).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == {f"d{i % 3}/f{i}.rs" for i in range(200) if i % 3 == 2 or i % 10 in (4, 6, 8)}


@pytest.mark.parametrize(
    "line, place",
    [
        ("target", ("", "name", "target", "", False, False)),
        ("*.tar.gz", ("", "extension", "gz", ".tar.gz", False, False)),
        ("temporary_*", ("", "prefix", "temporar", "temporary_", False, False)),
        ("/a/b/*.o", ("a/b", "extension", "o", ".o", True, False)),
        ("a/**/x.o", ("a", "name", "x.o", "", False, False)),
        ("a/**", ("a", "any", "", "", False, False)),
        ("a/*/x.o", ("a", "name", "x.o", "", False, True)),
        ("lib?.so", ("", "extension", "so", ".so", False, True)),
        ("ab[0-9]", ("", "prefix", "ab", "ab", False, True)),
        ("*~", ("", "any", "", "", False, True)),
        ("{a,b}.c", ("", "any", "", "", False, True)),
        ("a\\*", ("", "any", "", "", False, True)),
        ("/x", ("", "name", "x", "", True, False)),
        ("**", ("", "any", "", "", False, True)),
    ],
)
def test_keys_of_rules(line, place):
    assert tuple(parse_rule(line))[4:] == place


PIECES = ["a", "b", "ab", "*", "?", "**", "[ab]", "a*", "*b", "*.b", "a.b", "*.a.b", "{a,b}", "b?", "a.*", "."]


def decided_by_hand(lines, path, is_dir):
    """`negated` of the last matching line `(base, seq, rank, line)`, None without any."""
    best = None
    for base, seq, rank, line in lines:
        rule = parse_rule(line)
        if rule is None or (rule.dir_only and not is_dir) or (base and not path.startswith(base + "/")):
            continue
        relative = path[len(base) + 1 :] if base else path
        if re.match(rule.pattern_regex.replace(r"\z", r"\Z"), relative):
            found = (rank, base.count("/") + 1 if base else 0, seq, rule.negated)
            best = max(best, found) if best else found
    return best and best[3]


def test_random_rules_against_every_pattern(spark):
    chance = random.Random(11)
    names = ["a", "b", "ab", "a.b", "b.a.b", ".b", "ba", "abc", "c.", "x~"]
    paths = sorted({"/".join(chance.choices(names, k=chance.randint(1, 5))) for _ in range(400)})
    for _ in range(6):
        lines = []
        for seq in range(25):
            glob = "/".join(chance.choices(PIECES, k=chance.choice([1, 1, 2, 3])))
            line = chance.choice(["", "", "", "!"]) + chance.choice(["", "", "/"]) + glob + chance.choice(["", "", "", "/"])
            lines.append((chance.choice(["", "", "a", "a/b", "ab"]), seq, chance.choice([3, 4]), line))
        rows = [row for base, seq, rank, line in lines for row in I.rule_rows([line], base, rank)]
        rows = [(row[0], seq, *row[2:]) for row, seq in zip(rows, [s for b, s, r, l in lines if parse_rule(l)])]
        expected = set()
        for path in paths:
            parts = path.split("/")
            above = ["/".join(parts[:i]) for i in range(1, len(parts))]
            if not any(decided_by_hand(lines, folder, True) is False for folder in above):
                if decided_by_hand(lines, path, False) is not False:
                    expected.add(path)
        assert kept(spark, I.rules_table(spark, rows), paths) == expected


def test_twenty_thousand_rules(spark):
    """Rules of the first three kinds are met by key: no pattern is tested, however many there are."""
    manifest = spark.range(60_000).selectExpr(
        "concat('d', id % 50, '/s', id % 7, '/n', id, '_', id % 3, '.e', id % 400) AS path", "id"
    )
    lines = [f"n{i}_{i % 3}.e{i % 400}" for i in range(0, 60_000, 6)]  # names
    lines += [f"*.e{i}" for i in range(0, 400, 40)]
    lines += [f"n{i}*" for i in range(50_000, 60_000, 2)]
    lines += [f"/d{i}/s{j}/n1*" for i in range(50) for j in range(7)] + [f"none{i}/" for i in range(5_000)]
    rules = I.parse_rules(spark, lines).cache()
    assert rules.count() > 20_000 and rules.filter("tested OR way = 'any'").isEmpty()
    dropped = set(range(0, 60_000, 6)) | {i for i in range(60_000) if i % 400 % 40 == 0 or str(i).startswith("1")}
    dropped |= {i for i in range(50_000, 60_000, 2)}
    left = {r.id for r in I.ignore_rules(manifest, rules).select("id").collect()}
    assert left == set(range(60_000)) - dropped
    rules.unpersist()
