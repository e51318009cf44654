"""The trigram index gives grep's rows and tests few files."""

import random

import pytest

from quern.operators import retrieval
from quern.operators.grep_index import GrepIndex, trigrams


def rows(df):
    return [(r.path, r.line_no, r.line) for r in df.collect()]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "needle", "hay", "ÄRGER", "straße", "𝄞x", "ab", "İx"]
    out = [(f"d{i % 7}/f{i:04d}{rng.choice(['.py', '.md', ''])}", "\n".join(" ".join(rng.choices(words[:3] + words[4:], k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8)))) for i in range(400)]
    out += [(f"d1/rare{i}.py", f"x\nthe NEEDLE {i}\nneed\nle") for i in range(5)] + [("e/null.py", None), ("e/empty.py", ""), ("e/split.py", "nee\ndle nee dle")]
    return spark.createDataFrame(out, "path string, text string")


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    return GrepIndex(spark, f"file://{tmp_path_factory.mktemp('grep')}/i").build(files)


@pytest.mark.parametrize("needle", ["needle", "alpha beta", "ärger", "STRASSE", "straße", "ab", "", "a", "nothing here", "𝄞x a", "le\nthe", "i̇x"])
def test_equals_a_scan(index, files, needle):
    assert rows(index.grep(needle)) == rows(retrieval.grep(files, needle))
    if needle in ("needle", "STRASSE", "ab"):
        assert rows(index.grep(needle, False)) == rows(retrieval.grep(files, needle, ignore_case=False))
        assert rows(index.grep(needle, True, [".py"], 5, 2)) == rows(retrieval.grep(files, needle, extensions=[".py"], max_hits=5, max_files=2))


def test_few_files_are_tested(index, files):
    got, n = index.grep_counted("NEEDLE")
    assert got.count() == 5 and n <= 6 < files.count()
    assert index.grep_counted("zzz")[1] == 0


def test_trigrams_stay_within_lines():
    assert len(trigrams("ab\ncd")) == 0 and len(trigrams("abc\nabc")) == 1 and len(trigrams("ab")) == 0


def test_postings_are_packed_by_block(spark, index, files):
    """A row holds the trigrams of a bucket in a block, not a file's trigram or a trigram's files: rows don't follow either."""
    rows = spark.read.parquet(f"{index.path}/grams")
    blocks = rows.where("bucket = -1").count()
    assert rows.count() <= blocks * 65 and rows.selectExpr("max(size(paths))").first()[0] <= 256
    assert rows.where("bucket = -1").selectExpr("sum(size(paths))").first()[0] == files.count()
    many = spark.range(700).selectExpr("lpad(id, 5, '0') as path", "concat('abc ', if(id % 300 = 7, 'seldom', 'often')) as text").coalesce(1)
    some = GrepIndex(spark, index.path + "-many").build(many)
    assert sorted(r.path for r in some.candidates("seldom").collect()) == ["00007", "00307", "00607"]
    assert some.candidates("abc").count() == 700
