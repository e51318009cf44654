"""Trees on disk, pruned while they are walked; a log that is replayed, grows, and is replaced."""

import json
import os

import pytest

from quern.sources import logs, tables, trees
from quern.streaming import events

FILES = ["a.py", "B.PY", "src/b.ts", "src/c.txt", "src/.hidden/d.py", "src/deep/er/e.cs", "node_modules/x/f.py", "src/bin/g.py", "build/h.java", "migrations/i.py", ".git/j.py", ".agent/rules.md", ".agent/README.md", ".agent/sub/more.md", "docs/no.md", "noext"]


@pytest.fixture
def root(tmp_path):
    for f in FILES:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(f"text of {f}")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe ok")
    os.symlink(tmp_path / "src", tmp_path / "link")
    return str(tmp_path)


@pytest.mark.parametrize("purpose", [*tables.SCANS, "docs"])
@pytest.mark.parametrize("partitions", [3, 500])
def test_tree_equals_a_filtered_listing(spark, root, purpose, partitions):
    spark.dataSource.register(trees.SourceTree)
    got = spark.read.format("source_tree").option("purpose", purpose).option("partitions", partitions).load(root).collect()
    listing = spark.createDataFrame([(f,) for f in [*FILES, "bad.py"]], "path string")
    want = tables.doc_files(listing) if purpose == "docs" else tables.scan_files(listing, purpose)
    assert sorted(r.path for r in got) == sorted(r.path for r in want.collect())
    assert all(r.text == f"text of {r.path}" and r.size == len(r.text) for r in got if r.path != "bad.py")


def test_pruned_folders_are_never_opened(root):
    opened = []

    def scan(folder):
        opened.append(os.path.relpath(folder, root))
        return os.scandir(folder)

    paths = list(trees.walk(root, "", "analysis", scan))
    assert "src/deep/er/e.cs" in paths
    assert not {"node_modules", "src/bin", ".git", "src/.hidden", "build", "link", "node_modules/x"} & set(opened)
    assert sorted(opened) == [".", "docs", "migrations", "src", "src/deep", "src/deep/er"]


def test_absent_and_empty_trees(spark, tmp_path):
    spark.dataSource.register(trees.SourceTree)
    for p in (tmp_path / "gone", tmp_path):
        assert spark.read.format("source_tree").load(str(p)).collect() == []


def test_log_is_replayed_and_goes_on(spark, tmp_path):
    path, base = tmp_path / "app.jsonl", f"file://{tmp_path}"
    line = lambda k: json.dumps({"level": ["DEBUG", "INFO", "ERROR"][k % 3], "msg": f"m{k}"}) + "\n"
    path.write_text("".join(line(k) for k in range(500)) + '{"level": "INFO", "msg": "half')

    def go():
        seen = len(msgs)
        events.run_to_table(logs.tail(spark, str(path)), f"{base}/cp", "append", events.appended(f"{base}/out"))
        rows = spark.read.schema(tables.LOG + ", batch int").parquet(f"{base}/out").orderBy("batch").collect()
        msgs[:] = [r.msg for r in rows]
        return sorted(msgs[seen:])

    msgs: list = []
    assert go() == sorted(f"m{k}" for k in range(300, 500)), "the last 200 whole lines"
    with path.open("a") as f:
        f.write(' done"}\nnot json\n\n')
    assert go() == ["half done", "not json"]
    path.unlink()
    path.write_text(line(1) + line(2))
    assert go() == ["m1", "m2"], "a new file under the name is read from its start"


def test_levels(spark):
    df = spark.createDataFrame([("error",), ("WARNING",), (None,), ("odd",)], "level string")
    keep = lambda least: [r.level for r in df.where(logs.at_least(df.level, least)).collect()]
    assert keep("WARNING") == ["error", "WARNING"] and keep("info") == ["error", "WARNING", None] and len(keep("DEBUG")) == 4


@pytest.mark.parametrize("text,n,at", [("", 3, 0), ("a\nb\nc\n", 2, 2), ("a\nb\nc\nhalf", 2, 2), ("a\n", 5, 0), ("half", 2, 0)])
def test_start_of_the_last_lines(tmp_path, text, n, at):
    p = tmp_path / "x"
    p.write_text(text)
    assert logs.start_of_last(str(p), n, block=3) == at
