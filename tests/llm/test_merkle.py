"""The Merkle manifest against a tree built in one piece, and rows that must not crash it."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, leaf string, size int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def whole_tree(leaves):
    """Root, and (siblings, places) of each leaf, level by level."""
    paths, at, level = [([], []) for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at):
            low = i // 16 * 16
            path[0].append([level[k] for k in range(low, min(low + 16, len(level))) if k != i])
            path[1].append(i - low)
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)} for rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = whole_tree([leaf_of(r) for r in by[s]])
    root, above = whole_tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, (rest, places) in zip(by[s], trees[s][1]):
            rest, places = rest + above[k][0], places + above[k][1]
            d = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                d = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for sibs, p in zip(rest, places):
                d = sha("".join([*sibs[:p], d, *sibs[p:]]))
            out.append((str(r[0]), leaf_of(r), trees[s][0], root, sha("".join(x for sibs in rest for x in sibs)), d, d == root))
    return sorted(out)


def audited(df):
    return merkle.audit(df, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def test_equals_a_tree_in_one_piece(spark):
    """Sources of 1 to 4,500 rows: lone leaves, last runs of one, several blocks; nulls, repeated ids, clashing columns."""
    rng, rows = random.Random(3), []
    for s, n in (("b", 4500), ("a", 1), (None, 17), ("ä", 257), ("", 16), ("z", 33)):
        for _ in range(n):
            i = len(rows)
            rows.append((i * 7 % 6007, s, rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", f"Text {i}", f"plain é {i}"])))
    rows += [(None, "a", None, None, None), rows[5], rows[5], (rows[5][0], *rows[5][1:4], "Another text")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1, "y", 2) for r in rows], DOC)
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in audited(df).collect())
    want = brute(rows)
    assert len(got) == len(rows) and got == want
    assert {r[-1] for r in got} == {True, False}


def test_paths_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"t{i}", None, "s" if i % 3 else "t", 2, "x", 1, "y", 2) for i in range(100)], DOC)
    for r in merkle.audit(df, paths=True).collect():
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.path)).hex() == r.root and r.verified
    got = merkle.manifest(df).collect()
    assert {(r.source, r["size"]) for r in got} == {("s", 66), ("t", 34)} and len({r.root for r in got}) == 1


def test_empty_table_and_long_text(spark):
    assert audited(spark.createDataFrame([], DOC)).collect() == []
    text = "Long " * 300_000
    (r,) = audited(spark.createDataFrame([(0, text, None, None, None, "x", 1, "y", 2)], DOC)).collect()
    assert r.leaf == r.subroot == leaf_of((0, None, None, None, text)) and r.proof_sha256 == sha("") and r.root == r.leaf


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal_holds_few_digests(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    height = merkle.height_of(n)
    root, paths = whole_tree([x.hex() for x in leaves])
    assert merkle.root_of(leaves, height).hex() == root
    for steps, (rest, places) in zip(merkle.proofs(leaves, height), paths, strict=True):
        assert [[s.hex() for s in x[1]] for x in steps] == rest and [x[0] for x in steps] == places


def test_treehash_state_is_logarithmic():
    t = merkle.Treehash(3)
    for i in range(16**4):
        t.feed(hashlib.sha256(str(i).encode()).digest())
        assert sum(map(len, t.open)) <= 16 * 4
    assert len(t.close()) == 16
