"""Merkle manifests and the filter audit against brute force."""

import re
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sightline.llm import filteraudit, merkle


def _h(text):
    return sha256(text.encode()).hexdigest()


def _tree(nodes, fanout):
    """Root and the siblings of every leaf."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    ups = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
    root, above = _tree([_h("".join(u)) for u in ups], fanout)
    return root, [[*u[:k], *u[k + 1 :], *above[i]] for i, u in enumerate(ups) for k in range(len(u))]


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _manifest(rows, fanout):
    """(leaf, subroot, root, proof digest) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    order = sorted(groups)
    leaves = {g: [_leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))] for g in order}
    below = {g: _tree(leaves[g], fanout) for g in order}
    root, above = _tree([below[g][0] for g in order], fanout)
    return sorted((leaf, below[g][0], root, _h("".join(way + up))) for g, up in zip(order, above) for leaf, way in zip(leaves[g], below[g][1]))


@pytest.mark.parametrize(("n", "fanout", "block", "swap"), [(1, 2, 4, 2), (2, 2, 4, 2), (37, 2, 2, 2), (90, 2, 4, 4), (77, 3, 3, 9), (33, 2, 4096, 16), (129, 2, 1, 4)])
def test_manifest_by_brute_force(spark, n, fanout, block, swap):
    rows = [(i * 7 % 1000, "s" if i % 5 else None, (None, "", "de", "dé", "en")[i % 13 % 5], i if i % 3 else None, "t" * (i % 4) if i % 4 else None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, fanout=fanout, block=block, swap=swap).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in out) == _manifest(rows, fanout)
    assert all(r.verified and r.folded_root == r.root for r in out)


def test_manifest_shows_tampering(spark):
    rows = [(i, "s", "en" if i % 4 else None, 10 + i if i % 6 else None, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    picked = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    for r in merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, picked, block=8, swap=4).collect():
        assert r.verified == (crc32(str(r.doc_id).encode()) % 7 != 0 or r.doc_id % 6 == 0)
        assert r.verified == (r.folded_root == r.root)


def test_manifest_edges(spark, odd_docs, no_docs):
    names = ("group", "digest", "place", "root", "top")  # helper columns of the operator
    wide = odd_docs.withColumns({c: F.lit(1) for c in names})
    out = merkle.manifest(wide, block=4, swap=2).collect()
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in out) == _manifest(rows, 2)
    assert merkle.manifest(no_docs).collect() == []


def _audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    masks = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [j for j, t, _ in rows if (t or "") == text and j is not None]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and min(copies) < i}
        masks.append((lang or "", "".join(x for x in "ABCDE" if fails[x]), i))
    out = {}
    shapley = {}
    for part in {m[0] for m in masks}:
        own = [(m, i) for p, m, i in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(m, i) for m, i in left if x in m]
                left = [(m, i) for m, i in left if x not in m]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, order, step] = (len(left), len(gone), sum(x in m for m, _ in own) - len(gone), sum(m == x for m, _ in own),
                                          sum(i in good for _, i in gone), sum(i in toxic for _, i in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _report(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_audit_by_brute_force(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [long_text, long_text + " #", "A B C", "", None, "word " * 300, long_text.upper(), "a b #", "a b #"]
    rows = [(i % 40 if i % 11 else None, texts[i * 5 % 9], (None, "", "en", "de")[i % 7 % 4]) for i in range(90)]
    labels = [(i, 1 if i % 3 else 0, 1 if i % 5 == 0 else None) for i in range(0, 50, 2)] + [(2, 0, 0), (None, 1, 1), (4, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert _report(filteraudit.audit(docs, marks)) == _audit(rows, labels)


def test_audit_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(9, 1, 0, "x"), (1, 1, 1, "y")], "doc_id long, quality int, toxic int, part string")
    wide = odd_docs.withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "first", "step", "good")})
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert _report(filteraudit.audit(wide, labels)) == _audit(rows, [(9, 1, 0), (1, 1, 1)])
    assert filteraudit.audit(no_docs, labels).collect() == []
    assert all(v[4:6] == (0, 0) for v in _report(filteraudit.audit(odd_docs, labels.limit(0))).values())
