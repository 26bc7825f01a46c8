"""Row-local operators: language, quality, byte BPE, packing, personal data, fingerprints."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import bytebpe, cascade, common, cwsample, langmask, packing, personal

from .conftest import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sreT 12,.\n\té漢\U0001f600\xa0\x1c"), max_size=300), st.integers(1, 40))
def test_tree_of_a_text(text, leaf):
    tree = bytebpe.encoder(RANKS, public_tokenizers.PATTERN)
    old = bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES, bytebpe.WINDOW
    bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES, bytebpe.WINDOW = leaf, 3, 1
    try:
        ids = tree.encode(text)
    finally:
        bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES, bytebpe.WINDOW = old
    assert ids == tree._core.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "the", "aaab", "ing", "é", "0", "=-", "xyzzyplugh"])
def test_tree_of_a_long_match(bpe, unit):
    text = unit * (6000 // len(unit))
    assert bpe.encode(text) == bpe._core.encode_ordinary(text)


def test_ids_as_the_library(spark, bpe):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bytebpe.query(spark, "/root/testdata/sf0.001").collect():
        ids = bpe._core.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_edges(odd_docs, no_docs):
    out = bytebpe.digests(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == odd_docs.count()
    texts = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert Counter(r.decoded_sha256 for r in out) == texts
    assert bytebpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abSt'dlm 09²½.,!<|>\t\n\x0b\x1c\x85\xa0éßÀªµºœ漢İΣ"), max_size=80))
def test_words_as_the_tokenizer(text):
    words = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words._tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("'strvemldxa é19.\xa0\n\x85²"), max_size=40))
def test_words_as_the_split_pattern(text):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+"
    inside, new = packing.word_starts(np.frombuffer(text.encode("latin-1"), np.uint8))
    words = []
    for char, within, first in zip(text, inside, new, strict=True):
        if within:
            words.append(char) if first else words.append(words.pop() + char)
    assert words == re.findall(pattern, text)


def test_a_word_is_kept_once_whatever_stands_beside_it():
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["qzxv, qzxv. qzxv's", "(qzxv) qzxv", ""]
    assert list(tokens.encode_all(texts)) == [tokens._whole(t) for t in texts]
    assert sum(len(t.now) for t in vars(tokens).values() if isinstance(t, packing.Recent)) == 6


def test_pieces_as_the_tokenizer(spark):
    """Starts, lengths and digests of the pieces, and sequences without gaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.add((r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())))
    out = packing.query(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def _fewest(pieces, capacity):
    """Fewest bins by trying all assignments, for small instances."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= capacity:
                bins[k] += pieces[i]
                place(i + 1, bins)
                bins[k] -= pieces[i]
        bins.append(pieces[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_packing_small_instances(pieces):
    found = packing.solve(Counter(pieces), 20)
    used = Counter()
    for filling, times in found:
        assert sum(filling) <= 20
        for x in filling:
            used[x] += times
    assert used == Counter(pieces)
    assert sum(times for _, times in found) <= _fewest(sorted(pieces, reverse=True), 20) + 1


def test_dominance_is_exact_for_large_pieces():
    pieces = [12, 11, 11, 9, 9, 8, 8, 8, 7]
    assert sum(n for _, n in packing.solve(Counter(pieces), 20)) == _fewest(pieces, 20)


def test_packing_edges(odd_docs, no_docs):
    rows = packing.packed(odd_docs).collect()
    assert packing.packed(no_docs).count() == 0
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_language(spark, odd_docs, no_docs):
    texts = [("en", "the of and to in that with for are this"), ("fr", "le la les des est pour dans que qui une"), ("de", "der die das und ist nicht ein mit für auf")]
    known = spark.createDataFrame([(" ".join(t.split()[i:] + t.split()[:i]), lang) for lang, t in texts for i in range(8)] + [("skip", None), (None, "en")], "text string, lang string")
    model = langmask.fit(known)
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame([(1, "and that for this", "x"), (2, "les des pour qui", "x"), (3, "1234 !?", "x"), (4, None, "x")], "doc_id long, text string, lang_pred string")
    found = {r.doc_id: r for r in langmask.predict(asked, model, ["doc_id"]).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[3].score == 0
    assert langmask.predict(odd_docs, model, ["doc_id", "mark"]).count() == odd_docs.count()
    nothing = langmask.fit(known.limit(0))
    assert {r.lang_pred for r in langmask.predict(asked, nothing, ["doc_id"]).collect()} == {"und"}
    assert langmask.predict(no_docs, model, ["doc_id"]).count() == 0


def test_language_stage_rejects_on_evidence(spark):
    import random

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_lang = {}
    for r in docs.where("length(text) > 600").orderBy("doc_id").select("lang", "text").collect():
        by_lang.setdefault(r.lang, r.text[:400])
    mixed = " ".join([by_lang["de"], by_lang["en"]])
    draw = random.Random(1)
    letters = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(80))
    other = "minä olen tässä talossa ja sinä olet siellä missä kaikki muutkin ovat huomenna taas yhdessä"
    odd = spark.createDataFrame([(-i, t, None, "odd", len(t)) for i, t in enumerate((letters, other, mixed, "12", ""), 1)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), "")
    assert kept.where("doc_id < 0").count() == 0
    assert docs.where(langmask.held_out()).join(kept, "doc_id", "left_anti").count() == 0


def test_language_masks_hold_every_entry():
    numbers = np.arange(5000)
    model = langmask.MaskFilter.build([str(i) for i in range(70)], (numbers * 7919).astype(np.uint64), numbers % 70)
    values = (np.arange(5000, dtype=np.int64) * 7919).view(np.uint64)
    masks = model.masks(values)
    assert all((int(masks[i][(i % 70) // 64]) >> ((i % 70) % 64)) & 1 for i in range(5000))


def _plain_grams(text):
    """Counts of the n-grams of one to five characters, from the definition."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    words = " " + " ".join(letters.split()) + " "
    return Counter(g for n in langmask.SIZES for i in range(len(words) - n + 1) if (g := words[i : i + n]) != " ") if words.strip() else Counter()


def test_language_against_plain_sets(spark):
    """Predictions equal those of plain sets of n-grams, and held-out documents are right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", langmask.held_out().alias("held_out"))
    rows = docs.collect()
    counts = {}
    for lang, text in {(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not r.held_out}:
        counts.setdefault(lang, Counter()).update(_plain_grams(text))
    shares = {lang: {g: n / c.total() for g, n in c.items() if n >= 2e-6 * c.total()} for lang, c in counts.items()}
    top = Counter()
    for share in shares.values():
        top |= Counter(share)
    sets = {lang: {g for g, x in share.items() if x >= 0.5 * top[g]} for lang, share in shares.items()}
    found = {r.doc_id: r for r in langmask.predict(docs, langmask.train(docs), ["doc_id"]).collect()}
    for r in rows:
        own = _plain_grams(r.text or "")
        rates = {lang: sum(n for g, n in own.items() if g in sets[lang]) / own.total() for lang in sorted(sets)} if own else {}
        got = found[r.doc_id]
        if not own:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        best = max(rates, key=rates.get)
        assert abs(got.score - rates[best] / sum(rates.values())) < 0.03
        if rates[best] - max(x for lang, x in rates.items() if lang != best) > 0.02:
            assert got.lang_pred == best
    held = [r for r in rows if r.held_out and r.lang is not None and _plain_grams(r.text or "")]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held) > 0


_ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from sightline.llm import QUERIES
from sightline.session import local_session

def known(_):
    try:
        import sightline
        yield True
    except ImportError:
        yield False

spark = local_session("elsewhere", 4)
assert spark.sparkContext.parallelize([0], 1).mapPartitions(known).collect() == [False]
for name in ("op2_language", "op4_ngram_jaccard", "op6_quality", "op7_repeats", "op8_packing", "op9_byte_bpe", "op11_merkle_manifest", "op13_graph_search"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = _ELSEWHERE.format(repo=str(Path(__file__).resolve().parents[2]))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_quality(spark, odd_docs, no_docs):
    clean = " ".join(prose(11, 120))
    rows = [(1, clean), (2, "few words"), (3, " ".join(w + "###" for w in prose(11, 120))), (4, "a b c " * 40), (5, clean.upper()), (6, "\n".join([" ".join(prose(12, 30))] * 4))]
    found = {r.doc_id: r for r in cascade.judge(spark.createDataFrame(rows, "doc_id long, text string"), fraction=1.0).collect()}
    assert [found[i].kept for i in range(1, 7)] == [True, False, False, False, False, False]
    assert found[6].n_dup_lines == 3 and found[4].n_repeat_words == 120 and found[3].n_symbols == 360
    assert cascade.judge(odd_docs).count() == odd_docs.count() and cascade.judge(no_docs).count() == 0


def test_cascade_order():
    cheap, costly = cascade.Rule("cheap", lambda m: False), cascade.Rule("costly", lambda m: True)
    assert cascade.ordered([costly, cheap], {"cheap": (1e-6, 0.1), "costly": (1.0, 0.9)}) == [cheap, costly]


def _base(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for i, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), i, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out))


def test_base_patterns(spark):
    texts = ["a@b.com._x@y.z q@w", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "00255.1.1.1 256.1.1.1", "4539 1488 0343 6467 1", "4539-1488-0343-6467",
             "4539  1488 0343 6467", "5 4539148803436467", "45391488034364670000000000", "+1 (068) 555-2713", "+1+1234567890123456+12345678901", "\U0001f600 x@y.zz é 10.0.0.1",
             "a" * 3000 + "@", "1" * 3000, "+" * 50 + "1" * 11, "..@..", "x@y.com-z.q w%+-@a-b.c-d", None, "", "0.0.0.0+12 345 678 90"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.base for r in personal.find(rows).select("doc_id", personal.shown("base").alias("base")).collect()}
    assert [found[i] for i in range(len(texts))] == [_base(t) for t in texts]


def test_contexts_find_unseen_identifiers(spark):
    seen = [(i, f"words then badge{i % 2}x tel: +1 (068) 555-{1000 + i} and the end") for i in range(12)]
    new = [(100, "here tel: 068-555-9999 without a prefix"), (101, "the 068-555-9999 elsewhere"), (102, "tel: nothing")]
    found = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(seen + new, "doc_id long, text string")).select("doc_id", personal.shown("spans").alias("spans")).collect()}
    assert found[100] == "phone:10:22" and found[101] == "" and found[102] == ""


def test_contexts_count_texts_not_copies(spark):
    """Copies, a repeated number and cues that are parts of tokens do not hide a pattern."""
    seen = [(i, f"tel: +1 (068) 555-{1000 + i} and mail:<u{i}@b.org> of") for i in range(12)]
    rows = seen + [(50 + i, "write tel: later") for i in range(200)] + [(300 + i, f"text{i}x tel: +1 (068) 555-1000 or") for i in range(50)]
    rows += [(400, "now tel: 068-555-9999 ok"), (401, "now mail:<qq1234@b> ok"), (402, "tel: " * 300)]
    found = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal.shown("spans").alias("spans")).collect()}
    assert found[400] == "phone:9:21" and found[401] == "email:10:18" and found[50] == "" and found[402] == ""


def test_contexts_find_other_shapes_and_teach(spark):
    """Blanks, brackets, handles and names without digits; accepted instances make patterns of the next round."""
    rows = [(i, f"t{i}x tel: +1 (068) 555-{1000 + i} or mail: u{i}@b.org of") for i in range(12)]
    rows += [(100, "tel: 068 555 2713 ok"), (101, "tel: (068) 555-2713 ok"), (102, "tel: 4539 1488 0343 6460 ok"), (103, "mail: bob[at]mail.org ok"),
             (104, "mail: @bobby ok"), (105, "mail: bob_smith ok"), (106, "tel: none"), (107, "mail: nothing")]
    rows += [(200 + i, f"tel: 068 555 {3000 + i} fax") for i in range(8)] + [(300, "old 068 777 1234 fax"), (301, "old 068 777 1234 here")]
    found = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal.shown("spans").alias("spans")).collect()}
    assert [found[100 + i] for i in range(8)] == ["phone:5:17", "phone:5:19", "phone:5:24", "email:6:21", "email:6:12", "email:6:15", "", ""]
    assert found[300] == "phone:4:16" and found[301] == ""


def test_other_words_make_no_rows(spark):
    """Runs that are no pattern are left out before the generator, so it makes the occurrences only."""
    texts = spark.createDataFrame([(1, ["a", "b", "c", "a", "b", "d"]), (2, ["x"] * 50), (3, [])], "mark long, words array<string>")
    patterns = spark.createDataFrame([("after", "a b"), ("before", "d")], "side string, pattern string")
    found = personal._occurrences(texts, patterns)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate") < plan.index("Join")
    got = {tuple(r) for r in found.collect()}
    assert got == {(1, "after", "a b", "c"), (1, "after", "a b", "d"), (1, "before", "a b", ""), (1, "before", "a b", "c"), (1, "after", "d", ""), (1, "before", "d", "b")}


def test_many_neighbours_in_one_text(spark):
    """Neighbours of a long text are told apart by a hash table, not each by all others."""
    words = [w for i in range(60_000) for w in ("tel", f"n{i % 50_000}")]
    texts = spark.createDataFrame([(1, words)], "mark long, words array<string>")
    patterns = spark.createDataFrame([("after", "tel"), ("before", "tel")], "side string, pattern string")
    begun = time.time()
    found = {r.side: r.n for r in personal._counted(personal._occurrences(texts, patterns), patterns).collect()}
    assert found == {"after": 50_000, "before": 50_001}
    assert time.time() - begun < 30


def test_a_process_keeps_one_operators_tables():
    """What an operator before kept goes, and long batches are read in pieces."""
    assert common.kept("test one", 1, lambda: "a") == "a" and common.kept("test one", 1, lambda: "b") == "a"
    common.kept("test two", 1, lambda: "c")
    assert common.kept("test one", 1, lambda: "d") == "d"
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    assert [p.num_rows for p in common.pieces([batch])] == [1024, 1024, 452]


def test_contexts_confirm_secrets(spark):
    """Assignments, several words and line starts are patterns; high entropy alone is no secret."""
    digest = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f"{w} token = \"{digest[i]}\" {w}") for i, w in enumerate(prose(31, 12))]
    rows += [(20 + i, f"some words\nkey {digest[20 + i]} {w}") for i, w in enumerate(prose(32, 8))]
    rows += [(40 + i, f"{w} key {w}z and token {w} title = \"{w}long\"") for i, w in enumerate(prose(33, 30))]
    rows += [(100, "last token = \"hunterXYZ\" here"), (101, f"commit {digest[50]} of main"), (102, f"a key {digest[51]} there"), (103, f"x\nkey {digest[52]}"),
             (104, "the token = none"), (105, "title = \"Something\"")]
    found = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal.shown("spans").alias("spans")).collect()}
    assert all(found[i] == f"secret:{(at := rows[i][1].index(digest[i]))}:{at + 40}" for i in range(12))
    assert found[100] == "secret:14:23" and found[101] == "" and found[102] == "" and found[103] == "secret:6:46"
    assert found[104] == "" and found[105] == "" and all(found[40 + i] == "" for i in range(30))


def test_long_words_beside_identifiers(spark):
    """A word beside an identifier is taken whole, however long."""
    cue = "x" * 300 + ":"
    rows = [(i, f"w{i}x {cue} +1 (068) 555-{1000 + i} z") for i in range(9)] + [(50, f"{cue} 068-555-9999 q"), (51, f"{cue[100:]} 068-555-9998 q")]
    found = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal.shown("spans").alias("spans")).collect()}
    assert found[50] == "phone:302:314" and found[51] == ""


def test_secrets_of_the_table(spark):
    """Documents with a secret are found and masked, and nothing else is added but beside the same context."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = {r.doc_id for r in docs.collect() if re.search(r'token = "[0-9a-f]{40}"', r.text or "")}
    out = personal.find(docs).select("doc_id", "spans", F.size("base").alias("n")).collect()
    caught = {r.doc_id for r in out if any(s.kind == 5 for s in r.spans)}
    assert planted and len(caught & planted) >= 0.9 * len(planted)
    assert {r.doc_id for r in out if len(r.spans) > r.n} <= planted
    assert not any(re.search("[0-9a-f]{40}", r.text or "") for r in personal.masked(docs).collect() if r.doc_id in planted)


def test_masking(odd_docs, no_docs):
    out = personal.masked(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = out.where("doc_id = 15").first()
    assert text.text == "call [PHONE] or [EMAIL] from 10.0.0.300 and [IP], card [CARD]" and text.n_chars == len(text.text)
    assert personal.masked(no_docs).count() == 0 and personal.find(odd_docs).count() == odd_docs.count()


def test_fingerprints(spark, odd_docs, no_docs):
    a = prose(21, 400)
    rows = [(1, " ".join(a)), (5, " ".join(a)), (2_000_000, " ".join(a[:300] + prose(22, 100))), (7, None)]
    found = {r.doc_id: r for r in cwsample.compared(spark.createDataFrame(rows, "doc_id long, text string"), 512).collect()}
    assert found[1].fingerprint == found[5].fingerprint and found[1].near_next == 1.0 and found[5].near_next == 0.0
    assert found[7].fingerprint == "" and found[7].near_edited == 1.0

    def jaccard(x, y):
        x, y = Counter(x), Counter(y)
        return sum((x & y).values()) / sum((x | y).values())

    # The last row is followed by the first.
    assert abs(found[2_000_000].near_next - jaccard(rows[2][1].split(), a)) < 0.1
    text, n = rows[2][1], len(rows[2][1])
    assert found[2_000_000].edited_sha256 == hashlib.sha256((text[: n - n // 4] + rows[0][1][: n // 4]).encode()).hexdigest()
    out = cwsample.compared(odd_docs).collect()
    assert len(out) == odd_docs.count() and cwsample.compared(no_docs).count() == 0
    assert len({r.fingerprint for r in out if r.doc_id in (6, 7)}) == 1


def test_fingerprint_error_at_the_production_number(spark):
    texts = [" ".join(prose(500 + i, 120)) for i in range(400)]
    found = {r.doc_id: r for r in cwsample.compared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    errors = []
    for i, t in enumerate(texts):
        cut = len(t) // 4
        x, y = Counter(t.split()), Counter((t[: len(t) - cut] + texts[(i + 1) % len(texts)][:cut]).split())
        errors.append(found[i].near_edited - sum((x & y).values()) / sum((x | y).values()))
    deviation, bias = float(np.std(errors)), float(np.mean(errors))
    print(f"production error: deviation {deviation:.4f}, bias {bias:.4f}, samples {cwsample.SAMPLES}")
    assert deviation < 0.07 and abs(bias) < 0.02


def test_fingerprints_need_few_draws(spark):
    texts = [" ".join(prose(900 + i, 150) + prose(900, 60)) for i in range(40)] + ["One", " \t\n", "a a A b"]
    rows = spark.createDataFrame([(i, t, t[: len(t) // 2] + texts[i - 1][:200]) for i, t in enumerate(texts)], "doc_id long, text string, edited string")
    counts = [(i, side, word, n) for i, r in enumerate(rows.collect()) for side in ("text", "edited") for word, n in Counter(r[side].lower().split()).items()]
    every = spark.createDataFrame(counts, "doc_id long, side string, word string, n int").crossJoin(spark.range(64).selectExpr("cast(id as int) AS i"))
    plain = every.groupBy("doc_id", "side", "i").agg(F.min(cwsample.sample(F.xxhash64("word"), F.log("n"), F.col("i"))).alias("s"))
    expected = defaultdict(dict)
    for r in plain.collect():
        expected[r.doc_id, r.side][r.i] = r.s
    for enough in (0.5, 5.0, cwsample.ENOUGH, float("inf")):
        found = cwsample.signatures(rows, ["doc_id"], 64, enough).collect()
        assert {r.doc_id for r in found} == {i for i, _ in expected}
        for r in found:
            same = all(own == [s for _, s in sorted(expected[r.doc_id, side].items())] for own, side in ((r.own, "text"), (r.changed, "edited")))
            assert same != r.open
        assert any(r.open for r in found) == (enough < 6)
    made = cwsample.drawn(rows, ["doc_id"], 64, cwsample.ENOUGH).count()
    assert made < 0.4 * cwsample.drawn(rows, ["doc_id"], 64, float("inf")).count()


def test_fingerprints_of_rows_drawn_again(spark, monkeypatch):
    ids = [i * i * 37 for i in range(60)] + [None, None, 37, 1 << 40]
    rows = spark.createDataFrame([(d, " ".join(prose(1200 + i, 30 + i)) if i % 9 else None) for i, d in enumerate(ids)], "doc_id long, text string")

    def found(enough):
        monkeypatch.setattr(cwsample, "ENOUGH", enough)
        return sorted(cwsample.compared(rows).collect(), key=str)

    every = found(float("inf"))
    assert len(every) == len(ids) and {len(r.fingerprint) for r in every} == {0, 1024}
    assert found(5.0) == every and found(0.5) == every


def test_next_document_over_blocks(spark):
    ids = [0, 255, 256, 5000, 1 << 20, (1 << 20) + 3, 1 << 40, -9]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.following for r in cwsample.with_next(rows).collect()}
    order = sorted(ids)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


