"""Phrases, hard negatives and token files against brute force, and on awkward input."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import LOWER, SF, awkward, empty

from ripplenet.llm import collocations, hard_negatives, orc_tokens, queries


# 11 phrases
def brute_phrases(rows, support=10, absorbed=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        likely = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        longer = Counter()
        for p, a in likely.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in likely.items():
            if 100 * longer[p] >= absorbed * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return out


def phrases(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("shard", [collocations.SHARD, 700])
def test_phrases_match_brute_force(spark, shard):
    """Also with shards so small that texts are cut: pieces stay whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_phrases(docs.select("lang", "text").collect(), support=4)
    assert len(want) > 300
    assert phrases(collocations.mine_phrases(docs, support=4, shard=shard)) == want


def test_phrases_on_awkward_input(spark):
    lines = ["a b c a b c", "A B, c", "x\ta  b\x0bc", None, "", " .,; ", "é é é é", "a b" * 3, "no.end", "a a a a a a"]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(lines * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as shard", "2 as word", "3 as n")
    assert phrases(collocations.mine_phrases(docs, support=3)) == brute_phrases([(r[2], r[1]) for r in rows], support=3)
    assert phrases(collocations.mine_phrases(awkward(spark), support=50)) == brute_phrases([(r.lang, r.text) for r in awkward(spark).collect()], support=50)
    assert collocations.mine_phrases(empty(spark)).count() == 0


def test_bitmaps_extend_by_shift_and_and():
    tokens = np.array([1, 2, 1, 2, 3, 0, 2, 1, 2, 3, 1, 1, 1, 0, 0, 1, 2, 3], np.int32)
    entries, bits = collocations._vertical(tokens, 3)
    index = collocations.Index(np.arange(3), np.arange(3), entries.astype(np.int32).tobytes(), bits.astype(np.int32).tobytes())
    assert [int(collocations.ONES[index.mask[index.word == w]].sum()) for w in range(3)] == [7, 5, 3]
    of, word, _, mask = index.extend(index.word, index.box, index.mask)
    (p, q), n = collocations._counted([index.word[of], word], mask)
    plain = Counter((a - 1, b - 1) for a, b in zip(tokens.tolist(), tokens[1:].tolist(), strict=False) if a and b)
    assert dict(zip(zip(p.tolist(), q.tolist(), strict=True), n.tolist(), strict=True)) == dict(plain)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_999, 1_000_000_000_007, 1_000_000_000_039
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s")).first().s
    assert got == 10**6 * a * a // (left * right)


# 12 hard negatives
def brute_negatives(rows):
    v = {}
    for i, vec, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        v.setdefault(i, (label, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = set()
    for a, (label, q) in v.items():
        if a % 50:
            continue
        score = {b: sum(x * y for x, y in zip(q, w, strict=False)) for b, (_, w) in v.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if v[b][0] == label][:5]:
            fit = [b for b in order if v[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:3]
            out |= {(a, p, rank, b, score[p], score[b]) for rank, b in enumerate(fit, 1)}
    return out


def negatives(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


@pytest.mark.parametrize("dim,copies", [(64, 1), (3, 4), (2, 2)])
def test_negatives_match_brute_force(spark, monkeypatch, dim, copies):
    """Clusters, a group of equal vectors with ties, and blocks smaller than the table."""
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(400):
        x = centres[i % 4] + 0.6 * rng.normal(size=dim) if i % 3 or copies == 1 else centres[0]
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(4))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_negatives(rows)
    assert want
    assert negatives(hard_negatives.mine_negatives(df)) == want


def test_negatives_on_awkward_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.7, 0.4], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [0.6, 0.4], None), (None, [0.7, 0.4], 2)]
    rows += [(8, [], 2), (9, [0.8], 2), (2, [0.7, 0.4], 2), (10, [0.7, 0.4], 2), (50, [0.0, 0.0], 3), (51, [0.0, 0.0], 3), (100, [-1.0, 0.0], 4), (101, [1.0, 0.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as q", "'x' as block", "2 as score")
    got = negatives(hard_negatives.mine_negatives(df))
    assert got == brute_negatives(rows)
    assert any(r[0] == 50 for r in got)  # a score of 0 admits scores of 0
    assert hard_negatives.mine_negatives(df.limit(0)).count() == 0


def test_bounds_drop_pairs_and_keep_the_first():
    """On clustered vectors most pairs go before their integer product."""
    rng = np.random.default_rng(5)
    q = np.floor(256 * (rng.normal(size=(600, 64)) * np.geomspace(1, 0.01, 64)) / 3).astype(np.int64)
    basis = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1].copy()

    def block(ids):
        return hard_negatives.Block(len(ids), ids.astype(np.int64).tobytes(), np.zeros(len(ids), np.int64).tobytes(), q[ids].tobytes(), b"", basis) if len(ids) else None

    def made(n):
        ids = np.arange(n)
        return hard_negatives.Block(n, ids.astype(np.int64).tobytes(), np.zeros(n, np.int64).tobytes(), q[:n].tobytes(), np.zeros((n, 1), np.int64).tobytes(), basis)

    a, b = made(50), made(600)
    x, y, score = hard_negatives._bounded(a, slice(0, 50), b, slice(0, 600), lambda lower, upper: hard_negatives._leading(lower, 5), np.inf)
    assert len(x) < 50 * 600 / 10
    full = q[:50] @ q.T
    assert (score == full[x, y]).all()
    kept = set(zip(x.tolist(), y.tolist(), strict=True))
    assert all((i, int(j)) in kept for i in range(50) for j in np.argsort(-full[i], kind="stable")[:5])


# 13 token files
@pytest.fixture(scope="module")
def tokenizer():
    return orc_tokens._tokenizer("byte_bpe_50k.json")


PARTS = ["a", "b", " ", "  ", "   ", "\n", "\n ", "\t", "é", "É", "×", "'s", "'", "!", ".", "1", "23", "<|endoftext|>", "世", "\x1c", "\x85", "\x00", "​", "😀", "Foo", "bar,", "\r\n", "ñandú", "$$$"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_pieces_give_the_ids_of_the_whole_text(text):
    want = orc_tokens._tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert np.frombuffer(orc_tokens._pieces("byte_bpe_50k.json").of(text), np.int32).tolist() == want


def test_pieces_stay_right_when_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(orc_tokens, "WORDS", 5)
    pieces = orc_tokens.Pieces(tokenizer)
    text = "one two three\nfour five, six one two seven eight\nnine one two " * 3
    assert np.frombuffer(pieces.of(text), np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def digests(df, tokenizer):
    """(doc_id, start, n_tokens, crc) in id order, null ids first."""
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    out, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, tokenizer):
    got = queries.op13_orc_tokens(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == digests(spark.read.parquet(f"{SF}/documents.parquet"), tokenizer)


def test_token_files_on_awkward_input(spark, tokenizer, tmp_path):
    docs = awkward(spark)
    orc_tokens.write_token_files(docs, str(tmp_path / "a"))
    got = [tuple(r) for r in orc_tokens.token_digests(orc_tokens.read_token_files(spark, str(tmp_path / "a"))).collect()]
    want = digests(docs, tokenizer)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    assert [(r[0], *r[2:]) for r in sorted(got, key=key)] == [(r[0], *r[2:]) for r in sorted(want, key=key)]
    spans = sorted((r[1], r[1] + r[2]) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))  # no gap, no overlap
    orc_tokens.write_token_files(empty(spark), str(tmp_path / "b"))
    assert orc_tokens.token_digests(orc_tokens.read_token_files(spark, str(tmp_path / "b"))).count() == 0


def test_token_files_hold_ids_in_order_with_indexes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(orc_tokens, "STRIPE_BYTES", 1 << 16)
    monkeypatch.setattr(orc_tokens, "CHECKED_ROWS", 50)
    path = tmp_path / "c"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orc_tokens.write_token_files(docs, str(path))
    files = sorted(path.glob("*.orc"))
    ids = [orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist() for f in files]
    assert sum(ids, []) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sum(orc.ORCFile(f).nstripes for f in files) > len(files)  # several stripes, read by several tasks
    assert all(orc.ORCFile(f).row_index_stride == orc_tokens.GROUP_ROWS for f in files)
    assert all(b"BLOOM" in f.read_bytes() or orc.ORCFile(f).nstripes for f in files)


def test_a_lookup_passes_over_other_stripes(spark, tmp_path):
    """Rows that the scan gives for one id: a row group at most, of thousands of documents."""
    docs = spark.range(6000).selectExpr("id * 7 as doc_id", "concat('word ', id) as text").repartition(1)
    path = str(tmp_path / "d")
    orc_tokens.write_token_files(docs.coalesce(1), path)
    for wanted, most in ((4200, orc_tokens.GROUP_ROWS), (4201, 0)):
        found = orc_tokens.read_token_files(spark, path, [wanted])
        assert found.count() == (wanted % 7 == 0)
        df = found.select("doc_id", "ids")
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        scan = plan.collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() <= most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), max_size=6))
def test_pieces_of_many_texts_stay_inside_each(texts):
    """Texts are cut side by side in one array: what stands at a text's end must not decide about its neighbour."""
    flat, places = orc_tokens._pieces("byte_bpe_50k.json").of_texts(pa.array([x.encode() for x in texts], pa.binary()))
    tokenizer = orc_tokens._tokenizer("byte_bpe_50k.json")
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [flat[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == want


def test_a_word_is_encoded_once_whatever_marks_follow_it(tokenizer):
    """Encoding is most of the work: words with other marks, lines or texts around them must not be encoded anew."""
    pieces, asked = orc_tokens.Pieces(tokenizer), []
    plain, encode = pieces.plain, pieces.encode
    pieces.plain = lambda found: asked.extend(found) or plain(found)
    pieces.encode = lambda text: asked.append(text) or encode(text)
    texts = [f"x harbour{m} harbour{m}\nharbour{m} lantern" for m in ("", ".", ",", "%%%", ":", ".***")]
    for _ in range(2):
        pieces.of_texts(pa.array([x.encode() for x in texts], pa.binary()))
    assert sorted(asked) == sorted([b"x", b" harbour", b"harbour", b" lantern", b"\n", b".", b",", b"%%%", b":", b".***"])


def test_bytes_that_are_no_text_are_read_as_before(tokenizer):
    raws = [b"ok \xc3", b".\xc3(", b"\xbf. \xff.a", b"", b"fine, word"]
    flat, places = orc_tokens.Pieces(tokenizer).of_texts(pa.array(raws, pa.binary()))
    want = [tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in raws]
    assert [flat[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == want
