"""Training-data operators against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplenet.llm import diffcover, hilbert, html_paths, langid, prefix_free, quality_rules, queries, soft_mixing, superminhash, templates, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, sha string, words string"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def awkward(spark):
    """Nulls everywhere, empty, blank, short, very long, equal and repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977} und" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long), (None, "no id here at all"), (None, None), (8, "\u2603" * 300), (9, "A\x00B" * 200), (10, "é" * 5000)]
    return spark.createDataFrame([(i, t, None, None, None, "x", None, "y") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 6 SuperMinHash
def brute_groups(texts, k, percent=80):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, texts, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs, shingle_words=k).collect()}
    assert got == brute_groups(texts, k)


def test_late_band_members_are_compared_exactly(spark):
    """A chain whose members link to neighbours only, beside a large group of near copies."""
    base = [f"b{i}" for i in range(120)]
    rows = {}
    for i in range(40):
        w = list(base)
        for j in range(6):
            w[(i * 5 + j * 17) % 120] = f"x{i}_{j}"
        rows[i] = " ".join(w)
    for i in range(12):
        rows[100 + i] = " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs, shingle_words=2).collect()}
    assert got == brute_groups(rows, 2)


def test_exact_comparison_finds_links_of_sets_with_both_signs():
    """Every true link of a set with a block is found, and equal sets share all elements."""
    rows = {}
    for i in range(30):
        w = [f"w{j}" for j in range(200)]
        for j in range(i):
            w[j * 3] = f"x{i}_{j}"
        rows[i] = " ".join(w)
    batch = pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([t.encode() for t in rows.values()])], ["doc_id", "raw"])
    (sets,) = superminhash._sets(2)([batch])
    members = sets.column(1).to_pylist()
    assert all(min(m) < 0 < max(m) for m in members)
    block = [{"rep": i, "members": m} for i, m in zip(rows, members, strict=True)]
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("members", pa.list_(pa.int64()))]))
    for own in (0, 7, 29):
        pairs = pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([members[own]], pa.list_(pa.int64())), pa.array([block], kind)], ["id", "own", "others"])
        (links,) = superminhash._against(80)([pairs])
        a, b = set(members[own]), [set(m) for m in members]
        want = {tuple(sorted((own, i))) for i in rows if i != own and 100 * len(a & b[i]) >= 80 * len(a | b[i])}
        assert set(zip(links.column(0).to_pylist(), links.column(1).to_pylist(), strict=True)) == want
        assert len(want) > 3 or own == 29


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 800, dtype=np.uint64)
    own = [rng.integers(0, 1 << 62, 100, dtype=np.uint64) for _ in range(2)]
    both = [np.unique(np.concatenate([common, o])) for o in own]
    sig = superminhash.superminhash(np.concatenate(both), np.repeat([0, 1], [len(b) for b in both]), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.07
    assert (np.sort(sig >> np.uint64(32), axis=1) < 512).all()


# 7 and 10 exact substrings
def brute_bytes(texts, length):
    raws = {i: t.encode() for i, t in texts.items()}
    seen = Counter(r[j : j + length] for r in raws.values() for j in range(len(r) - length + 1))
    out = {}
    for i, r in raws.items():
        gone = np.zeros(len(r) + 1, bool)
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                gone[j : j + length] = True
        keep = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(r) else 0
        out[i] = (len(r), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest())
    return out


def test_repeated_bytes_match_brute_force(spark, texts):
    got = queries.op7_prefix_free(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(texts, 200)


def test_repeats_inside_one_text_and_overlaps(spark):
    part = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = {1: part + "zz" + part, 2: "q" * 450, 3: part[30:250], 4: "nothing like it " * 3, 5: "ab" * 150}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = prefix_free.remove_repeated_bytes(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.span_starts), r.kept_sha256) for r in got} == brute_bytes(rows, 200)


def brute_windows(texts, length):
    words = {i: WORD.findall(t) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][j : j + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_repeated_windows_match_brute_force(spark, texts):
    got = queries.op10_difference_cover(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_windows(texts, 50)


def test_cover_is_a_difference_cover():
    assert diffcover.covers(diffcover.PERIOD, diffcover.COVER) and not diffcover.covers(31, (1, 5, 11))


# 1 quality rules
def test_base_features_match_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        gone = [False] * len(w)
        for j in range(len(w) - 2):
            if tri[tuple(w[j : j + 3])] > 1:
                gone[j : j + 3] = [True] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(gone))
        assert r.base_failed == (len(w) < 50 or 100 * sum(gone) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_sketches_merge_and_bound_their_error(spark):
    v = spark.range(1, 5001).select(F.lit("a").alias("k"), F.lit("m").alias("metric"), F.col("id").alias("value"))
    whole = quality_rules.points(quality_rules.quantile_sketches(v, ["k"]), ["k"], tail=25).first()
    halves = [quality_rules.quantile_sketches(v.where(c), ["k"]) for c in ("value <= 900", "value > 900")]
    merged = halves[0].union(halves[1]).groupBy("k", "metric", "bucket").agg(F.sum("n").alias("n"))
    again = quality_rules.points(merged, ["k"], tail=25).first()
    assert (whole.low, whole.mid, whole.high) == (again.low, again.mid, again.high)
    for got, true in ((whole.low, 1250), (whole.mid, 2500), (whole.high, 3750)):
        assert abs(got - true) <= true / 32 + 1


def test_planted_junk_fails_where_clean_text_stays(spark):
    rng = np.random.default_rng(0)
    clean = [(i, " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(80))) for i in range(150)]
    rows = [(i, t, "en", "s") for i, t in clean] + [(900, " ".join("%%##|" for _ in range(80)), "en", "s"), (901, " ".join("x" * 60 + str(i) for i in range(80)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and not got[901] and sum(got[i] for i, _ in clean) >= 148


# 2 sharding
def test_hilbert_curve_is_a_path():
    grid = np.indices((8, 8, 8)).reshape(3, -1).T
    at = hilbert.hilbert_index(grid, 3)
    assert sorted(at) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_slots_gapless(spark, texts):
    rows = queries.op2_hilbert_shards(spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and min(size) >= 0 and max(size) <= 39
    mean, largest = sum(size.values()) / 40, max(r.size for r in rows)
    assert all(abs(size[i] - mean) <= 2 * largest for i in range(40))


# 3 html
PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="main"><article><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b>
text. It goes on for a while, as articles do; it has commas.</p><p>Second paragraph &eacute;&#8230; and some more words, to be sure.<br>After a break.</p></article>
<div class="comments"><p>Nice post, dude, thanks a lot!</p></div></div><aside>More links</aside><footer>Copyright</footer><form><input><p>Subscribe now</p></form></body></html>"""


def test_main_text_of_a_page():
    assert html_paths.main_text(PAGE) == "A & B\nFirst paragraph, with bold text. It goes on for a while, as articles do; it has commas.\nSecond paragraph é… and some more words, to be sure. After a break."


@pytest.mark.parametrize("html", ["", "<", "<p", "<p>a", "</p>", "<script>x", "<!--", "&", "<div><div><div>", "x" * 10, "<p>a</b></p>", "<a href='<p>'>l</a>", "<p><p><p>", "\x00<p>\x00</p>"])
def test_broken_markup_does_no_harm(html):
    assert isinstance(html_paths.main_text(html), str)


def test_pages_keep_rows_and_lengths(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", None)], "page_id long, url string, html string, text string")
    rows = html_paths.extract_pages(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and sum(r.text == "" for r in rows) == 2
    assert html_paths.extract_pages(pages.limit(0)).count() == 0


# 4 urls
def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def test_urls_match_brute_force(spark):
    odd = ["http://WWW.Example.NET/en/x?y#z", "https://a.example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/", "http://org/fr/a", "http://x.net", "no scheme", "", None, "a://b://c/d", "http://?q", "http://example.net/e", "http://h.com:80/p#f?x", "http://münchen.com/Ä"]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")
    for r in url_filter.judge_urls(pages).collect():
        host, path = brute_url(odd[r.page_id])
        fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict in ("allow", "block") and (not best or r.verdict == best[2])


def test_unwanted_hosts_are_segmented_and_blocked(spark):
    urls = ["http://spamfarm.example.org/en/1", "http://www.cheap-pills.example.com/a", "http://onlinecasino.example.com/", "http://citylibrary.example.com/news", "http://dailynews.example.org/x"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].verdict for i in range(5)] == ["block", "block", "block", "allow", "allow"]
    assert got[2].words[:2] == ["online", "casino"]


def test_viterbi_against_all_splits():
    seg = url_filter.Segmenter({"a": 5, "ab": 3, "abc": 2, "bc": 7, "c": 1})

    def cost(parts):
        return sum(seg.cost.get(p, seg.unknown(len(p))) for p in parts)

    def splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in splits(s[i:])]

    for name in ("abc", "abcabc", "xxabc", "cab", "zz", "abzbc"):
        got = [p.lstrip("?") for p in seg.split(name)]
        assert "".join(got) == name and cost(got) == pytest.approx(min(map(cost, splits(name))))


# 5 languages
def test_held_out_languages(spark):
    rows = queries.op5_language_mixture(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_mixture_finds_both_languages(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of the house " * 30, "en"), (2, "le chat et le chien de la maison " * 30, "fr"), (3, "der hund und die katze " * 30, "de")], "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(9, "the cat and the dog of the house " * 20 + "le chat et le chien de la maison " * 10), (10, "12 34 !"), (11, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, docs).collect()}
    assert set(got[9].languages) == {"en", "fr"} and got[9].lang_pred == "en" and 0.5 < got[9].score < 0.8
    assert got[10].lang_pred == "und" and got[11].lang_pred == "und"
    assert {r.lang_pred for r in langid.identify(mixed, docs.limit(0)).collect()} == {"und"}


def test_em_raises_the_likelihood():
    p = np.random.default_rng(3).random((50, 4)) + 1e-3
    fits = [langid.shares(p, n)[1] for n in (1, 2, 4, 8, 16)]
    assert all(b >= a - 1e-9 for a, b in zip(fits, fits[1:], strict=False))


# 8 mixing
def mixed_corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        kind = ("good", "low", "toxic")[i % 3]
        words = {"good": "meadow river", "low": "junk filler", "toxic": "vile nasty"}[kind]
        rows.append((i, f"{words} common text number{i % 7} " * (1 + i % 4)))
        if i % 2:
            labels.append((i, kind))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_rates_meet_the_targets(spark):
    docs, labels = mixed_corpus(spark)
    out = soft_mixing.mix_to_targets(docs, labels, {"good": 0.7, "low": 0.3, "toxic": 0.0}).toPandas()
    total = out.tokens.sum()
    share = {d: (out.rate * out.tokens * out.posterior.map(lambda p: p[d])).sum() / total for d in ("good", "low", "toxic")}
    assert abs(share["good"] - 0.7) < 0.02 and abs(share["low"] - 0.3) < 0.02 and share["toxic"] < 0.02 and (out.rate >= 0).all()
    used = (out.copies * out.tokens).groupby(out.domain).sum() / total
    assert abs(used["good"] - 0.7) < 0.06 and (abs(out.copies - out.rate) < 1).all()


def test_capped_rates_only_drop(spark):
    docs, labels = mixed_corpus(spark)
    out = soft_mixing.mix_to_targets(docs, labels, {"good": 1.0, "low": 0.5, "toxic": 0.0}, relative=True, max_rate=1.0).toPandas()
    kept = out.groupby("domain").copies.mean()
    assert kept["good"] == 1.0 and 0.35 < kept["low"] < 0.65 and kept["toxic"] == 0.0


def test_descent_reaches_the_least_squares_optimum(spark):
    rows = [(0.9, 0.1, 50), (0.2, 0.8, 30), (0.5, 0.5, 20)]
    points = spark.createDataFrame(rows, "p0 double, p1 double, tokens long")
    moves, residual = soft_mixing.fit_moves(points, [70.0, 20.0], max_rate=4.0, rounds=200, tolerance=1e-12)
    assert max(map(abs, residual)) < 1e-4
    rates = points.select(soft_mixing.rate_after(moves, 4.0).alias("r")).collect()
    assert all(0 <= r.r <= 4 for r in rates)


def test_mixing_without_labels_changes_nothing(spark):
    docs, labels = mixed_corpus(spark, 9)
    assert {(r.rate, r.copies) for r in soft_mixing.mix_to_targets(docs, labels.limit(0), {"good": 1.0}).collect()} == {(1.0, 1)}


# 9 leaks
ITEMS = [(1, "Anna buys 12 apples for 3 dollars each and gives 5 apples to Peter. How many apples does Anna keep after that?"), (2, "A train leaves the northern station at noon and travels seventy miles before it stops near the old bridge.")]


def leaks(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = templates.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), **options)
    return {r.doc_id: (r.contaminated, list(r.item_ids)) for r in out.collect()}


def test_exact_lowered_and_reparameterised_items_are_caught(spark):
    filler = "Some other words that stand around the passage and mean nothing in particular. "
    again = ITEMS[0][1].replace("Anna", "Maria").replace("Peter", "Paul").replace("12", "340").replace(" 3 ", " 7 ").replace("5", "9").replace("dollars", "euros")
    mixed = ITEMS[0][1].replace("Anna buys", "Maria buys").replace("does Anna", "does Julia").replace("12", "7")
    got = leaks(spark, [(1, filler + ITEMS[0][1] + filler), (2, ITEMS[1][1].lower()), (3, filler + again), (4, filler * 3), (5, None), (6, ""), (7, ITEMS[1][1][:40]), (8, filler + ITEMS[1][1] + " " + again)])
    assert got[1] == (True, [1]) and got[2] == (True, [2]) and got[3] == (True, [1]) and got[8] == (True, [1, 2])
    assert not any(got[i][0] for i in (4, 5, 6, 7))
    assert not leaks(spark, [(1, mixed)], max_conflicts=0.0, min_words=20)[1][0]


LONGER = {"Anna": "Maria Luisa Rossi", "Peter": "Paul von Berg", "12": "one hundred twenty", " 3 ": " twenty five ", "gives 5": "gives 1,200", "dollars": "euros"}


def test_items_asked_anew_with_longer_numbers_and_names_are_caught(spark):
    filler = "some other words that stand around the passage and mean nothing in particular. "
    rows = []
    for i in range(1, 1 << len(LONGER)):
        text = ITEMS[0][1]
        for k, (a, b) in enumerate(LONGER.items()):
            text = text.replace(a, b) if i >> k & 1 else text
        rows.append((i, filler * (i % 3) + text + " " + filler))
    got = leaks(spark, rows)
    assert sum(got[i] == (True, [1]) for i, _ in rows) >= 0.95 * len(rows)
    swapped = ITEMS[0][1].replace("does Anna", "does Peter").replace("12", "one hundred twenty").replace("3", "9").replace("5 apples", "one hundred twenty apples")
    assert not leaks(spark, [(1, filler + swapped)], max_conflicts=0.0, min_words=21)[1][0]


def test_few_windows_that_cover_enough_words_are_a_leak(spark):
    """Two windows cover 16 of 17 words; the verdict is the same whatever other items the table holds."""
    words = "the quiet river bends around old mills where patient farmers once carried heavy sacks across the narrow bridge".split()[:17]
    changed = " ".join([*words[:8], "unlike", *words[9:]])
    docs = spark.createDataFrame([(1, changed), (2, " ".join(words[:12]))], "doc_id long, text string")
    for others in ([], [(2, None)], [(3, "one short item")]):
        items = spark.createDataFrame([(1, " ".join(words)), *others], "item_id long, text string")
        got = {r.doc_id: (list(r.item_ids), r.covered_words) for r in templates.contaminated(docs, items).collect()}
        assert got == {1: ([1], 16), 2: ([], 0)}


def test_empty_and_short_benchmarks(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in templates.contaminated(docs, none).collect())
    short = spark.createDataFrame([(1, "beta gamma delta"), (2, None), (3, "")], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in templates.contaminated(docs, short).collect()} == {1: True, 2: False}


def test_registered_leaks_match_a_word_scan(spark, texts):
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: tok(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    where = defaultdict(set)
    for i, w in items.items():
        for j in range(len(w) - 12):
            where[tuple(w[j : j + 13])].add(i)
    want = {}
    for d, t in texts.items():
        w = tok(t)
        want[d] = sorted({i for j in range(len(w) - 12) for i in where.get(tuple(w[j : j + 13]), ())})
    got = {r.doc_id: list(r.item_ids) for r in queries.op9_template_leaks(spark, SF).collect()}
    assert all(set(want[d]) <= set(got[d]) for d in want)
    assert sum(bool(x) for x in got.values()) <= sum(bool(x) for x in want.values()) + 2


# awkward input
OPERATORS = {
    "quality": quality_rules.quality_verdicts,
    "shards": hilbert.hilbert_shards,
    "languages": lambda d: langid.identify(d, d),
    "near": superminhash.near_duplicates,
    "bytes": prefix_free.remove_repeated_bytes,
    "mixing": lambda d: soft_mixing.mix_to_targets(d, d.sparkSession.createDataFrame([(6, "a"), (4, None), (None, "b")], "doc_id long, domain string"), {"a": 1.0}, min_docs=1),
    "leaks": lambda d: templates.contaminated(d, d.sparkSession.createDataFrame([(1, None), (2, "one two"), (2, "one two")], "item_id long, text string")),
    "windows": diffcover.remove_repeated_windows,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_and_empty_tables(spark, name):
    out = OPERATORS[name](awkward(spark))
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    want = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None] if name in ("leaks", "mixing") else [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, None, None]
    assert sorted(ids, key=str) == sorted(want, key=str)  # one row a row, or one an id
    assert OPERATORS[name](empty(spark)).count() == 0


def test_values_on_awkward_rows(spark):
    docs = awkward(spark)
    by = lambda out: {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    near = by(superminhash.near_duplicates(docs))
    assert [near[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1] and (near[7].component_id, near[7].kept, near[6].kept) == (6, False, True)
    cut = by(prefix_free.remove_repeated_bytes(docs))
    size = len(" ".join(f"w{i % 977} und" for i in range(30_000)))
    assert (cut[6].n_bytes, cut[6].n_removed, cut[7].n_removed) == (size, size, size) and cut[1].n_bytes == 0 and cut[4].n_removed == 0
    assert cut[8].n_removed == 900 and cut[9].n_removed == 600 and cut[10].n_removed == 10_000  # they repeat inside themselves
    late = by(diffcover.remove_repeated_windows(docs))
    assert (late[6].n_removed, late[7].n_removed, late[1].n_words) == (0, 60_000, 0)
    rules = by(quality_rules.quality_verdicts(docs))
    assert rules[1].base_failed and rules[1].n_words == 0 and rules[6].n_words == 60_000
    langs = by(langid.identify(docs, docs))
    assert all(r.lang_pred == "und" for r in langs.values())  # nothing is labelled
    items = spark.createDataFrame([(5, "one two"), (6, "No id here, at all!")], "item_id long, text string")
    found = {r.doc_id: list(r.item_ids) for r in templates.contaminated(docs, items).where("contaminated").collect()}
    assert found == {None: [6]}  # numbers alone are no evidence


# pipeline
@pytest.mark.parametrize("rows", ["empty", "awkward"])
def test_pipeline_stages_on_awkward_tables(spark, rows):
    docs = (empty if rows == "empty" else awkward)(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.count() <= before, name
    assert docs.where("doc_id is null").count() == 0


def test_pipeline_stages_on_repeated_ids(spark):
    """Sharding gives a row for a row; near_dedup one for an id and one for a text."""
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, text), (1, text), (2, other), (2, text + " x y z"), (3, text), (None, other), (None, other)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    placed = corpus_pipeline.sharding(spark, docs, SF)
    assert sorted(((r.doc_id or 0, r.text) for r in placed.collect())) == sorted((i or 0, t) for i, t in rows)
    assert len({(r.shard, r.slot) for r in placed.collect()}) == len(rows)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.where("doc_id is not null"), SF).collect()]
    assert sorted(kept) == [(1, text), (2, other)]
    clashing = docs.withColumn("row_key", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("bucket", F.lit("x"))
    assert corpus_pipeline.sharding(spark, clashing, SF).count() == len(rows)
    assert corpus_pipeline.near_dedup(spark, clashing.where("doc_id = 1"), SF).count() == 1


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name == "near_dedup":
            groups = brute_groups({i: texts[i] for i in before}, 5)
            assert set(after) == {i for i in before if groups[i][1] == i}
        if name == "mixing":
            clean = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert len(set(clean) & set(after)) >= 0.95 * len(clean)
        if name != "sharding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        sizes.append(len(after))
    assert sizes[-1] == sizes[-2] > 0


def test_an_id_with_two_texts_lines_up_each_by_itself(spark):
    """Halves of an item in two texts of one id make no diagonal; the whole item in one of them does."""
    words = ITEMS[1][1].split()
    first, second = " ".join(words[:10]), "x " * 10 + " ".join(words[10:])
    assert leaks(spark, [(1, first), (1, second), (None, ITEMS[1][1])]) == {1: (False, []), None: (True, [2])}
    assert leaks(spark, [(1, first), (1, ITEMS[1][1])]) == {1: (True, [2])}
