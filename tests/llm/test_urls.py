"""Learned lexicon, awkward urls and held-out hosts."""

from __future__ import annotations

import pytest

from ripplenet.llm import queries, url_filter


def test_words_of_pages_split_hosts(spark):
    rows = [(1, "http://zorbledrast.example.com/en/1", "<p>Zorble, drast! zorble</p><script>var hidden = 'qq';\nvar zorbledrast = 1;\nzorbledrast();</script>"), (2, "http://x.org/", "<b>drast</b> drast zorble")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = lambda **k: {r.page_id: r.words for r in url_filter.judge_urls(pages, **k).collect()}[1]
    assert words(html_col="html")[:2] == ["zorble", "drast"]
    assert words()[0] == "?zorbledrast"


def test_awkward_urls(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, word string, bucket int"
    odd = [None, "", "://", "http://", "http:///p", "x" * 100_000, "http://" + "casino" * 3000 + ".com/", "http://a.net/", "http://a.net/"]
    rows = [(i if i < 8 else 7, u, None, "h", "p", "r", "w", 1) for i, u in enumerate(odd)] + [(None, "http://cheappills.com", "<p", None, None, None, None, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, schema), html_col="html").collect()
    assert len(got) == len(rows) and sum(r.page_id == 7 for r in got) == 2
    by = {r.page_id: r for r in got}
    assert all((by[i].host, by[i].path, by[i].rule, by[i].verdict) == ("", "", None, "allow") for i in (0, 1, 2, 3, 5))
    assert by[4].host == "" and by[4].path == "/p" and by[6].verdict == "block" and by[7].verdict == "block" and by[7].rule == "net/" and by[None].verdict == "block"
    assert url_filter.judge_urls(spark.createDataFrame([], schema), html_col="html").count() == 0


def test_held_out_hosts_are_told_apart():
    """Fitted on four fifths of the labelled hosts, the others get their label."""
    blocked, allowed = url_filter.BLOCKED_HOSTS.split(), url_filter.ALLOWED_HOSTS.split()
    seeds = frozenset((url_filter.COMMON + " " + url_filter.UNWANTED).split())
    right = 0
    for fold in range(5):
        part = lambda hosts, inside: [h for i, h in enumerate(hosts) if (i % 5 == fold) == inside]  # noqa: B023, E731
        seg, bayes = url_filter.train({}, seeds, " ".join([*part(blocked, False), url_filter.UNWANTED]), " ".join([*part(allowed, False), url_filter.COMMON]), 0.2)
        for hosts, label in ((blocked, True), (allowed, False)):
            for h in part(hosts, True):
                right += (bayes.score([p for n in url_filter.names(h, "") for p in seg.split(n)]) > 0) == label
    print(f"held-out agreement {right / (len(blocked) + len(allowed)):.2f}")
    assert right >= 0.8 * (len(blocked) + len(allowed))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_pages_block_unwanted_hosts_only(spark, sf):
    """Beyond the rules, hosts of the unwanted words are blocked and hosts of invented syllables allowed."""
    for r in queries.op4_url_segments(spark, f"/root/testdata/{sf}").where("rule is null").collect():
        assert (r.verdict == "block") == ("-" in r.host), r.host
