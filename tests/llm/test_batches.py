"""Batches that Python workers get: bounded where a row is large, and each text once."""

from __future__ import annotations

import pytest
from ripplenet.llm import common as c
from ripplenet.llm import langid, superminhash

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def noted(make, path):
    """The same kernel; rows and bytes of each batch that it gets are written to ``path``."""

    def made(*args):
        inner = make(*args)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(path, "a") as out:
                        out.write(f"{batch.num_rows} {batch.nbytes}\n")
                    yield batch

            yield from inner(seen())

        return run

    return made


def sizes(path) -> list[tuple[int, int]]:
    return [tuple(map(int, line.split())) for line in path.read_text().splitlines()]


@pytest.mark.parametrize("own", [None, "32m"])
def test_late_members_reach_workers_in_bounded_batches(spark, tmp_path, monkeypatch, own):
    """48 texts around one text, many of them not its near duplicates, then a chain: blocks of all members stand in every row."""
    base = [f"b{i}" for i in range(120)]
    rows = {}
    for i in range(48):
        w = list(base)
        for j in range(6):
            w[(i * 5 + j * 17) % 120] = f"x{i}_{j}"
        rows[i] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = {tuple(r) for r in superminhash.near_duplicates(docs, shingle_words=2).collect()}
    limit = 1 << 16
    monkeypatch.setattr(c, "BATCH_BYTES", limit, raising=False)
    monkeypatch.setattr(superminhash, "_against", noted(superminhash._against, f"{tmp_path}/got"))
    if own:
        spark.conf.set(BATCH, own)
    try:
        before = spark.conf.get(BATCH)
        got = {tuple(r) for r in superminhash.near_duplicates(docs, shingle_words=2).collect()}
        assert spark.conf.get(BATCH) == before
    finally:
        spark.conf.unset(BATCH)
    found = sizes(tmp_path / "got")
    row = max(size / n for n, size in found)
    assert sum(size for _, size in found) > 4 * limit  # else nothing is shown
    assert max(size for _, size in found) <= limit + 2 * row
    assert got == want


def test_a_carried_text_reaches_workers_once(spark, tmp_path, monkeypatch):
    texts = ["the cat and the dog of the house " * 200, "le chat et le chien de la maison " * 200, None, ""]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", "fr", None, "en"], strict=True))], "doc_id long, text string, lang string").coalesce(1)
    plain = {r.doc_id: tuple(r) for r in langid.identify(docs, docs).collect()}
    monkeypatch.setattr(langid, "_predict", noted(langid._predict, f"{tmp_path}/got"))
    found = langid.identify(docs, docs, carry=True).collect()
    assert sum(size for _, size in sizes(tmp_path / "got")) < 1.5 * sum(len(t or "") for t in texts)
    assert {r.doc_id: tuple(r)[:-1] for r in found} == plain
    assert {tuple(r.row) for r in found} == {tuple(r) for r in docs.collect()}
    raw = docs.withColumn("text", docs.text.cast("binary"))
    assert {r.doc_id: tuple(r)[:-1] for r in langid.identify(raw, docs, carry=True).collect()} == plain
