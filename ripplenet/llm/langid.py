"""Language identification by mixture inference.

A language is a distribution over hashed byte trigrams of words.  For a document, expectation-
maximisation over its words estimates the share of each language; nested language sets (the
largest shares first) are fitted anew, and the set of highest penalised likelihood
(half the logarithm of the number of words for each language beyond the first) is its answer.

Plan: one aggregation counts (language, trigram bucket) over all labelled documents, each task
adding up its own first; the model (languages x buckets, a parameter) is broadcast;
prediction is a map over texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

BUCKETS = 1 << 15
#: A-Z lower-cased, other ASCII that is no letter turned to spaces, bytes of other letters kept.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(folded: bytes) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def has_letter(raw: bytes) -> bool:
    folded = raw.translate(FOLD)
    return any(97 <= x <= 122 for x in set(folded)) or (not folded.isascii() and any(ch.isalpha() for ch in raw.decode("utf-8", "replace")))


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folded = b" " + raw.as_py().translate(FOLD) + b" "
            if len(folded) > 2:
                got = np.bincount(trigrams(folded), minlength=BUCKETS) if len(folded) > 2048 else None
                if got is None:
                    at, n = np.unique(trigrams(folded), return_counts=True)
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
                else:
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += got
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def word_likelihoods(text: bytes, logp: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word (trigrams from the space before it on) per language."""
    folded = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    if len(folded) < 3:
        return np.zeros((0, logp.shape[1]), np.float32)
    out, cut = [], 0
    while cut < len(folded) - 2:  # long texts in pieces that end at a space
        end = folded.rfind(b" ", cut + 1, cut + (1 << 16))
        end = len(folded) - 1 if end < 0 else end
        piece = np.frombuffer(folded, np.uint8)[cut:end]
        at = np.flatnonzero(piece == 32)
        out.append(np.add.reduceat(logp[trigrams(folded[cut : end + 2] + b" " * (end + 2 > len(folded)))], at, axis=0))
        cut = end
    return np.concatenate(out)


def shares(p: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM estimate of the mixture weights and the log-likelihood under them."""
    w = np.full(p.shape[1], 1 / p.shape[1], p.dtype)
    for _ in range(rounds):
        r = p * w
        w = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    return w, float(np.log(p @ w).sum())


def infer(ll: np.ndarray, most: int | None, rounds: int) -> tuple[list[int], np.ndarray]:
    """Languages of the best penalised set, largest share first, and their shares."""
    p = np.exp(ll - ll.max(axis=1, keepdims=True)) + np.float32(1e-30)
    w, _ = shares(p, rounds)
    order = np.argsort(-w, kind="stable")
    best = None
    for k in range(1, (len(order) if most is None else min(most, len(order))) + 1):
        if k > 1 and w[order[k - 1]] * len(p) < 1:
            break  # less than one word: no likelihood can pay for it
        v, fit = shares(p[:, order[:k]], rounds)
        fit -= 0.5 * (k - 1) * np.log(len(p))
        if best is None or fit > best[0]:
            best = fit, order[:k], v
    rank = np.lexsort((best[1], -best[2]))
    return best[1][rank].tolist(), best[2][rank]


def _predict(model, langs: list[str], most: int | None, rounds: int, field: str | None):
    """The text is the second column, or the named field of the last one."""

    def run(batches):
        logp, at_row = model.value, 1 if field else 2
        for batch in batches:
            preds, scores, sets, parts = [], [], [], []
            for raw in batch.columns[-1].field(field).cast(pa.binary()) if field else batch.column(1):
                raw = raw.as_py() or b""
                ll = word_likelihoods(raw, logp) if langs and has_letter(raw) else ()
                if len(ll):
                    at, share = infer(ll, most, rounds)
                    preds.append(langs[at[0]])
                    scores.append(min(1.0, float(share[0])))
                    sets.append([langs[i] for i in at])
                    parts.append([float(x) for x in share])
                else:
                    preds.append("und")
                    scores.append(0.0)
                    sets.append([])
                    parts.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds), pa.array(scores), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), *batch.columns[at_row:]],
                ["doc_id", "lang_pred", "score", "languages", "shares", *batch.schema.names[at_row:]],
            )

    return run


def train(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities (buckets, languages) from all labelled rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(_count, "lang string, bucket int, n long")
    # at most languages x BUCKETS rows reach the driver
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), smoothing)
    table[found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy()) if len(found) else []] += found["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_languages: int | None = None,
    rounds: int = 8,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) for every row of ``docs``.

    With ``carry`` the row's own columns follow as one struct ``row``, which saves a join.
    Only the text of ``docs`` is judged.  ``score`` is the share of the predicted language in the selected
    mixture; sets of any size are tried unless ``max_languages`` bounds them.  Null texts, texts without a letter, and all texts when nothing is labelled
    are ``und`` with score 0.  Ties go to the language first in order.  Rows are judged one by one, so
    repeated ids and extra columns do no harm.
    """
    langs, logp = train(labelled, lang_col=lang_col, text_col=text_col)
    model = docs.sparkSession.sparkContext.broadcast(logp)
    # a carried row brings its text along: workers get it once
    inside = carry and dict(docs.dtypes).get(text_col) in ("string", "binary")
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(text_col).cast("binary").alias("raw")] * (not inside), *[F.struct(*docs.columns).alias("row")] * carry
    )
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")
    return slim.mapInArrow(_predict(model, langs, max_languages, rounds, text_col if inside else None), T.StructType([*schema.fields, *slim.schema.fields[1 if inside else 2 :]]))
