"""Language identification by error-correcting output codes.

Method: every language gets a codeword; for each bit a binary classifier
on hashed byte trigrams tells the languages with 1 from those with 0; the
loss of all bits' margins decides for the nearest codeword, and a small
lead over the second nearest is flagged as ambiguous.

Training counts trigrams of all training rows (partial counts per task,
summed by feature in Spark); per bit the smoothed log-odds of a trigram is
its weight. Only ``2**bits`` rows of sums, whatever the corpus, reach the
driver, and as many weights go out to the tasks. Prediction reads each
text once, in its own row, with no shuffle.

Codes: up to five languages get the exhaustive code (all distinct
two-way splits), more get 8 bits per doubling of languages, drawn from a
fixed seed. No two codewords are equal, and no two columns split the
languages in the same two.

Defined cases. A null text, or one without a letter (Unicode category L:
numbers such as "½" or "Ⅷ" are none), is ``und`` with score 0 and not ambiguous. Rows with a null id are held out. Rows with a null
label don't train. Without any training row all texts are ``und``; with one
language all texts with a letter are that language, score 1. Ties go to
the label that sorts first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

_TO_SPACE = bytes(32 if b < 0x80 and not 97 <= b <= 122 else b for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def trigrams(texts: list[str | None], bits: int, most: int = 1 << 20):
    """For groups of texts: hashed trigram numbers of all, and each text's first place."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and (not parts or size < most):
            parts.append(b"  " + (texts[i] or "").lower().encode().translate(_TO_SPACE) + b"  ")
            size += len(parts[-1])
            i += 1
        raw = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
        key = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        yield (key * np.uint32(2654435761)) >> np.uint32(32 - bits), \
            np.cumsum([0, *map(len, parts)])[:-1]


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1, one column for each binary classifier."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(columns, np.int8).T
    rng, width = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(k)))
    while True:
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < width:                          # a split and its complement are one
            c = rng.choice(np.array([-1, 1], np.int8), k)
            if abs(int(c.sum())) < k:
                columns.setdefault((c * c[0]).tobytes(), c * c[0])
        m = np.stack(list(columns.values()), 1)
        if len(np.unique(m, axis=0)) == k:
            return m


def train(labelled: DataFrame, bits: int = 14):
    """(languages, codewords, weights) from rows (text, lang)."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = b.column(0).to_pylist()
            for lang in set(langs.tolist()):
                own = total.setdefault(lang, np.zeros(size, np.int64))
                for grams, _ in trigrams([texts[i] for i in np.flatnonzero(langs == lang)], bits):
                    own += np.bincount(grams, minlength=size)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                ["lang", "gram", "n"])

    rows = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    code = codewords(len(langs))
    weights = np.zeros((size, code.shape[1]), np.float32)
    if code.shape[1]:
        sums = [F.sum(F.when(F.col("lang").isin([x for x, c in zip(langs, code[:, j]) if c == s]),
                             F.col("n")).otherwise(0)).alias(f"{name}{j}")
                for j in range(code.shape[1]) for name, s in (("p", 1), ("m", -1))]
        got = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("gram").agg(*sums).toPandas()
        n = np.ones((size, 2 * code.shape[1]))
        n[got["gram"].to_numpy()] += got.drop(columns="gram").to_numpy()
        n = np.log(n / n.sum(0))
        weights[:] = n[:, 0::2] - n[:, 1::2]
    return langs, code, weights


def margins(texts: list[str | None], weights: np.ndarray, bits: int) -> np.ndarray:
    """Each text's margin for each bit: mean log-odds, times the root of their
    number up to 4, so that short texts stay unsure and mixed ones do too."""
    out = []
    for grams, first in trigrams(texts, bits):
        n = np.diff([*first, len(grams)])
        out.append(np.add.reduceat(weights[grams], first, axis=0) * (np.minimum(np.sqrt(n), 4) / n)[:, None])
    return np.concatenate(out) if out else np.zeros((0, weights.shape[1]))


def identify(docs: DataFrame, model, bits: int = 14, lead: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, held_out, text) with lang_pred, score and ambiguous."""
    langs, code, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            known = np.array([bool(langs) and has_letter(t) for t in texts], bool)
            if code.shape[1]:
                m = margins(texts, shared.value, bits)
                loss = np.logaddexp(0, -m[:, None, :] * code[None]).sum(2)
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
            else:
                p = np.ones((len(texts), max(1, len(langs))))
            best, ranked = p.argmax(1), np.sort(p, 1)
            close = known & (p.shape[1] > 1) & (ranked[:, -1] - ranked[:, -2 if p.shape[1] > 1 else -1] < lead)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1),
                pa.array([langs[i] if k else "und" for i, k in zip(best, known)], pa.string()),
                pa.array(np.where(known, p.max(1), 0.0)), pa.array(close)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return identify(docs, train(docs.filter(~F.col("held_out"))))
