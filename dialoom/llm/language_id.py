"""Language ID: blended-spectrum string kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of character n-grams (n = 1..`max_n`, lower case, each run of other characters than letters
as one space) that are present in both, over the root of the product of their own numbers. Presence is kept in `buckets` hashed
bits. With landmarks L, K(x, L) = P(x) P(L)' / (|x| |L|), and ridge regression on the landmark features gives one coefficient
for each landmark and language. Because the kernel is linear in P(x), the coefficients fold into one matrix of buckets x
languages, and a batch of texts is scored by one matrix product; the result is the same number as through the landmarks.

Fit: on a bounded sample of labelled rows, `per_lang` rows of each language chosen by a hash of the row (documented bound; the
rows' whole texts are used). At most `max_langs` languages share `max_langs * per_lang` rows. Prediction is a map over
partitions on whole texts, without any label or id among its inputs.

Defined cases: `und` with score 0 where text is null or has no letter, or where nothing could be learned; with one learned
language every other text gets it; equal texts get equal results; a null doc_id is neither learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import small_batches, texts

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        t = np.zeros(0x110000, bool)
        for i in [*range(0x32400), *range(0xE0000, 0xE0200)]:
            t[i] = chr(i).isalpha()
        _letters.append(t)
    return _letters[0]


class Presence:
    """Presence bits of hashed character n-grams."""

    def __init__(self, max_n: int = 4, buckets: int = 1 << 15):
        self.max_n, self.buckets = max_n, buckets

    def of(self, text: str) -> np.ndarray:
        """The sorted buckets of a text's n-grams; none if it has no letter."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        if not letter.any():
            return np.zeros(0, np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space for each run of others
        code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
        seen = np.zeros(self.buckets, bool)
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, min(self.max_n, len(code)) + 1):
            gram = gram[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
            h = (gram ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
            seen[(h >> np.uint64(32)) % np.uint64(self.buckets)] = True
        return np.flatnonzero(seen)

    def matrix(self, many: list[np.ndarray]) -> np.ndarray:
        """A row of presence over root of its number for each text."""
        out = np.zeros((len(many), self.buckets), np.float32)
        for i, b in enumerate(many):
            if len(b):
                out[i, b] = 1 / np.sqrt(len(b))
        return out


class LanguageModel:
    def __init__(self, presence: Presence, langs: list[str], weights: np.ndarray | None):
        self.presence, self.langs, self.weights = presence, langs, weights

    @staticmethod
    def fit(rows: list[tuple[str, str]], presence: Presence, landmarks: int = 40, ridge: float = 1e-3, block: int = 128) -> LanguageModel:
        """rows: text and language, in a fixed order; the first `landmarks` of each language are its landmarks."""
        rows = [(b, lang) for text, lang in rows if len(b := presence.of(text))]
        langs = sorted({lang for _, lang in rows})
        if len(langs) < 2:
            return LanguageModel(presence, langs, None)
        marks = [b for lang in langs for b in [b for b, x in rows if x == lang][:landmarks]]
        m = presence.matrix(marks)
        k_mm = (m @ m.T).astype(np.float64)
        gram, right = np.zeros_like(k_mm), np.zeros((len(marks), len(langs)))
        weight = {lang: len(rows) / len(langs) / sum(x == lang for _, x in rows) for lang in langs}
        for i in range(0, len(rows), block):
            part = rows[i : i + block]
            k = (presence.matrix([b for b, _ in part]) @ m.T).astype(np.float64)
            y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for _, x in part])
            w = np.array([[weight[x]] for _, x in part])
            gram += k.T @ (k * w)
            right += k.T @ (y * w)
        coefficients = np.linalg.solve(gram + ridge * len(rows) * k_mm + 1e-6 * np.trace(k_mm) / len(marks) * np.eye(len(marks)), right)
        return LanguageModel(presence, langs, (m.T.astype(np.float64) @ coefficients).astype(np.float32))

    def predict(self, many: list[str | None], block: int = 64) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(many), [0.0] * len(many)
        held: list[tuple[int, np.ndarray]] = []

        def score() -> None:
            if self.weights is None:
                for i, _ in held:
                    langs[i], scores[i] = self.langs[0], 1.0
            elif held:
                out = self.presence.matrix([b for _, b in held]) @ self.weights
                best = out.argmax(1)
                for (i, _), j, s in zip(held, best.tolist(), np.clip((out.max(1) + 1) / 2, 0, 1).tolist(), strict=True):
                    langs[i], scores[i] = self.langs[j], s
            held.clear()

        for i, text in enumerate(many if self.langs else []):
            if text is not None and len(b := self.presence.of(text)):
                held.append((i, b))
                if len(held) == block:
                    score()
        score()
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = 300, max_langs: int = 64, presence: Presence | None = None) -> LanguageModel:
    """Fits on rows of docs(doc_id, text, lang) that have a language and are not held out."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t"), F.col("lang").cast("string").alias("l"))
    own = own.where(F.col("l").isNotNull() & F.col("d").isNotNull() & ~held_out(F.col("d")))
    sizes = own.groupBy("l").count().collect()  # one row for each language
    if not sizes:
        return LanguageModel(presence or Presence(), [], None)
    quota = max(2, min(per_lang, per_lang * max_langs // len(sizes)))
    share = spark.createDataFrame([(r["l"], min(1.0, (quota + 5 * quota**0.5 + 10) / r["count"])) for r in sizes], "l string, share double")
    pick = F.xxhash64("d", F.lit("language sample"))
    drawn = own.withColumn("h", pick).join(F.broadcast(share), "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("l", "h", "t").collect()
    by: dict[str, list] = {}
    for r in sorted((r for r in drawn if r["t"] is not None), key=lambda r: (r["l"], r["h"], r["t"])):
        by.setdefault(r["l"], []).append(r["t"])
    return LanguageModel.fit([(t, lang) for lang, ts in by.items() for t in ts[:quota]], presence or Presence())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast((model.presence.max_n, model.presence.buckets, model.langs, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        max_n, buckets, langs, weights = sent.value
        own = LanguageModel(Presence(max_n, buckets), langs, weights)
        for batch in batches:
            found, scores = own.predict(texts(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **fit: int) -> DataFrame:
    """Trains on docs and predicts all of them: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs, **fit)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
