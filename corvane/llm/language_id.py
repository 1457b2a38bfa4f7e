"""Language ID by error-correcting output codes over binary n-gram classifiers.

Every language has a codeword, a row of a Hadamard matrix, so any two differ in half of all bits.
For each bit a binary classifier tells the languages with a one from those with a zero: a naive
Bayes over hashed byte n-grams, whose weights come from each language's n-gram frequencies.  Decoding
weighs every bit by its loss, so a few wrong bits are outvoted, and the nearest codeword
wins; a text whose two nearest codewords are about as near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

#: Buckets of hashed n-grams, for each order.
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
#: Texts are counted and scored in pieces of so many bytes; longer ones are cut.
SLICE_BYTES = 1 << 20
#: Languages that may be learnt, as the model, which is broadcast, has 98,305 numbers of 4 bytes for each bit: 100 MB.
MOST_LANGUAGES = 255
#: A language's counts in a row of the shuffle that sums them.
PIECE = 1 << 13
#: Predictions whose score is lower are flagged as ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits and ASCII punctuation say nothing of the language.
_LOWER[[b for b in range(33, 127) if not chr(b).isalpha()]] = 32


def ngrams(texts: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Piece by piece, for each order the buckets of all n-grams by place of their first byte, and the texts' bounds in the piece.

    Buckets of n-grams that would reach over a text's end are that after the last one.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    whole = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    for a in range(0, len(whole), SLICE_BYTES):
        inner = np.clip(bounds, a, a + SLICE_BYTES) - a
        data = _LOWER[whole[a : a + SLICE_BYTES + max(ORDERS) - 1]]
        size, out = int(inner[-1]), []
        left = np.repeat(bounds[1:], np.diff(inner)) - np.arange(a, a + size)
        wide = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
        for k, n in enumerate(ORDERS):
            code = np.zeros(size, np.uint32)
            for j in range(n):
                code |= wide[j : j + size] << np.uint32(8 * j)
            code *= np.uint32(2654435761)
            code = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519)
            bucket = (code >> np.uint32(17)).astype(np.int32) + k * BUCKETS
            bucket[left < n] = len(ORDERS) * BUCKETS
            out.append(bucket)
        yield out, inner


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, any two apart in half of their bits: a Hadamard matrix without its constant column and row."""
    size = 2
    while size <= n:
        size *= 2
    h = np.ones((1, 1), int)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (buckets + 1, bits); the last bucket weighs nothing

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether that is ambiguous, of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sums, length = np.zeros((len(texts), self.codes.shape[1])), np.zeros(len(texts), np.int64)
        for buckets, bounds in ngrams(texts):
            full = np.flatnonzero(np.diff(bounds))
            length += np.diff(bounds)
            for b in buckets:
                sums[full] += np.add.reduceat(self.weights[b], bounds[:-1][full], axis=0)
        # evidence grows with the text, but its n-grams overlap and aren't independent
        margins = sums / len(ORDERS) / np.sqrt(np.maximum(1, length))[:, None]
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]).sum(axis=2)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        score = near[np.arange(len(best)), best] / near.sum(axis=1)
        letters = pc.match_substring_regex(pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), r"\p{L}").to_numpy(zero_copy_only=False)
        langs = [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
        score = np.where(letters, score, 0.0)
        return langs, score, score < AMBIGUOUS


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages in lang_col, from all rows with a text and a language.

    Tasks count n-grams for each language; the counts are summed in pieces by a shuffle, and the driver
    gets one array of fixed size for each language, however many rows there are.  Every language
    weighs the same whatever its share.  Without labelled rows the model knows no language; more than
    MOST_LANGUAGES are an error.  Repeated rows count as often as they are there.
    """
    width = len(ORDERS) * BUCKETS
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, n in slices(batch.column(0), SLICE_BYTES):
                coded = batch.column(1).slice(a, n).dictionary_encode()
                names = coded.dictionary.to_pylist()
                total = np.zeros(len(names) * (width + 1), np.int64)
                for buckets, bounds in ngrams(batch.column(0).slice(a, n)):
                    owner = np.repeat(coded.indices.to_numpy(), np.diff(bounds)).astype(np.int64) * (width + 1)
                    for b in buckets:
                        total += np.bincount(owner + b, minlength=len(total))
                for k, name in enumerate(names):
                    held[name] = held.get(name, 0) + total[k * (width + 1) : (k + 1) * (width + 1) - 1]
        for name, total in held.items():
            for i in range(0, width, PIECE):
                yield pa.RecordBatch.from_pydict({"lang": [name], "piece": pa.array([i], pa.int32()), "counts": pa.array([total[i : i + PIECE].astype("<i8").tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PIECE, np.int64)
        for t in tables:
            for x in t.column(2):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "piece": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "lang string, piece int, counts binary"
    summed = rows.mapInArrow(count, schema).groupBy("lang", "piece").applyInArrow(add, schema)
    # one language more than may be has too many rows already
    found = summed.limit((MOST_LANGUAGES + 1) * (width // PIECE)).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(langs), width))
    for lang, piece, own in zip(found.column("lang").to_pylist(), found.column("piece").to_pylist(), found.column("counts")):
        counts[langs.index(lang), piece : piece + PIECE] = np.frombuffer(own.as_py(), "<i8")
    codes = codewords(len(langs))
    share = np.zeros_like(counts)
    for k in range(len(ORDERS)):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        smoothed = counts[:, own] + 0.5
        share[:, own] = smoothed / smoothed.sum(axis=1, keepdims=True)
    weights = np.zeros((width + 1, codes.shape[1]), np.float32)
    for j in range(codes.shape[1] if langs else 0):
        one, zero = share[codes[:, j] > 0], share[codes[:, j] < 0]
        if len(one) and len(zero):
            weights[:-1, j] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
    return LanguageModel(langs, codes, weights)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous, of names led by the prefix; a null text or one without a letter is `und`.

    All rows and columns stay; columns of those names are replaced.  Languages that tie go to the first by name.
    """
    new = [prefix + n for n in ("lang_pred", "score", "ambiguous")]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # at most MOST_LANGUAGES bits wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, n in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(a, n)
                langs, score, unsure = own.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)], names=[*kept, *new])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    return rows.mapInArrow(run, schema)


def keep_told(docs: DataFrame, model: LanguageModel, langs: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs whose language the model tells: one of `langs`, or any that it learnt, and not ambiguous.

    Texts that are null, without a letter, or about as near to two codewords are rejected.  All columns stay as
    they are, whatever their names; repeated rows stay as often; a model that learnt nothing tells nothing.
    """
    told = identify(docs, model, text_col, "__told_")
    pred = told["__told_lang_pred"]
    wanted = pred != UNDETERMINED if langs is None else pred.isin(langs)
    return told.where(wanted & ~told["__told_ambiguous"]).select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """A fifth of all documents, never learnt from; rows without an id aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn_from(docs: DataFrame) -> LanguageModel:
    """A model of the documents that aren't held out."""
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
