"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, the same in every process. A letter n-gram is bound
from its letters' vectors, each rotated by its position; a text bundles its n-grams; a language bundles
its labelled texts. A text gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from hydroseries.llm.common import is_held_out, map_batches, mix, texts

GRAM = 3
#: Unit vectors are summed as whole numbers of this fineness, so that sums don't depend on their order.
FINE = 1 << 20


class Encoder:
    """Texts to hypervectors. Caches the vectors of letters and n-grams, in bounded memory."""

    def __init__(self, dims: int = 512, seed: int = 1, most: int = 16_384):
        self.dims, self.seed, self.most = dims, seed, most
        self.letters: dict[int, np.ndarray] = {}
        # The letters of the lower plane, looked up by code point; 0 stands between words.
        self.table = np.array([c if chr(c).isalpha() else 0 for c in range(0x3000)], dtype=np.uint32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((0, self.dims), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            at = np.arange(self.dims, dtype=np.uint64) + np.uint64(code * 0x10000 + self.seed * 0x1000000000)
            v = self.letters[code] = np.where(mix(mix(at)) >> np.uint64(63), 1, -1).astype(np.float32)
        return v

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The distinct n-grams of a text (three code points of 21 bits) and their counts; None without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(codes):
            return None
        letters = self.table[np.minimum(codes, len(self.table) - 1)]
        high = np.flatnonzero(codes >= len(self.table))
        if len(high):
            found, back = np.unique(codes[high], return_inverse=True)
            letters[high] = np.array([c if chr(c).isalpha() else 0 for c in found.tolist()], dtype=np.uint32)[back]
        if not letters.any():
            return None
        # One gap between words, at both ends too.
        keep = letters != 0
        keep[1:] |= keep[:-1].copy()
        x = np.concatenate([[0], letters[keep], [0]]).astype(np.int64)
        packed = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
        return np.unique(packed, return_counts=True)

    def gram_rows(self, packed: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for these distinct n-grams, which are added if they are new."""
        if len(self.known) + len(packed) > self.most:
            self.clear()
        new = [g for g in packed.tolist() if g not in self.known]
        if new:
            part = (1 << 21) - 1
            made = [
                np.stack([np.roll(self.letter(g >> shift & part), place) for g in new])
                for place, shift in enumerate((42, 21, 0))
            ]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.vectors = np.concatenate([self.vectors, made[0] * made[1] * made[2]])
        return np.array([self.known[g] for g in packed.tolist()], dtype=np.int64)

    def encode(self, batch: list[bytes | None]) -> np.ndarray:
        """Unit vectors; all zero for a text that is null or has no letter."""
        out = np.zeros((len(batch), self.dims), dtype=np.float32)
        counted = [(i, g) for i, t in enumerate(batch) if t and (g := self.grams(t.decode("utf-8", "replace")))]
        if not counted:
            return out
        codes, back = np.unique(np.concatenate([g[0] for _, g in counted]), return_inverse=True)
        counts = np.zeros((len(counted), len(codes)), dtype=np.float32)
        counts[np.repeat(np.arange(len(counted)), [len(g[0]) for _, g in counted]), back] = np.concatenate(
            [g[1] for _, g in counted]
        )
        for at in range(0, len(codes), self.most):
            part = slice(at, at + self.most)
            rows = self.gram_rows(codes[part])
            out[[i for i, _ in counted]] += counts[:, part] @ self.vectors[rows]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        # n-grams can cancel out exactly; such a text still has letters.
        lost = [i for i, _ in counted if norm[i] == 0]
        out[lost, 0], norm[lost] = 1, 1
        return np.divide(out, norm, out=out, where=norm > 0)


def _parts(texts_: list, most: int = 64, size: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Runs of at most ``most`` texts and about ``size`` bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts_):
        if i > start and (i - start >= most or held > size):
            yield start, texts_[start:i]
            start, held = i, 0
        held += len(t or b"")
    if start < len(texts_):
        yield start, texts_[start:]


def learn_prototypes(labelled: DataFrame, dims: int = 512) -> dict[str, np.ndarray]:
    """Prototype of every language of ``labelled`` (text, lang): the bundle of its texts' unit vectors.

    Sums are folded in tasks and shuffled by language and dimension; languages times dimensions numbers come back.
    """

    def run(batches):
        coder, sums = Encoder(dims), {}
        for b in batches:
            langs = np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), dtype=object)
            for at, part in _parts(b.column(b.schema.get_field_index("text")).to_pylist()):
                vectors = np.rint(coder.encode(part) * FINE).astype(np.int64)
                of = langs[at : at + len(part)]
                for lang in set(of):
                    sums[lang] = sums.get(lang, 0) + vectors[of == lang].sum(axis=0)
        for lang, v in sums.items():
            yield {"lang": [lang] * dims, "dim": np.arange(dims, dtype=np.int32), "total": v}

    partial = map_batches(labelled.select("text", "lang"), run, "lang string, dim int, total long")
    rows = partial.groupBy("lang", "dim").agg(F.sum("total").alias("total")).toPandas()
    out = {}
    for lang, part in rows.groupby("lang"):
        v = np.zeros(dims)
        v[part["dim"].to_numpy()] = part["total"].to_numpy()
        if np.linalg.norm(v) > 0:
            out[lang] = v / np.linalg.norm(v)
    return out


def predict_language(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", pred: str = "lang_pred", score: str = "score",
    dims: int = 512,
) -> DataFrame:
    """``docs`` with two more columns: the language and half of one plus its cosine. Nothing is shuffled.

    A text that is null or has no letter gets ``und`` and 0, as does every text if there is no prototype. Ties go to the
    first language by name.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, dims), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # languages times dims numbers
    kind = StructType(list(docs.schema.fields)).add(pred, StringType()).add(score, DoubleType())
    arrow, columns = to_arrow_schema(kind), docs.columns

    def run(batches):
        coder, m = Encoder(dims), shared.value
        for b in batches:
            langs, scores = [], []
            for _, part in _parts(b.column(columns.index(text_col)).cast(pa.binary()).to_pylist()):
                vectors = coder.encode(part)
                if not len(m):
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cosines = vectors @ m.T
                best = cosines.argmax(axis=1)
                some = np.any(vectors != 0, axis=1)
                langs += [names[k] if yes else "und" for k, yes in zip(best.tolist(), some.tolist())]
                top = np.clip(np.round((1 + cosines[np.arange(len(part)), best].astype(float)) / 2, 5), 0, 1)
                scores += np.where(some, top, 0.0).tolist()
            kept = [b.column(i) for i in range(len(columns))]
            out = [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    return docs.mapInArrow(run, kind)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 512
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    Learns from text and non-null language of documents whose crc32(doc_id) modulo 4 is not 2; a null id counts as the
    empty text there. Empty table: no rows. Repeated rows: predicted each, learned from each.
    """
    rows = texts(docs, id_col, text_col, lang=lang_col).withColumn("held_out", is_held_out(4))
    prototypes = learn_prototypes(rows.where(~F.col("held_out") & F.col("lang").isNotNull()), dims)
    return predict_language(rows.select("doc_id", "held_out", "text"), prototypes, dims=dims).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def keep_known_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 512
) -> DataFrame:
    """The rows of ``docs`` whose text is in some language; those of ``und`` go."""
    rows = texts(docs, id_col, text_col, lang=lang_col)
    prototypes = learn_prototypes(rows.where(~is_held_out(4) & F.col("lang").isNotNull()), dims)
    known = predict_language(docs, prototypes, text_col, "_lang_pred", "_lang_score", dims)
    return known.where(F.col("_lang_pred") != "und").drop("_lang_pred", "_lang_score")
