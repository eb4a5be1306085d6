"""Language identification by hierarchical discrimination.

A one-versus-rest linear SVM predicts the language family; within a family of several languages
one-versus-one linear SVMs vote (ties by summed margins). Features are hashed byte n-grams of the
lower-cased text without ASCII non-letters, as square roots of relative frequencies per order.

The SVMs (squared hinge, dual coordinate descent) are fitted on the driver on a bounded sample:
at most ``SAMPLE_PER_LANGUAGE`` labelled documents of each language, chosen by a hash of the id,
each given whole and as one short piece. Prediction covers every whole text and is row-local.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every
text if no labelled document is there to learn from; a null id is not held out and not learnt
from; repeated rows get equal rows; an empty table gives an empty result. A prediction reads the
text alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from .common import map_slices, small

SAMPLE_PER_LANGUAGE = 300
ORDERS = (2, 3, 4)
BITS = 13
PIECE_WORDS = 6
EPOCHS = 12
COST = 10.0
UNKNOWN = "und"

# Families of common ISO 639-1 codes; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur pa mr gu ne",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes other than letters become spaces.
_LETTERS = bytes(b if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Dense feature vector of a whole text; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    out = np.zeros((len(ORDERS), 1 << BITS), dtype=np.float32)
    code = data
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in ORDERS and len(code):
            at = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            out[ORDERS.index(n)] = np.sqrt(np.bincount(at, minlength=1 << BITS) / len(code))
    return out.ravel()


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear SVM by dual coordinate descent
    over sparse rows (columns, values); both classes weigh the same in total."""
    w = np.zeros(len(ORDERS) * (1 << BITS) + 1)
    positive = max(1, int((signs > 0).sum()))
    negative = max(1, len(signs) - positive)
    cost = np.where(signs > 0, len(signs) / (2 * positive), len(signs) / (2 * negative)) * COST
    diagonal = 1 / (2 * cost)
    square = np.array([float(v @ v) + 1 for _, v in rows]) + diagonal
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            columns, values = rows[i]
            gradient = signs[i] * (w[columns] @ values + w[-1]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[columns] += step * values
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Families with their one-versus-rest weights, languages with their pairwise weights."""

    def __init__(self, langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        self.families = sorted({family(x) for x in langs})
        self.members = {f: sorted({x for x in langs if family(x) == f}) for f in self.families}
        of = np.array([family(x) for x in langs])
        lang = np.array(langs, dtype=object)
        columns = []
        if len(self.families) > 1:
            columns += [linear_svm(rows, np.where(of == f, 1, -1)) for f in self.families]
        self.pairs = []
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1 :]:
                    at = np.flatnonzero((lang == a) | (lang == b))
                    self.pairs.append((a, b))
                    columns.append(linear_svm([rows[k] for k in at], np.where(lang[at] == a, 1, -1)))
        width = len(ORDERS) * (1 << BITS) + 1
        weights = np.stack(columns, axis=1) if columns else np.zeros((width, 0))
        self.weights, self.bias = weights[:-1].astype(np.float32), weights[-1]

    @classmethod
    def of(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.families:
            return out
        for a in range(0, len(texts), 64):
            found = [(i, x) for i in range(a, min(a + 64, len(texts))) if (x := features(texts[i])) is not None]
            if found:
                margins = np.stack([x for _, x in found]) @ self.weights + self.bias
                for (i, _), m in zip(found, margins.astype(np.float64), strict=True):
                    out[i] = self._decide(m)
        return out

    def _decide(self, m: np.ndarray) -> tuple[str, float]:
        n = len(self.families) if len(self.families) > 1 else 0
        score = 1.0
        best = 0
        if n:
            best = int(m[:n].argmax())
            score = float(1 / (1 + np.exp(-2 * m[best])))
        members = self.members[self.families[best]]
        if len(members) == 1:
            return members[0], score
        votes = {x: [0, 0.0] for x in members}
        for (a, b), margin in zip(self.pairs, m[n:], strict=True):
            if a in votes and b in votes:
                votes[a if margin > 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        lang = max(members, key=lambda x: (*votes[x], x))
        mean = votes[lang][1] / (len(members) - 1)
        return lang, float(score / (1 + np.exp(-2 * mean)))


def held_out(id_col: str) -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(
    docs: DataFrame, id_col: str, lang_col: str, text_col: str, per_language: int = SAMPLE_PER_LANGUAGE
) -> DataFrame:
    """lang and the sparse features of at most ``per_language`` labelled documents of each
    language, with one short piece of each. A hash threshold per language comes before the
    ranking, so that no task ranks more than about one and a half samples."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.where(~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")
    )
    share = usable.groupBy("lang").count().select(
        "lang", F.least(F.lit(1.0), (per_language * 1.5 + 20) / F.col("count")).alias("share")
    )
    picked = usable.join(small(share, "lang"), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    picked = picked.withColumn("rank", rank).where(F.col("rank") <= per_language)
    schema = StructType(
        [
            StructField("lang", StringType()),
            StructField("columns", ArrayType(IntegerType())),
            StructField("values", ArrayType(FloatType())),
        ]
    )

    def make():
        def rows(langs, texts, hashes):
            for lang, text, h in zip(langs, texts, hashes, strict=True):
                words = text.split()
                at = h % max(1, len(words) - PIECE_WORDS)
                for part in (text, " ".join(words[at : at + PIECE_WORDS])):
                    if (x := features(part)) is not None:
                        columns = np.flatnonzero(x)
                        yield lang, columns.tolist(), x[columns].tolist()

        return rows

    return map_slices(picked.select("lang", "text", "h"), schema, make)


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    sample = training_sample(docs, id_col, lang_col, text_col).collect()
    sample.sort(key=lambda r: (r.lang, r["columns"], r["values"]))
    return Model(
        [r.lang for r in sample], [(np.array(r["columns"]), np.array(r["values"], dtype=np.float64)) for r in sample]
    )


def identify(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    # The weights are bounded by the learned languages; a dict of them needs no class to unpickle.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or fit(docs, id_col, lang_col, text_col)))
    schema = StructType(
        [docs.schema[id_col], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )

    def make():
        predict = Model.of(shared.value).predict

        def rows(ids, texts):
            return [(d, *p) for d, p in zip(ids, predict(texts), strict=True)]

        return rows

    found = map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)
    return found.select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score")
