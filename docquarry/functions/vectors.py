"""Vectors, similarities and scores."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_score(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


#: Characters of texts that are turned into vectors at once, and hashed features that a task keeps.
AT_ONCE, KEPT = 1 << 21, 1_000_000


class _Numbers(dict):
    """Numbers (from 1) of words as they are met; words of one folded case share theirs."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.folded: dict[str, int] = {}
        # a word's bytes, and what stands before a pair's second word
        self.spelled, self.first = [b""], [b""]

    def __missing__(self, word: str) -> int:
        w = word.casefold()
        n = self.folded.setdefault(w, len(self.spelled))
        if n == len(self.spelled):
            self.spelled.append(w.encode())
            self.first.append(f"{w}␟".encode())
        self[word] = n
        return n


def hashing_embedding(dimension: int = 256):
    """Hashed words and word pairs with signed logarithmic counts, of unit length; a text without words stays zero.

    A word and a pair are hashed once for a task, not for each text that has them; texts are counted many at a time.
    """
    if dimension < 32:
        raise ValueError("a dimension of at least 32 is needed")

    ids = _Numbers()
    places: dict[int, int] = {}

    def placed(features: list[int]) -> np.ndarray:
        """Twice each feature's place, and one more for a positive sign; a pair is its words' numbers (from 1) end to end."""
        new = [f for f in features if f not in places]
        spelled, first = ids.spelled, ids.first
        digests = b"".join([blake2b(first[f >> 31] + spelled[f & 0x7FFFFFFF], digest_size=16).digest() for f in new])
        at = (np.frombuffer(digests, ">u8")[::2] % dimension).astype(np.int64) * 2 + (np.frombuffer(digests, np.uint8)[8::16] & 1)
        places.update(zip(new, at.tolist()))
        return np.fromiter(map(places.__getitem__, features), np.int64, len(features))

    def vectors(texts: list[str | None]) -> np.ndarray:
        if len(places) > KEPT or len(ids) > KEPT:
            ids.forget()
            places.clear()
        words, sizes = [], []
        for t in texts:
            found = X.PYTHON_TOKEN.findall(t or "")
            sizes.append(len(found))
            words += found
        codes = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        rows = np.repeat(np.arange(len(texts)), sizes)
        near = rows[1:] == rows[:-1]
        at, weights = [], []
        for keys, of_row in ((codes, rows), (codes[:-1][near] << 31 | codes[1:][near], rows[1:][near])):
            features, which = np.unique(keys, return_inverse=True)
            # in the order in which a text first has them, as sums of doubles depend on it
            each, first, counts = np.unique(of_row * max(1, len(features)) + which, return_index=True, return_counts=True)
            order = np.argsort(first)
            told = placed(features.tolist())[which[first[order]]]
            at.append(of_row[first[order]] * dimension + told // 2)
            weights.append(np.log1p(counts[order]) * (told % 2 * 2.0 - 1.0))
        out = np.bincount(np.concatenate(at), np.concatenate(weights), len(texts) * dimension).reshape(-1, dimension)
        norms = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1.0, norms)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(column: pa.Array) -> pa.Array:
        texts, made, a = column.to_pylist(), [np.zeros((0, dimension))], 0
        sizes = np.cumsum([len(t or "") for t in texts])
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + AT_ONCE, "right")))
            made.append(vectors(texts[a:b]))
            a = b
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made).ravel()), mask=column.is_null())

    return lambda x: embed(F.make_valid_utf8(x))


def overlap(query_tokens: Column | str, text_tokens: Column | str) -> Column:
    """Share of the query's distinct tokens that the text has; 0 without any."""
    q = F.array_distinct(_c(query_tokens))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, _c(text_tokens))) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token lists as sets; two empty ones count as equal."""
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / both)


def hybrid_score(query: Column | str, text: Column | str, dense: Column | str, bm25: Column | str, query_tokens: Column | str | None = None, text_tokens: Column | str | None = None) -> Column:
    """Weighted sum of the dense, sparse and lexical scores; tokens can be given if they are at hand."""
    q, t = _c(query), _c(text)
    qt = X.search_tokens(q) if query_tokens is None else query_tokens
    tt = X.search_tokens(t) if text_tokens is None else text_tokens
    phrase = F.when(F.contains(F.lower(t), F.trim(F.lower(q))), F.lit(1.0)).otherwise(F.lit(0.0))
    lexical = F.least(F.lit(1.0), overlap(qt, tt) * 0.85 + phrase * 0.15)
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_c(dense), F.lit(0.0))))
    s = 1.0 - F.exp(-F.greatest(F.lit(0.0), F.coalesce(_c(bm25), F.lit(0.0))) / 3.0)
    return F.least(F.lit(1.0), d * 0.45 + s * 0.25 + lexical * 0.30)


def judged(query: Column | str, text: Column | str, relevance: Column | str) -> Column:
    q = X.search_tokens(query)
    score = F.least(F.lit(1.0), _c(relevance) * 0.7 + overlap(q, X.search_tokens(text)) * 0.3)
    return F.when(F.size(q) == 0, _c(relevance)).otherwise(score)


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def entailment(statement: Column | str, evidence: Column | str) -> Column:
    """Of a statement and an array of evidence texts: supported, contradicted or insufficient.

    Containment supports it whatever else there is; else a good overlap with a
    different negation contradicts it; else a better overlap supports it.
    """
    st = X.entailment_tokens(statement)
    negations = F.array(*(F.lit(n) for n in X.NEGATIONS))
    plain = X.collapse(F.lower(_c(statement)))
    judged_ = F.transform(
        _c(evidence),
        lambda e: F.struct(
            (F.size(F.array_intersect(st, X.entailment_tokens(e))) / F.size(st)).alias("o"),
            (F.arrays_overlap(st, negations) != F.arrays_overlap(X.entailment_tokens(e), negations)).alias("n"),
            (F.contains(X.collapse(F.lower(e)), plain) & (F.size(X.entailment_tokens(e)) > 0)).alias("c"),
            (F.size(X.entailment_tokens(e)) > 0).alias("k"),
        ),
    )
    return (
        F.when((F.size(st) == 0) | (F.coalesce(F.size(_c(evidence)), F.lit(0)) <= 0), "insufficient")
        .when(F.exists(judged_, lambda j: j["c"]), "supported")
        .when(F.exists(judged_, lambda j: j["k"] & (j["o"] >= 0.6) & j["n"]), "contradicted")
        .when(F.exists(judged_, lambda j: j["k"] & (j["o"] >= 0.7)), "supported")
        .otherwise("insufficient")
    )
