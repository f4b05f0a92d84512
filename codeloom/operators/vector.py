"""Vector retrieval: hash embeddings, cosine, exact top-k over a project's chunks, the text form of vectors."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import text as tx


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is null, empty, of another length or all zero, or holds null or NaN."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) == F.size(b)) & (norms > 0), F.try_divide(dot(a, b), norms))
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def hash_buckets(documents: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, value): the non-zero parts of a text's hash embedding before normalising; partial sums per document."""
    each = documents.select(key, F.explode(tx.embed_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    signed = each.select(key, tx.bucket_and_sign(F.col("token"), dim).alias("b"), "n")
    return signed.groupBy(key, F.col("b.bucket").alias("bucket")).agg(F.sum(F.col("b.sign") * F.col("n")).alias("value")).where("value <> 0")


_RUN, _IS_CJK = re.compile(rf"[{tx.CJK}]+|(?:(?![{tx.CJK}])[\w\-./:])+"), re.compile(f"[{tx.CJK}]")


@lru_cache(maxsize=65_536)
def _hashed(token: str, dim: int) -> tuple[int, float]:
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % dim, 1.0 if digest[4] % 2 == 0 else -1.0


def embed_query(text: str, dim: int) -> dict[int, float]:
    """The hash embedding of one text as bucket and weight."""
    sums: dict[int, float] = {}
    for run in _RUN.findall(text.lower()):
        for part in [*run, *[run[i : i + 2] for i in range(len(run) - 1)]] if _IS_CJK.match(run) else [run]:
            bucket, sign = _hashed(part, dim)
            sums[bucket] = sums.get(bucket, 0.0) + sign
    norm = sum(v * v for v in sums.values()) ** 0.5
    return {b: v / norm for b, v in sums.items() if v} if norm else {}


def hash_topk(documents: DataFrame, key: str, text: str, question: str, k: int, dim: int = 1024) -> DataFrame:
    """(key, score) of the k texts most similar to a question by hash embedding; ties by key. Blank questions are an error.

    Texts without a token have no row. Each text is embedded where it lies, in Arrow batches; only keys and scores are sorted.
    """
    if not question.strip():
        raise ValueError("the question is empty")
    weights = embed_query(question, dim)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for one in texts:
            own = embed_query(one, dim) if one else {}
            out.append(sum(w * weights.get(b, 0.0) for b, w in own.items()) if own else None)
        return pd.Series(out, dtype="float64")

    scored = documents.select(key, score(F.col(text)).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to a query vector by cosine distance, ties by key; k is kept within 1 and 100.

    Only the key and the score go through the sort (TakeOrderedAndProject); other columns are for the caller to join.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(cosine(F.col(vector), literal), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(max(1, min(k, 100)))


def chunk_types(asked: list[str] | None) -> list[str]:
    """The chunk types a filter names: each with one artifact_ prefix unless it has it, once each; empty means any."""
    named = [t.strip() for t in asked or [] if t and t.strip()]
    return list(dict.fromkeys(t if t.startswith("artifact_") or t.startswith("project_") else f"artifact_{t}" for t in named))


def to_text(vector: Column) -> Column:
    """A vector as ``[0.12345678,...]`` with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("float"))
