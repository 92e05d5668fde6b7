"""Sources mixed to target shares of all tokens (problem 9).

Sizes are tokens of a public byte-pair vocabulary. A source's mean repetition follows from its share of a common total; the
total is the largest that every source present can supply within its cap. Each document's count is drawn by inverting a
Poisson distribution, cut at the cap and with exactly that mean, at a uniform number hashed from the document and a seed: so
the draw needs no shuffle, is the same on every run and after the loss of an executor, and a hot source costs nothing.
Documents are exploded by their counts and ordered by a hash, which is the global shuffle.

Defined results: a null source, and one without a target, supplies nothing; a target without documents gets an actual share
of nil, and the others keep their proportions; null and empty texts have no tokens and are not chosen; a repeated document
counts once; caps below one exclude a source.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import Memo, cut, need

#: Folder of the public vocabularies, and the one in use.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into pieces before the merges.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources in a mix; each is a line of the target table.
SOURCE_BOUND = 10_000


@Memo
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("bpe", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


def count_tokens(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), each document once. The vocabulary (under 1 MB) is sent to the executors."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "n_tokens": [len(encode(t)) for t in b.text]})

    docs = need(documents, "doc_id", "source", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return docs.mapInPandas(run, "doc_id long, source string, n_tokens long").dropDuplicates(["doc_id"])


def _capped_mean(rate: float, cap: int) -> float:
    p = below = math.exp(-rate)
    mean = cap - cap * below
    for k in range(1, cap):
        p *= rate / k
        mean -= (cap - k) * p
    return mean


def poisson_steps(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0, 1 .. cap - 1 of the Poisson distribution cut at ``cap`` with this mean.

    A uniform number u then means as many copies as there are steps below it.
    """
    if cap < 1 or mean <= 0:
        return []
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap
    lo, hi = 0.0, 1.0
    while _capped_mean(hi, cap) < mean and hi < 600:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _capped_mean(mid, cap) < mean else (lo, mid)
    p, total, out = math.exp(-hi), 0.0, []
    for k in range(cap):
        total += p
        out.append(total)
        p *= hi / (k + 1)
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, list[float]]]:
    """source -> (mean repetition, steps) for the largest total that keeps all caps."""
    open_ = [(s, w, c) for s, w, c in targets if sizes.get(s, 0) > 0 and w and w > 0 and c and c >= 1]
    if not open_:
        return {}
    total = min(c * sizes[s] / w for s, w, c in open_)
    return {s: (w * total / sizes[s], poisson_steps(w * total / sizes[s], c)) for s, w, c in open_}


def draw(tokens: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``tokens`` (doc_id, source, n_tokens) with ``repeats`` >= 1 of the documents chosen."""
    rows = [(r.source, r.target_share, r.max_repeats) for r in need(targets, "source", "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"]).limit(SOURCE_BOUND + 1).collect()]
    if len(rows) > SOURCE_BOUND:
        raise ValueError(f"more than {SOURCE_BOUND} sources in the target table")
    named = tokens.where(F.col("source").isin([s for s, *_ in rows])) if rows else tokens.where("false")
    sizes = {r.source: r.n for r in named.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    steps = [(s, st) for s, (_, st) in plan(sizes, rows).items()]
    table = tokens.sparkSession.createDataFrame(pd.DataFrame(steps or [("", [])], columns=["source", "steps"]), "source string, steps array<double>")
    # 53 bits of a seeded hash as a uniform number
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = named.where("n_tokens > 0").join(F.broadcast(table), "source").withColumn("repeats", F.size(F.filter("steps", lambda s: s <= u)).cast("long"))
    return drawn.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def mixed_documents(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens) of all chosen copies, in shuffled order."""
    tokens = cut(count_tokens(documents))
    copies = draw(tokens, targets, seed).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy_no"), "source", "n_tokens")
    return copies.orderBy(F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))


def share_report(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, chosen_docs, most_repeats, mixed_tokens, actual_share)."""
    tokens = cut(count_tokens(documents))
    have = tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    got = cut(draw(tokens, targets, seed).groupBy("source").agg(F.count("*").alias("chosen_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("mixed_tokens")))
    total = got.agg(F.sum("mixed_tokens")).first()[0]
    t = need(targets, "source", "target_share", "max_repeats").dropDuplicates(["source"])
    out = t.join(have, "source", "left").join(got, "source", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_docs", "n_tokens", "chosen_docs", "most_repeats", "mixed_tokens")}
    return out.withColumns(zero).withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.lit(total).cast("double")), F.lit(0.0)))
