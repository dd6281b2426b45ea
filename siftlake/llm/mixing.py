"""Mixing sources to target weights by balanced sampling with the cube method.

Each document has an expected number of uses, the same for all documents of its source: whole
uses are taken as they are, the rest is an inclusion probability. The flight moves these
probabilities along the null space of the balancing equations (number of documents, number of
tokens) of three documents at a time until at most two fractional ones are left in a block;
the leftovers of the blocks fly again together. The last few of a source are landed.
"""

from __future__ import annotations

import hashlib
import math
import os
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.session import checkpoint

#: Folder of the public vocabularies; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"


def count_tokens(docs: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """`id`, the columns to keep, and n_tokens: the length of each whole text in tokens; 0 for null and empty texts."""
    path = os.path.join(folder, vocabulary)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).alias("__text"))
    schema = kept.drop("__text").schema.add("n_tokens", "long")

    def run(batches):
        encoding = _encoding(path)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in schema.names[:-1]] + [pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


_encodings: dict = {}


def _encoding(path: str):
    """The tokenizer of a rank file, kept for the life of the Python worker."""
    if path not in _encodings:
        import base64

        import tiktoken

        # Fixed value: the word pattern of this public vocabulary.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_key(source: Column) -> Column:
    """Source names in lower case, with one underscore for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def mixing_plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, docs, tokens, wanted, uses.

    `sized` has columns source and n_tokens. `wanted` is the source's tokens in the mix, `uses` the expected uses of each of its
    documents. Without `total`, the mix is as large as the shares allow: the source that is
    soonest used up at its max_repeats decides. Targets without tokens get none, and the other
    shares are scaled up in proportion. With a `total` that a source cannot reach, it is used
    max_repeats times and its rest goes to nobody.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    rows = [r.asDict() for r in wanted.join(have, "source", "left").orderBy("source").collect()]  # as many as targets
    live = [r for r in rows if (r["tokens"] or 0) > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    scale = sum(r["target_share"] for r in live)
    limit = min((r["max_repeats"] * r["tokens"] * scale / r["target_share"] for r in live), default=0)
    size = limit if total is None else total
    for r in rows:
        r["wanted"] = r["target_share"] / scale * size if r in live else 0.0
        r["uses"] = min(r["wanted"] / r["tokens"], float(r["max_repeats"])) if r in live else 0.0
        if math.isclose(r["uses"], round(r["uses"]), rel_tol=1e-12):
            r["uses"] = float(round(r["uses"]))
    schema = "source string, target_share double, max_repeats long, docs long, tokens long, wanted double, uses double"
    return sized.sparkSession.createDataFrame([tuple(r[c] for c in ("source", "target_share", "max_repeats", "docs", "tokens", "wanted", "uses")) for r in rows], schema)


def fly(ids: list[int], sizes: list[float], pi: list[float], seed: int) -> list[float]:
    """The flight of one block: probabilities after the last move; at most two are not 0 or 1.

    Keeps the sums of pi and of pi times size, and each expectation.
    """
    chance = random.Random(seed)
    pi = list(pi)
    scale = max([1.0, *sizes])
    live: list[int] = []
    for k in range(len(ids)):
        if not 0.0 < pi[k] < 1.0:
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        x, y, z = sizes[a] / scale, sizes[b] / scale, sizes[c] / scale
        u = (z - y, x - z, y - x)  # across (1, 1, 1) and the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / d if d > 0 else -pi[i] / d for i, d in zip(live, u) if d)
        down = min(pi[i] / d if d > 0 else (pi[i] - 1) / d for i, d in zip(live, u) if d)
        step = up if chance.random() * (up + down) < down else -down
        for i, d in zip(live, u):
            pi[i] = min(1.0, max(0.0, pi[i] + step * d))
            if pi[i] < 1e-9:
                pi[i] = 0.0
            elif pi[i] > 1 - 1e-9:
                pi[i] = 1.0
        live = [i for i in live if 0.0 < pi[i] < 1.0]
    return pi


def land(sizes: list[float], pi: list[float], seed: int) -> list[float]:
    """Settle the last fractional ones: the number of documents as it must be, the tokens as near as they can."""
    left = [k for k, p in enumerate(pi) if 0.0 < p < 1.0]
    if not left:
        return pi
    pi, want, tokens = list(pi), sum(pi[k] for k in left), sum(pi[k] * sizes[k] for k in left)
    number = round(want) if abs(want - round(want)) < 1e-6 else None
    best = min(
        (m for m in range(1 << len(left)) if number is None or bin(m).count("1") == number),
        key=lambda m: (abs(sum(sizes[k] for j, k in enumerate(left) if m >> j & 1) - tokens), m),
    )
    for j, k in enumerate(left):
        pi[k] = float(best >> j & 1)
    return pi


def balanced_mix(sized: DataFrame, plan: DataFrame, block: int = 20_000, seed: int = 7) -> DataFrame:
    """(id, source, n_tokens, repeats) for each document that is used at least once.

    `sized`: id, source (as source_key() writes it), n_tokens. No document is used more than
    max_repeats times. Rows without id or source are unused, as are sources without target.
    Repeated ids are documents of their own. The blocks of a source are by hash of the id, so
    a source of any size spreads over many tasks and the result depends on data and seed alone.
    """
    of = sized.where("id is not null").join(F.broadcast(plan.select("source", "uses", "docs")), "source")  # as many rows as targets
    whole = F.floor("uses")
    flown = of.select("id", "source", "n_tokens", whole.cast("long").alias("repeats"), (F.col("uses") - whole).alias("pi"), F.ceil(F.col("docs") / block).alias("blocks"))
    schema = "id long, source string, n_tokens long, repeats long, pi double, blocks long"

    def flight(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["id", "n_tokens"], kind="stable")
            own = int.from_bytes(hashlib.sha256(f"{seed}:{len(pdf)}:{pdf.id.iloc[0]}".encode()).digest()[:8], "big")
            order = list(range(len(pdf)))
            random.Random(own).shuffle(order)
            pdf = pdf.iloc[order]
            sizes = [float(n) for n in pdf.n_tokens]
            pi = fly(list(pdf.id), sizes, list(pdf.pi), own)
            return pdf.assign(pi=land(sizes, pi, own) if last else pi).drop(columns="b")

        return run

    done = flown.where("pi = 0")
    left = flown.where("pi > 0")
    most = plan.agg(F.max(F.ceil(F.col("docs") / block))).first()[0] or 1
    while True:
        number = F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.col("blocks"), F.lit(1)))
        last = most <= 1
        moved = checkpoint(left.withColumn("b", number).groupBy("source", "b").applyInPandas(flight(last), schema))
        done = done.unionByName(moved.where("pi = 0 or pi = 1"))
        if last:
            break
        # At most two of each block are left; they fly together in the next round.
        left = moved.where("pi > 0 and pi < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / block))
        most = math.ceil(most * 2 / block)
    used = done.select("id", "source", "n_tokens", (F.col("repeats") + F.col("pi").cast("long")).alias("repeats"))
    return used.where("repeats > 0")


def shares_reached(used: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per target: the share asked for, the share reached, and what was used for it."""
    got = used.groupBy("source").agg(
        F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats")
    )
    total = got.agg(F.sum("tokens_used").alias("all_tokens"))
    return plan.join(got, "source", "left").crossJoin(F.broadcast(total)).select(  # one row: an aggregate without keys
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.try_divide("tokens_used", "all_tokens"), F.lit(0.0)).alias("actual_share"),
    )


