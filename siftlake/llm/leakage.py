"""Evaluation passages in a corpus: winnowed word fingerprints, joined and extended.

Words are maximal runs of ASCII letters and digits, letter case ignored. Each text keeps the
least hash of `k` words in every window of min_words - k + 1 such hashes, so that two texts
that share `min_words` consecutive words share a kept hash. Hits are extended word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import hashing
from siftlake.llm.joins import small_side

# Byte to lower case for ASCII letters and digits, 0 for all that stands between words.
_LOWER = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_c] = _c + 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the number of the text it stands in."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in raw], out=at[1:])
    letters = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = (letters != 0).astype(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = hashing.span(hashing.prefix(letters), start, end)
    return hashes, np.searchsorted(at, start, side="right") - 1


def winnow(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, hash) of the kept fingerprints of each text."""
    words, doc = word_hashes(texts)
    n = len(words) - k + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = np.arange(n)
    grams = hashing.span(hashing.prefix(words), starts, starts + k)
    grams[doc[:n] != doc[k - 1 :]] = np.uint64(0xFFFFFFFFFFFFFFFF)  # runs into the next text
    m = n - window + 1
    # The rightmost least hash of each window that lies within one text, as classic winnowing keeps.
    best, where = grams[window - 1 :].copy(), np.arange(window - 1, n)
    for back in range(1, window):
        other = grams[window - 1 - back : n - back]
        less = other < best
        best[less] = other[less]
        where[less] = np.arange(window - 1 - back, n - back)[less]
    whole = doc[:m] == doc[window + k - 2 :]
    kept = np.unique(where[whole])
    first = np.searchsorted(doc, doc[kept], side="left")
    return doc[kept], kept - first, grams[kept].view(np.int64)


def fingerprints(texts: DataFrame, id_col: str, text_col: str, k: int, window: int) -> DataFrame:
    """(id, pos, h) of all texts; whole texts, nulls and texts of fewer than k + window - 1 words give none."""

    def run(batches):
        for batch in batches:
            for ids, some in hashing.chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, pos, h = winnow(some, k, window)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[doc], pa.int64()), pa.array(pos, pa.int64()), pa.array(h, pa.int64())], ["id", "pos", "h"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, pos long, h long")


def leaks(
    corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = 15, k: int = 8,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the longest shared run of each leaking pair.

    A row for each corpus text and item that share at least `min_words` consecutive words, with
    the first longest run. Nulls, empty texts and texts that are too short leak nothing;
    repeated rows with one id count once; an empty side gives no rows. Other columns are
    ignored.
    """
    if not 1 <= k <= min_words:
        raise ValueError("k must lie between 1 and min_words")
    window = min_words - k + 1
    tests = fingerprints(items, item_id, item_text, k, window).select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "h")
    found = fingerprints(corpus, doc_id, doc_text, k, window)
    hits = found.join(small_side(tests), "h")
    # One row per alignment: all hits on one diagonal lie in few runs, each of which is extended once. An item's text goes
    # along once for a document that it hits, not once for each alignment.
    lines = hits.groupBy(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.sort_array(F.collect_set("item_pos")).alias("at"))
    texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).dropDuplicates(["item_id"])
    pairs = lines.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("shift", "at")).alias("lines"))
    per_doc = pairs.join(small_side(texts), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "lines")).alias("hits"))
    docs = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("doc_text"))
    joined = docs.join(small_side(per_doc), "doc_id")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = word_hashes([row["doc_text"]])[0]
                best: dict[int, tuple] = {}
                for hit in row["hits"]:
                    theirs = word_hashes([hit["item_text"]])[0]
                    for line in sorted(hit["lines"], key=lambda x: x["shift"]):
                        for a, b in _runs(mine, theirs, line["shift"], line["at"]):
                            if b - a >= min_words and (b - a, -a) > best.get(hit["item_id"], (0, 0))[:2]:
                                best[hit["item_id"]] = (b - a, -a, line["shift"])
                out += [{"doc_id": row["doc_id"], "item_id": i, "doc_word": -a + s, "item_word": -a, "n_words": n} for i, (n, a, s) in best.items()]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "doc_word", "item_word", "n_words")]))

    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long"
    return joined.mapInArrow(run, schema).groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("doc_word", "item_word", "n_words"), F.struct("n_words", -F.col("item_word"), -F.col("doc_word"))).alias("x")
    ).select("doc_id", "item_id", "x.*")


def _runs(mine: np.ndarray, theirs: np.ndarray, shift: int, at: list[int]):
    """Maximal runs [a, b) of item words that equal the document's on the diagonal, around the hits."""
    lo, hi = max(0, -shift), min(len(theirs), len(mine) - shift)
    if hi <= lo:
        return
    same = np.concatenate([[0], (mine[lo + shift : hi + shift] == theirs[lo:hi]).astype(np.int8), [0]])
    edge = np.diff(same)
    for a, b in zip(np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo):
        if any(a <= p < b for p in at):
            yield int(a), int(b)
