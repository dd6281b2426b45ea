"""Long spans that stand verbatim in more than one text, by difference-cover anchors.

A cover D modulo a period v holds, for any two starts i and j, a shift below v that brings
both to positions in D. Windows of min_chars - v + 1 characters are hashed at positions in D
alone; two texts that share min_chars characters therefore share a hashed window inside the
shared span. Candidates are narrowed by nearly full windows around shared anchors, and each
pair is then compared window by window and exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import hashing
from siftlake.llm.joins import small_side
from siftlake.session import checkpoint


#: A key that more texts have is looked at in full windows.
HOT = 8


@lru_cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Period q*q + q + 1 and a cover of q + 1 residues, for a prime q: a Singer difference set.

    Every residue is the difference of two members. Built in the cubic extension of the field
    of q elements: the powers of a generator that lie in a plane.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # x^3 = a x^2 + b x + c; follow the powers of x as points of the projective plane.
                p, seen, members = (0, 1, 0), set(), []
                for e in range(1, v + 1):
                    lead = next((t for t in p if t), 0)
                    inv = pow(lead, -1, q)
                    key = tuple(t * inv % q for t in p)
                    if key in seen:
                        break
                    seen.add(key)
                    if p[2] == 0:
                        members.append(e % v)
                    c0, c1, c2 = p
                    p = (c2 * c % q, (c0 + c2 * b) % q, (c1 + c2 * a) % q)
                if len(seen) == v and len({(i - j) % v for i in members for j in members}) == v:
                    return v, tuple(sorted(members))
    raise ValueError(f"no cover for {q}")


def period_for(min_chars: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least a fifth of min_chars; every position below 8."""
    for q in (31, 23, 19, 17, 13, 11, 7, 5, 3, 2):
        if min_chars - (q * q + q + 1) + 1 >= max(2, min_chars // 5):
            return difference_cover(q)
    return 1, (0,)


def _anchors(texts: list[str], v: int, cover: tuple[int, ...], width: int):
    """(text number, position, hash) of the anchors of the texts."""
    values, at = hashing.codes(texts)
    sums = hashing.prefix(values)
    docs, starts = [], []
    residues = np.array(cover, np.int64)
    for k in range(len(texts)):
        last = int(at[k + 1] - at[k]) - width
        if last >= 0:
            pos = (np.arange(0, last + 1, v)[:, None] + residues).ravel()
            pos = pos[pos <= last]
            docs.append(np.full(len(pos), k))
            starts.append(pos)
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none, none
    doc, pos = np.concatenate(docs), np.concatenate(starts)
    begin = at[doc] + pos
    return doc, pos, hashing.span(sums, begin, begin + width).view(np.int64)


def _anchor_table(docs: DataFrame, v: int, cover: tuple[int, ...], width: int, positions: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for ids, texts in hashing.chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, pos, h = _anchors(texts, v, cover, width)
                if len(doc):
                    cols = [pa.array(np.array(ids)[doc], pa.int64()), pa.array(pos, pa.int32()), pa.array(h, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "pos", "h"]).select(["id", "pos", "h"] if positions else ["id", "h"])

    return docs.select("id", "text").mapInArrow(run, "id long, pos int, h long" if positions else "id long, h long")


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id): documents with equal texts share the smallest id among them. Null texts and ids have no class.

    Only ids and hashes are shuffled, pre-aggregated, so that a text with many copies is no hot group.
    """
    keyed = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.sha2(text, 256).alias("t")).distinct()
    return keyed.join(keyed.groupBy("t").agg(F.min("id").alias("class_id")), "t").select("id", "class_id")


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes). pairs: (a, b, spans), a < b, for all pairs of different texts, each by its
    class id, that share a verbatim span of at least `min_chars` characters; spans has an entry
    (start_a, start_b, n_chars) for maximal spans that cover all that either text shares with the other.
    classes: (id, class_id) of text_classes(), over which copies are expanded where needed.

    Characters are code points. Null and shorter texts share nothing; an empty table gives
    empty results; rows with the same id must be the same text. Hot anchors cost pre-aggregated
    rows; pairs come out only for texts that share a window of nearly min_chars.
    """
    v, cover = period_for(min_chars)
    width = min_chars - v + 1
    classes = checkpoint(text_classes(docs, doc_id, text))
    copies = classes.where("id <> class_id").select("id")
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") >= min_chars)
    once = plain.join(small_side(copies), "id", "left_anti")
    # Anchors in more than one text. Only (id, hash) is shuffled, with partial aggregation.
    several = (
        _anchor_table(once, v, cover, width, positions=False).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    )
    marked = _anchor_table(once, v, cover, width, positions=True).join(small_side(several), "h")
    places = marked.groupBy("id").agg(F.collect_set("pos").alias("at"))  # of one text: bounded by its length
    likely = checkpoint(plain.join(small_side(places), "id").dropDuplicates(["id"]))

    # A span with an anchor has l characters before and at least min_chars - width - l after it. For one
    # of a few cuts of l, the window between neighbouring cuts is shared whole: min_chars less one step.
    rest = min_chars - width
    cuts = np.linspace(0, rest, 7).astype(int)

    def narrow(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, _ = hashing.codes([row["text"]])
                sums, at = hashing.prefix(values), np.array(row["at"], np.int64)
                found, where = [], []
                for low, high in zip(cuts, cuts[1:]):
                    begin, end = at - low, at + width + rest - high
                    ok = (begin >= 0) & (end <= len(values))
                    found.append(hashing.span(sums, begin[ok], end[ok]))
                    where.append(begin[ok] * (1 << 20) + (end[ok] - begin[ok]))
                keys, first = np.unique(np.concatenate(found), return_index=True)
                if len(keys):
                    begin, size = np.divmod(np.concatenate(where)[first], 1 << 20)
                    columns = [np.full(len(keys), row["id"]), keys.view(np.int64), begin, size]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "k", "begin", "size"])

    keys = checkpoint(likely.mapInArrow(narrow, "id long, k long, begin long, size long"))
    # A key of many texts may be a passage just short of min_chars, none of whose pairs would hold. It gives way to
    # the hashes of the full windows around it, so that only texts that share min_chars characters meet.
    hot = small_side(keys.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("k"))
    around = keys.join(hot, "k").groupBy("id").agg(F.collect_set(F.struct("begin", "size")).alias("around"))  # of one text: bounded by its length

    def widen(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, _ = hashing.codes([row["text"]])
                sums = hashing.prefix(values)
                starts = np.unique(np.concatenate([np.arange(max(0, x["begin"] + x["size"] - min_chars), min(x["begin"], len(values) - min_chars) + 1) for x in row["around"]]))
                if len(starts):
                    full = np.unique(hashing.span(sums, starts, starts + min_chars)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), row["id"]), pa.int64()), pa.array(full, pa.int64())], ["id", "k"])

    wide = likely.select("id", "text").join(small_side(around), "id").mapInArrow(widen, "id long, k long")
    keys = checkpoint(keys.join(hot, "k", "left_anti").select("id", "k").unionByName(wide))
    # A passage that many texts share has a key at each of its windows, all with the same texts: one key
    # for each set of texts is enough, else its pairs would come once a window. Sets are told apart by
    # size, least and greatest id and 128 bits of hash.
    sets = keys.groupBy("k").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    ).where("n > 1")
    keys = keys.join(sets.groupBy("n", "lo", "hi", "x", "y").agg(F.min("k").alias("k")).select("k"), "k")
    left, right = keys.select("k", F.col("id").alias("a")), keys.select("k", F.col("id").alias("b"))
    candidates = left.join(right, "k").where("a < b").select("a", "b").distinct()
    texts = likely.select("id", "text")
    both = candidates.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("start_a", "start_b", "n_chars")])))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans = common_spans(row["ta"], row["tb"], min_chars)
                if spans:
                    back = common_spans(row["tb"], row["ta"], min_chars)
                    found = {(i, j, n) for i, j, n in spans} | {(i, j, n) for j, i, n in back}
                    out.append({"a": row["a"], "b": row["b"], "spans": [{"start_a": i, "start_b": j, "n_chars": n} for i, j, n in sorted(found)]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    pairs = both.mapInArrow(compare, "a long, b long, spans array<struct<start_a:long,start_b:long,n_chars:long>>")
    return pairs, classes


def common_spans(a: str, b: str, min_chars: int) -> list[tuple[int, int, int]]:
    """Maximal spans (start in a, start in b, length) that cover every window of a that stands in b."""
    if min(len(a), len(b)) < min_chars:
        return []
    ha, hb = (hashing.span(hashing.prefix(hashing.codes([t])[0]), np.arange(len(t) - min_chars + 1), np.arange(min_chars, len(t) + 1)) for t in (a, b))
    order = np.argsort(hb, kind="stable")
    at = np.searchsorted(hb[order], ha)
    hit = (at < len(hb)) & (hb[order][np.minimum(at, len(hb) - 1)] == ha)
    out, i = [], 0
    for i0 in np.flatnonzero(hit):
        if i0 < i:
            continue
        j0 = int(order[at[i0]])
        n = min_chars
        if a[i0 : i0 + n] != b[j0 : j0 + n]:
            continue  # hashes alike by chance
        while i0 + n < len(a) and j0 + n < len(b) and a[i0 + n] == b[j0 + n]:
            n += 1
        out.append((int(i0), j0, n))
        i = i0 + n - min_chars + 1
    return out


def pairs_of_documents(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs of classes expanded to their members, and the pairs of copies.

    The only place where copies become pairs, for results that are stated by document.
    """
    member = classes.select(F.col("class_id").alias("c"), F.col("id").alias("m"))
    across = pairs.select("a", "b").join(member.select(F.col("c").alias("a"), F.col("m").alias("ma")), "a").join(member.select(F.col("c").alias("b"), F.col("m").alias("mb")), "b")
    across = across.select(F.least("ma", "mb").alias("doc_a"), F.greatest("ma", "mb").alias("doc_b"))
    long = docs.where(F.length(text) >= min_chars).select(F.col(doc_id).cast("long").alias("id"))
    several = classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    own = classes.join(several, "class_id").join(long, "id", "left_semi")
    same = own.select("class_id", F.col("id").alias("doc_a")).join(own.select("class_id", F.col("id").alias("doc_b")), "class_id").where("doc_a < doc_b")
    return across.unionByName(same.select("doc_a", "doc_b")).distinct()


def shared_part(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, class_id, n_copies, n_chars, n_partners, shared_chars): how much of each document stands elsewhere.

    n_partners counts classes of other texts, shared_chars the characters within spans shared with any of
    them; a document with copies is shared whole. Spans are merged as ordered intervals per text.
    """
    ends = lambda c, s: pairs.select(F.col(c).alias("id"), F.inline(F.transform("spans", lambda x: F.struct(x[s].alias("lo"), (x[s] + x["n_chars"]).alias("hi")))))
    # The distinct intervals first: many partners share the same passage.
    spans = ends("a", "start_a").union(ends("b", "start_b")).distinct()
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["hi"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(acc["end"], x["lo"]))).alias("n")),
    )["n"]
    covered = spans.groupBy("id").agg(merged.alias("shared"))
    partners = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_partners"))
    copies = classes.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    sized = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.length(text).cast("long").alias("n_chars")).dropDuplicates(["id"])
    by_class = copies.join(partners.withColumnRenamed("id", "class_id"), "class_id", "left").join(covered.withColumnRenamed("id", "class_id"), "class_id", "left")
    return classes.join(by_class, "class_id").join(sized, "id").select(
        "id", "class_id", "n_copies", "n_chars", F.coalesce("n_partners", F.lit(0)).alias("n_partners"),
        F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"),
    )
