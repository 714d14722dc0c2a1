"""Evaluation passages inside a training corpus (problem 8).

The corpus is tokenised once, into a stored index: a posting (term, doc_id, pos) for
every run of three words of every text, and each text's words in their order. The
index is split by documents, so no term's list lies in one place, and inverted in
blocks: postings are written in the order of their terms.

All test items are looked up at once. Of each stretch of a passage that would count as
a leak, the terms that are rarest in the corpus select documents; the offset-adjusted
lists of all selecting terms are intersected, and where enough of them agree the
stored words at these positions are aligned into exact or garbled stretches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import fits_broadcast, skew_join, stage
from .words import WordIds, shingle_ids, words

TERM = 3  # words a term
MIN_WORDS = 15  # a leak has at least so many words ...
MIN_SHARE = 1 / 3  # ... and this share of the passage
RAREST = 6  # terms that select, of each window of MIN_WORDS words
HITS = 3  # selecting terms that a document must share, on about one offset, to be aligned
OFFSETS = 128  # width of an offset bucket; half of it holds the foreign words that may stand inside a stretch
DENSITY = 0.95  # share of a stretch's words that must agree; stock sentences with one word exchanged stay below it
SKIP_ITEM = 3  # words of the passage that may be missing between two aligned runs
SKIP_DOC = 60  # foreign words that may stand between two aligned runs
BLOCK = 500_000  # postings that a task inverts at a time
PASSAGES = 10_000  # passages that a task keeps ready


def _near(a: str, b: str) -> bool:
    """Equal, or one letter changed, missing, added or swapped with its neighbour (in words of four letters or more, numbers must be equal)."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) > len(b):
        a, b = b, a
    return a[i:] == b[i + 1 :]


def aligned_stretch(doc: list[str], item: list[str], places: dict[tuple, list[int]] | None = None) -> tuple[int, int]:
    """(words, agreeing words) of the best aligned stretch of item in doc; (0, 0) if they share no term.

    places: the positions of each term in item (made here if not given). Runs on
    one offset are extended over garbled words, then chained in order, over at most
    SKIP_ITEM missing words and SKIP_DOC foreign words.
    """
    if places is None:
        places = term_places(item)
    offsets: dict[int, list[int]] = defaultdict(list)
    for p in range(len(doc) - TERM + 1):
        for q in places.get(tuple(doc[p : p + TERM]), ()):
            offsets[p - q].append(q)
    runs = []
    for off, qs in offsets.items():
        done = -1
        for q in qs:  # ascending, since p ascends
            if q < done:
                continue
            a, b = q, q + TERM
            while b < len(item) and b + off < len(doc) and _near(item[b], doc[b + off]):
                b += 1
            while a > max(done, 0) and a - 1 + off >= 0 and _near(item[a - 1], doc[a - 1 + off]):
                a -= 1
            runs.append((a, b, a + off, b + off))
            done = b
    runs.sort(key=lambda r: (r[2], r[0]))
    best: list[tuple[float, int, int]] = []  # score, start, agreeing
    recent: list[int] = []  # runs that end near enough to be continued
    top = (0.0, 0, 0)
    for j, (a, b, p0, _) in enumerate(runs):
        recent = [i for i in recent if runs[i][3] >= p0 - SKIP_DOC]
        cur = (float(b - a), a, b - a)
        for i in recent:
            ia, ib, _, ip1 = runs[i]
            over = max(0, ib - a)
            if ia >= a or b <= ib or over > 8 or p0 - ip1 < -over or a - ib > SKIP_ITEM:
                continue
            score, start, agree = best[i]
            gain = score + (b - max(a, ib)) - 2 * max(0, a - ib)
            if gain > cur[0]:
                cur = (gain, start, agree + b - max(a, ib))
        best.append(cur)
        recent.append(j)
        if cur[0] > top[0]:
            top = (cur[0], b - cur[1], cur[2])
    return top[1], top[2]


def term_places(item: list[str]) -> dict[tuple, list[int]]:
    places: dict[tuple, list[int]] = defaultdict(list)
    for q in range(len(item) - TERM + 1):
        places[tuple(item[q : q + TERM])].append(q)
    return places


def is_leak(doc: list[str], item: list[str], places: dict | None = None) -> bool:
    """Does doc carry item, or a connected stretch of MIN_SHARE of it and MIN_WORDS words (one word less is let pass: ends may be garbled)?"""
    need = max(MIN_WORDS, -(-len(item) // 3) if MIN_SHARE == 1 / 3 else int(np.ceil(len(item) * MIN_SHARE)))
    need = min(need - 1, len(item))
    span, agree = aligned_stretch(doc, item, places)
    return span >= max(need, TERM) and agree >= DENSITY * span


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all whole texts: rows (term, doc_id, pos) for every position, and one (doc_id, words) a text.

    words: the text's words with a space between. Null ids and texts are left out; a
    text of fewer than TERM words has no postings. One pass, written to the shared folder.
    """

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        ids = WordIds()

        def block(terms: list, at: list, kept: list[tuple[int, str]]):
            t = np.concatenate([np.empty(0, np.uint64), *terms]).view(np.int64)
            k = np.repeat(np.array([d for d, _ in at], np.int64), [n for _, n in at]) if at else np.empty(0, np.int64)
            p = np.concatenate([np.empty(0, np.int32), *[np.arange(n, dtype=np.int32) for _, n in at]])
            order = np.argsort(t, kind="stable")
            m, n = len(t), len(kept)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(t[order]), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([pa.array(k[order]), pa.array([d for d, _ in kept], pa.int64())]),
                    pa.concat_arrays([pa.array(p[order]), pa.nulls(n, pa.int32())]),
                    pa.concat_arrays([pa.nulls(m, pa.string()), pa.array([w for _, w in kept], pa.string())]),
                ],
                names=["term", "doc_id", "pos", "words"],
            )

        terms, at, kept, size = [], [], [], 0
        for b in frames:
            ks, ts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ks), 256):
                for k, t in zip(ks[lo : lo + 256], ts.slice(lo, 256).to_pylist()):
                    ws = words(t)
                    s = shingle_ids(ids(ws), TERM)
                    terms.append(s)
                    at.append((k, len(s)))
                    kept.append((k, " ".join(ws)))
                    size += len(s)
                    if size > BLOCK:
                        yield block(terms, at, kept)
                        terms, at, kept, size = [], [], [], 0
        yield block(terms, at, kept)

    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return stage(src.mapInArrow(run, "term bigint, doc_id bigint, pos int, words string"), "index")


def item_terms(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(part, item_id, words, place, term): every term of every passage; part stands for one passage of one item."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        ids = WordIds()
        for b in frames:
            out = ([], [], [], [], [])
            for part, i, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(t)
                for q, term in enumerate(shingle_ids(ids(ws), TERM).view(np.int64).tolist()):
                    for lst, v in zip(out, (part, i, " ".join(ws), q, term)):
                        lst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["part", "item_id", "words", "place", "term"])

    src = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(passage).alias("passage")).dropna().distinct()
    return src.select(F.xxhash64("item_id", "passage").alias("part"), "item_id", "passage").mapInArrow(run, "part bigint, item_id bigint, words string, place int, term bigint")


def selecting_terms(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, place, term, least) of the RAREST terms of each window of MIN_WORDS words that occur in the corpus at all; least: hits that a document needs."""
    per = terms.join(counts, "term").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("place", "term", "n"))).alias("there"))
    per = per.join(terms.groupBy("part").agg(F.count("*").alias("all")), "part").select("part", "there", "all")

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        width = max(1, MIN_WORDS - TERM + 1)
        for b in frames:
            out = ([], [], [], [])
            for part, there, every in zip(*(c.to_pylist() for c in b.columns)):
                at = {x["place"]: (x["n"], x["place"], x["term"]) for x in there}
                chosen = set()
                for lo in range(max(1, every - width + 1)):
                    chosen.update(sorted(at[q] for q in range(lo, min(lo + width, every)) if q in at)[:RAREST])
                for _, q, term in chosen:
                    for lst, v in zip(out, (part, q, term, min(HITS, every))):
                        lst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["part", "place", "term", "least"])

    return per.mapInArrow(run, "part bigint, place int, term bigint, least int")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): every document that carries an item's passage, wholly or in good part.

    The corpus is tokenised once, however many items there are; it is neither sampled
    nor cut. Postings of a term are never gathered; hits are only counted, per
    document, passage and offset.

    Defined cases: a null or empty text or passage, or one of fewer than TERM words,
    matches nothing; a passage shorter than MIN_WORDS words counts when wholly
    there; repeated items give the row once; several ids of one passage each get a
    row; of several passages of one id each counts.
    """
    return search(build_index(docs, doc_id, text), items, item_id, passage)


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """leaked_items over a stored index."""
    terms = stage(item_terms(items, item_id, passage), "terms")
    wanted = stage(terms.select("term").distinct(), "wanted")
    postings = index.where("term is not null").select("term", "doc_id", "pos")
    hits = stage(skew_join(postings, wanted, ["term"], "inner"), "hits")
    counts = hits.groupBy("term").agg(F.count("*").alias("n"))
    chosen = stage(selecting_terms(terms.select("part", "place", "term"), counts), "chosen")
    # Offset-adjusted lists: hits on about one offset meet in a bucket; the buckets overlap by half.
    near = skew_join(hits, chosen, ["term"], "inner").select("doc_id", "part", "least", F.floor((F.col("pos") - F.col("place")) / (OFFSETS // 2)).alias("half"))
    near = near.withColumn("bucket", F.explode(F.array(F.col("half"), F.col("half") - 1)))
    pairs = near.groupBy("doc_id", "part", "bucket").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("doc_id", "part").distinct()
    pairs = stage(pairs, "candidates")
    passages = terms.select("part", "item_id", F.col("words").alias("item_words")).distinct()
    told = skew_join(pairs, passages, ["part"], "inner")
    texts = index.where("words is not null").select("doc_id", "words")
    told = texts.join(F.broadcast(told), "doc_id") if fits_broadcast(told) else texts.join(told, "doc_id")

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[int, tuple] = {}
        for b in frames:
            ks, its = [], []
            for k, ws, part, i, item in zip(*(c.to_pylist() for c in b.columns)):
                if part not in known:
                    if len(known) > PASSAGES:
                        known.clear()
                    known[part] = (item.split(" "), term_places(item.split(" ")))
                if is_leak(ws.split(" "), *known[part]):
                    ks.append(k)
                    its.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(its, pa.int64())], names=["doc_id", "item_id"])

    return told.select("doc_id", "words", "part", "item_id", "item_words").mapInArrow(run, "doc_id bigint, item_id bigint").distinct()
