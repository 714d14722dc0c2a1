"""Texts that their source cut off (problem 9).

Near-copies are found by min-hash banding, verified and aligned: the copy whose
alignment ends early, in the middle of a sentence of the other, was cut. A cut text
is contained in its whole copy however much is missing, so the bands are narrow
enough for a text and a copy of half its length, and a pair is verified by the share
of the shorter text's shingles that the longer one holds. Records
without such a witness are judged by their source's length limits, by markup left
open, and by the terminality of their closing words - how often, in the whole
corpus, a word or the word after it ends a sentence or a line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import BROADCAST_ROWS, discard, fits_broadcast, skew_join, stage
from .words import WordIds, shingle_ids, words

SHINGLE = 5  # words a shingle
SIMILAR = 0.8  # share of a cut text's shingles that its whole copy holds; Jaccard similarity of texts that end alike
BANDS, ROWS = 32, 3  # a copy cut at 50 % of its length has Jaccard similarity 0.5 and shares a band with probability 0.986, at 60 % 0.9996
SEED = 7
END_CHARS = 1000  # characters before the end in which closing words and open markup are looked for
TAIL = 8  # words before the end that an alignment must agree in
GRAM = SHINGLE - 1  # words before the end by which texts that may hold it are looked up; every text compared has so many
SALTS = 8  # parts in which a large bucket is paired

SPIKE = 4.0  # a length limit: so many times the texts of any length near it ...
SPIKE_TEXTS = 8  # ... at least so many different texts ...
SPIKE_SHARE = 0.01  # ... and this share of its source's texts
NEAR = 24  # lengths on either side that count as near
MARK_SHARE = 0.5  # a marked limit: this share of the longest texts ends in a mark of omission
DELIBERATE = 0.05  # a closing word with this share of all marks elsewhere trails off on purpose

SEEN = 200  # occurrences that make a word's terminality known
CLOSES = 0.01  # a word that closes less often doesn't close
PAIR_TEXTS, PAIR_INSIDE = 5, 4  # a pair of words that is a way to close
VARIED = 0.5  # different words before an end, as a share of the texts that end so, that make it no fixed phrase
FRAGMENT_SEEN, FRAGMENT_SHARE = 3, 0.002  # a fragment is seen less often than this, or than this share of the word ...
WHOLE_SEEN = 20  # ... that it begins and that is seen at least so often

SEP = "\x1f"
_MARK = re.compile(r"\s*(?:\[?(?:\.\.\.|…)\]?)\s*\Z")
_OPEN = re.compile(r"(?:<[a-zA-Z/!][^<>]*|\[/?[a-zA-Z]+(?:=[^\[\]\n]*)?|&[a-zA-Z]{1,8}|&#[0-9]{0,5})\Z")
_LETTER = r"[\p{L}\p{M}]"
#: A word and, where a sentence or a line ends behind it, what ends it.
_TOKEN = re.compile(r"([^\W_]+)([ \t]*[.!?…]|[)\]\"”»']*[ \t]*(?:[.!?…]|\n|\Z))?")
_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"[^\W\d_]\d+\Z")


# --- closing words ---------------------------------------------------------------------------


def closing_counts(docs: DataFrame, text: str, often: DataFrame) -> DataFrame:
    """(kind, word, n, ends) over all whole texts: occurrences of each word and how many of them end a sentence or a line.

    kind 'word': the word itself; 'after': the word that follows it; 'pair': the pairs
    of often (prev, last), written with SEP between. Numbers count as one word '#'.
    The last word of each text is left out, so that cut ends don't vouch for
    themselves. Counts are combined in each batch before the shuffle. The pairs go
    to the tasks while there are BROADCAST_ROWS of them at most; beyond, all pairs of
    the corpus are counted and then joined.
    """
    known = {(p, w) for p, w in often.select("prev", "last").limit(BROADCAST_ROWS + 1).collect()}
    every = len(known) > BROADCAST_ROWS
    if every:
        known = set()
    firsts = {p for p, _ in known}

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            n, e, alone, e2, n3 = Counter(), Counter(), Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                found = _TOKEN.findall(t.lower())[:-1]
                ws = ["#" if w.isdigit() else w for w, _ in found]
                cs = [bool(c) for _, c in found]
                n.update(ws)
                e.update([w for w, c in zip(ws, cs) if c])
                # Pairs within a sentence: a word that doesn't close has one behind it, but for the text's last.
                if ws and not cs[-1]:
                    alone[ws[-1]] += 1
                e2.update([p for p, before, c in zip(ws, cs, cs[1:]) if c and not before])
                n3.update([p + SEP + w for p, w, before in zip(ws, ws[1:], cs) if (every or (p in firsts and (p, w) in known)) and not before])
            n2 = Counter({w: m - e[w] - alone[w] for w, m in n.items() if m > e[w] + alone[w]})
            ks = ["word"] * len(n) + ["after"] * len(n2) + ["pair"] * len(n3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ks, pa.string()),
                    pa.array([*n, *n2, *n3], pa.string()),
                    pa.array([*n.values(), *n2.values(), *n3.values()], pa.int64()),
                    pa.array([*(e[w] for w in n), *(e2[w] for w in n2), *([0] * len(n3))], pa.int64()),
                ],
                names=["kind", "word", "n", "ends"],
            )

    part = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, "kind string, word string, n bigint, ends bigint")
    return part.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def frequent_pairs(ends: DataFrame) -> DataFrame:
    """(prev, last, texts, befores): the word pairs that end PAIR_TEXTS different texts or more, and after how many different words."""
    per = ends.where("prev is not null").groupBy("prev", "last").agg(F.countDistinct("h1").alias("texts"), F.countDistinct("prev2").alias("befores"))
    return per.where(F.col("texts") >= PAIR_TEXTS)


def hanging_ends(ends: DataFrame, counts: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id) of the ends in a word or pair that many texts break off in.

    It ends PAIR_TEXTS different texts or more without a stop, more than the word closes
    sentences or lines in the whole corpus, and stands behind ever other words: at
    least VARIED as many as texts. (A signature stands behind a line break or always the
    same words; a word whose stop was merely left out closes sentences elsewhere.)
    """
    closes = counts.where("kind = 'word'").select(F.col("word").alias("last"), "ends")
    varied = ends.groupBy("last").agg(F.countDistinct("h1").alias("texts"), F.countDistinct("prev").alias("befores"))
    hangs = lambda df: df.join(closes, "last", "left").where((F.col("texts") >= PAIR_TEXTS) & (F.col("befores") >= VARIED * F.col("texts")) & (F.coalesce("ends", F.lit(0)) < F.col("texts")))
    by_word = ends.join(hangs(varied).select("last"), "last", "left_semi").select("doc_id")
    by_pair = ends.join(hangs(often).select("prev", "last"), ["prev", "last"], "left_semi").select("doc_id")
    return by_word.unionByName(by_pair)


def unfinished_ends(ends: DataFrame, counts: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id) of the ends (doc_id, last, prev, prev2, h1) whose closing words don't close.

    last: the last word in lower case ('#' for a number); prev, prev2: the words before
    it in the same sentence, or null; h1 stands for the whole text. A word seen SEEN times
    that closes less often than CLOSES, or a word after which hardly any word closes -
    but not where the pair is a way to close: it is one of often, stands mostly behind
    the same words or none, and inside texts less than PAIR_INSIDE times as often as it
    ends one; a word or pair in which many texts break off (hanging_ends); or a fragment:
    hardly ever seen itself, but the beginning of a common word.
    """
    open_words = counts.where((F.col("n") >= SEEN) & (F.col("ends") < CLOSES * F.col("n")))
    by_last = ends.join(open_words.where("kind = 'word'").select(F.col("word").alias("last")), "last", "left_semi").select("doc_id", "prev", "last")
    by_prev = ends.join(open_words.where("kind = 'after'").select(F.col("word").alias("prev")), "prev", "left_semi").select("doc_id", "prev", "last")
    inside = counts.where("kind = 'pair'").select(F.split("word", SEP)[0].alias("prev"), F.split("word", SEP)[1].alias("last"), F.col("n").alias("inside"))
    closers = often.where(F.col("befores") < VARIED * F.col("texts")).join(inside, ["prev", "last"], "left").where(F.coalesce("inside", F.lit(0)) < PAIR_INSIDE * F.col("texts")).select("prev", "last")
    by_words = by_last.unionByName(by_prev).distinct().join(closers, ["prev", "last"], "left_anti").select("doc_id")
    word = counts.where("kind = 'word'")
    rare = ends.where(F.col("last").rlike(rf"^{_LETTER}+$")).select("doc_id", "last")
    common = word.where((F.col("n") >= WHOLE_SEEN) & (F.length("word") > 1) & (F.length("word") <= 64))
    starts = common.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("last")).groupBy("last").agg(F.max("n").alias("whole"))
    own = word.select(F.col("word").alias("last"), "n")
    few = F.coalesce("n", F.lit(0)) < F.greatest(F.lit(FRAGMENT_SEEN), FRAGMENT_SHARE * F.col("whole"))
    by_fragment = rare.join(starts, "last").join(own, "last", "left").where(few).select("doc_id")
    return by_words.unionByName(by_fragment).unionByName(hanging_ends(ends, counts, often)).distinct()


# --- ends of texts ---------------------------------------------------------------------------


def text_ends(src: DataFrame) -> DataFrame:
    """What stands at the end of each text of src (doc_id, source, text, posted).

    (doc_id, source, month, chars, bytes, h1, h2, marked, open_markup, open_end, last,
    prev, prev2, code): h1 and h2 stand for the text; marked: it ends in a mark of omission;
    open_markup: in markup that isn't closed; open_end: in a letter or number; last,
    prev, prev2: its last three words within the last sentence, in lower case, '#' for a number;
    code: the end belongs to an address or a name with digits. Only what ends a text is
    judged here, in the last END_CHARS characters.
    """
    keep = src.select("doc_id", "source", F.date_trunc("month", "posted").alias("month"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.right("text", F.lit(END_CHARS)).alias("text"))

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            marked, markup, opened, last, prev, prev2, code = ([] for _ in range(7))
            for t in b.column(b.num_columns - 1).to_pylist():
                t = t.rstrip()
                m = _MARK.search(t, max(0, len(t) - 8))
                marked.append(m is not None)
                markup.append(any(_OPEN.match(t, x) is not None for x in (t.rfind("<"), t.rfind("["), t.rfind("&")) if x >= 0))
                opened.append(t[-1:].isalnum())
                bare = t[: m.start()] if m else t
                start = max(bare.rfind(x) for x in "\n.!?…") + 1
                ws = _WORD.findall(bare[start:].lower())[-3:]
                ws = ["#" if w.isdigit() else w for w in ws]
                last.append(ws[-1] if ws else None)
                prev.append(ws[-2] if len(ws) > 1 else None)
                prev2.append(ws[-3] if len(ws) > 2 else None)
                end = t.rsplit(None, 1)[-1] if t else ""
                code.append("http://" in end or "https://" in end or "www." in end or "@" in end or _CODE.search(end) is not None)
            new = [pa.array(x, pa.bool_()) for x in (marked, markup, opened)] + [pa.array(x, pa.string()) for x in (last, prev, prev2)] + [pa.array(code, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "marked", "open_markup", "open_end", "last", "prev", "prev2", "code"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in keep.schema.fields[:-1]]
    return keep.mapInArrow(run, ", ".join([*fields, "marked boolean, open_markup boolean, open_end boolean, last string, prev string, prev2 string, code boolean"]))


# --- length limits ---------------------------------------------------------------------------


def length_limits(sizes: DataFrame) -> DataFrame:
    """(source, measure, at): lengths at which a source cuts, found as spikes of its length distribution.

    sizes: (source, measure, len, texts), texts the number of different texts. The
    groups that are ordered are a source's distinct lengths, not its rows.
    """
    w = Window.partitionBy("source", "measure")
    beside = F.greatest(*[F.coalesce(F.max("texts").over(w.orderBy("len").rangeBetween(*r)), F.lit(1)) for r in ((-NEAR, -1), (1, NEAR))])
    spikes = sizes.withColumns({"beside": beside, "all": F.sum("texts").over(w)})
    spikes = spikes.where((F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") >= SPIKE * F.col("beside")) & (F.col("texts") >= SPIKE_SHARE * F.col("all")))
    return spikes.select("source", "measure", F.col("len").alias("at"))


def marked_limits(sizes: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, low, high): sources whose longest texts pile up below a length and mostly end in a mark of omission."""
    total = Window.partitionBy("source")
    up = Window.partitionBy("source").orderBy("len")
    chars = sizes.where("measure = 'chars'")
    high = chars.withColumn("share", F.sum("texts").over(up) / F.sum("texts").over(total)).where("share >= 0.999").groupBy("source").agg(F.min("len").alias("high"))
    at = skew_join(ends, high, ["source"], "inner")
    in_top = (F.col("chars") > 0.95 * F.col("high")) & (F.col("chars") <= F.col("high"))
    per = at.groupBy("source", "high").agg(
        F.count(F.when(in_top, 1)).alias("top"),
        F.count(F.when(in_top & F.col("marked"), 1)).alias("marked"),
        F.count(F.when((F.col("chars") > 0.90 * F.col("high")) & (F.col("chars") <= 0.95 * F.col("high")), 1)).alias("below"),
    )
    return per.where((F.col("top") >= 3 * F.col("below")) & (F.col("marked") >= MARK_SHARE * F.col("top")) & (F.col("marked") >= SPIKE_TEXTS)).select("source", (0.93 * F.col("high")).alias("low"), "high")


# --- near-copies -----------------------------------------------------------------------------


def band_keys(docs: DataFrame) -> DataFrame:
    """(key, n_words, doc_id) of every text of SHINGLE words or more, a row a band; key holds the band's number too; docs: (doc_id, text)."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    c = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        ids = WordIds()
        for b in frames:
            ks, ts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ks), 64):
                parts, ns, ds = [], [], []
                for k, t in zip(ks[lo : lo + 64], ts.slice(lo, 64).to_pylist()):
                    ws = words(t)
                    s = shingle_ids(ids(ws), SHINGLE)
                    if len(s):
                        parts.append(s)
                        ns.append(len(ws))
                        ds.append(k)
                m = len(ds)
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (m, 1))
                if m:  # the shingles of all these texts go through each hash function at once
                    flat = np.concatenate(parts)
                    starts = np.cumsum([0, *map(len, parts[:-1])])
                    for i in range(BANDS * ROWS):
                        h = flat * a[i] + c[i]
                        h ^= h >> np.uint64(31)
                        at = key[:, i // ROWS]
                        at ^= np.minimum.reduceat(h, starts)
                        at *= np.uint64(0x9E3779B97F4A7C15)
                        at ^= at >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.array(ns, np.int32), BANDS)), pa.array(np.repeat(np.array(ds, np.int64), BANDS))],
                    names=["key", "n_words", "doc_id"],
                )

    return docs.mapInArrow(run, "key bigint, n_words int, doc_id bigint")


def shared_bands(docs: DataFrame) -> DataFrame:
    """The band_keys that several texts have, with their number (many); the others, nearly all, go no further."""
    bands = stage(band_keys(docs), "bands")
    many = stage(bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "shared")
    some = bands.join(F.broadcast(many), "key") if fits_broadcast(many) else bands.join(many, "key")
    out = stage(some, "bands")
    discard(bands)
    return out


def copy_pairs(docs: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """(doc_id, other): each text with the longest text of every band bucket it lies in - a star, never all pairs.

    docs: (doc_id, text), one row per different text; bands: their shared_bands, where known.
    """
    bands = shared_bands(docs) if bands is None else bands
    longest = bands.groupBy("key").agg(F.max(F.struct("n_words", -F.col("doc_id"))).alias("m")).select("key", (-F.col("m.col2")).alias("other"))
    return skew_join(bands, longest, ["key"], "inner").where("doc_id <> other").select("doc_id", "other").distinct()


def compare_ends(text: str, other: str) -> str | None:
    """How a text ends beside a near-copy: 'early' - inside a sentence of the other, which holds it; 'same' - where the other, which is alike, ends; None - otherwise or no near-copy."""
    a, b = words(text), words(other)
    sa = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    sb = {tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)}
    both = len(sa & sb)
    if not both or both < SIMILAR * len(sa):
        return None
    alike = both >= SIMILAR * (len(sa) + len(sb) - both)
    tail = a[-TAIL - 1 : -1]
    if len(tail) < 3:
        return None
    for j in range(len(b) - 1, len(tail) - 1, -1):  # b[j]: where a's last word should stand
        if b[j - len(tail) : j] != tail or not b[j].startswith(a[-1]):
            continue
        if b[j] != a[-1]:
            if a[-1].isalpha():
                return "early"
            continue  # another number is no longer word
        if j == len(b) - 1:
            return "same" if alike and _ends_open(text) else None
        return "early" if _ends_open(text) and _runs_on(other, tail[-2:] + [b[j], b[j + 1]]) else None
    return None


def _ends_open(text: str) -> bool:
    return bool(re.search(r"[^\W_]\s*$", text))


def _runs_on(text: str, ws: list[str]) -> bool:
    """Do the words stand in one line and sentence of the text?"""
    gap = r"(?:<[^<>\n]*>|\[[^\[\]\n]*\]|[ \t,;:'\"“”*_-])+"
    return bool(re.search(gap.join(map(re.escape, ws)), text, re.I))


def judged_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, other, ends) of the pairs that are near-copies and tell something about doc_id's end; only texts of candidate pairs are shuffled."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            out = ([], [], [])
            for k, o, t, u in zip(*(c.to_pylist() for c in b.columns)):
                how = compare_ends(t, u)
                if how:
                    for lst, v in zip(out, (k, o, how)):
                        lst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "other", "ends"])

    # Texts outside all pairs stay where they are.
    pairs = stage(pairs, "pairs")
    named = stage(pairs.select("doc_id").unionByName(pairs.select(F.col("other").alias("doc_id"))).distinct(), "named")
    docs = docs.join(F.broadcast(named) if fits_broadcast(named) else named, "doc_id", "left_semi")
    # The longest text of a large group of copies is the other side of many pairs: its text is not shuffled to one task.
    other = docs.select(F.col("doc_id").alias("other"), F.col("text").alias("other_text"))
    paired = skew_join(pairs, other, ["other"], "inner", rows=0)
    return paired.join(docs, "doc_id").select("doc_id", "other", "text", "other_text").mapInArrow(run, "doc_id bigint, other bigint, ends string")


def _texts_of(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """The texts that bands names, read where they lie."""
    named = stage(bands.select("doc_id").distinct(), "named")
    return docs.join(F.broadcast(named) if fits_broadcast(named) else named, "doc_id", "left_semi")


def end_words(docs: DataFrame) -> DataFrame:
    """(doc_id, before, last, open): id of the GRAM words before the last word, the last word, and whether the text ends in it."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        ids = WordIds()
        for b in frames:
            out = ([], [], [], [])
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(t)[-GRAM - 1 :]
                if len(ws) > GRAM:
                    for lst, v in zip(out, (k, int(shingle_ids(ids(ws[:-1]), GRAM).view(np.int64)[0]), ws[-1], _ends_open(t))):
                        lst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "before", "last", "open"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, before bigint, last string, open boolean")


def word_places(docs: DataFrame) -> DataFrame:
    """(other, before, word, final): every word of each text behind the id of the GRAM words before it; final: it is the last."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        ids = WordIds()
        for b in frames:
            ks, ts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ks), 256):
                out = ([], [], [], [])
                for k, t in zip(ks[lo : lo + 256], ts.slice(lo, 256).to_pylist()):
                    ws = words(t)
                    n = max(0, len(ws) - GRAM)
                    for lst, v in zip(out, ([k] * n, shingle_ids(ids(ws[:-1]), GRAM).view(np.int64).tolist(), ws[GRAM:], [False] * (n - 1) + [True] * (n > 0))):
                        lst.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["other", "before", "word", "final"])

    return docs.select("doc_id", "text").mapInArrow(run, "other bigint, before bigint, word string, final boolean")


def seek(docs: DataFrame, seekers: DataFrame, targets: DataFrame, keys: list[str], verdict: str, shorter_first: bool = False) -> DataFrame:
    """(doc_id) of the seekers (keys, doc_id, n_words) that show the verdict beside a target (keys, other, n_words) of the same keys.

    Every group's targets are tried from the longest on, in rounds of growing width, until
    a seeker has its verdict or its groups are exhausted; nothing is left untried.
    shorter_first: of a pair, the shorter text is the one whose end is judged.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n_other"), "other")
    targets = stage(targets.withColumnRenamed("n_words", "n_other").withColumn("nth", F.row_number().over(order) - 1), "targets")
    left = stage(seekers.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "seekers")
    got, lo, width = None, 0, 1
    while True:
        some = targets.where(F.col("nth").between(lo, lo + width - 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = stage(left.join(some, [*keys, "salt"]).select("doc_id", "other", (F.col("n_words") > F.col("n_other")).alias("turn")).distinct(), "tries")
        if pairs.isEmpty():  # places in a group are without gaps, so nothing follows
            break
        pairs = pairs.where("doc_id <> other")
        if shorter_first:
            judged = judged_pairs(docs, pairs.select(F.when(F.col("turn"), F.col("other")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("turn"), F.col("doc_id")).otherwise(F.col("other")).alias("other")).distinct())
            judged = judged.where(F.col("ends") == verdict)
            judged = stage(judged.select("doc_id", "other").unionByName(judged.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"))), "tried")
            hit = pairs.join(judged, ["doc_id", "other"], "left_semi")
        else:
            hit = judged_pairs(docs, pairs.select("doc_id", "other")).where(F.col("ends") == verdict)
        hit = stage(hit.select("doc_id").distinct(), "hits")
        got = hit if got is None else got.unionByName(hit)
        rest = stage(left.join(hit, "doc_id", "left_anti"), "seekers")
        discard(left)
        discard(pairs)
        left, lo, width = rest, lo + width, width * 4
    return docs.select("doc_id").limit(0) if got is None else got


def early_beside_rest(docs: DataFrame, bands: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id) of the texts without a witness in judged that end early beside another text of one of their buckets.

    Only texts that hold the GRAM words before a text's end, and behind them what can
    run on, can witness for it: they are looked up, and compared until one does.
    """
    crowded = stage(bands.where("many > 2").drop("many"), "crowded")  # in a bucket of two the longest is the only other
    if crowded.isEmpty():
        return docs.select("doc_id").limit(0)
    near = _texts_of(docs, crowded)
    tails = end_words(near).join(judged.where("ends = 'early'").select("doc_id").distinct(), "doc_id", "left_anti")
    tails = stage(tails.where(F.col("open") | F.col("last").rlike(r"\D")), "tails")
    kinds = tails.select("before", "last", "open").distinct()
    kinds = F.broadcast(kinds) if fits_broadcast(kinds) else kinds
    on = ["before", "last", "open"]
    cut_word = F.col("word").startswith(F.col("last")) & (F.col("word") != F.col("last"))
    witness = word_places(near).join(kinds, "before").where(cut_word | (F.col("open") & ~F.col("final") & (F.col("word") == F.col("last"))))
    witness = stage(witness.select("other", *on).distinct(), "witnesses")
    keys = ["key", *on]
    targets = witness.join(crowded.withColumnRenamed("doc_id", "other"), "other").select(*keys, "other", "n_words")
    seekers = tails.join(witness.select(*on).distinct(), on, "left_semi").join(crowded, "doc_id").select(*keys, "doc_id", "n_words")
    return seek(docs, seekers, targets, keys, "early")


def alike_cut(docs: DataFrame, bands: DataFrame, cut: DataFrame) -> DataFrame:
    """(doc_id) of cut and of all texts that near-copies ending in the same place link to it, over any number of steps.

    cut: (doc_id) of texts with an open end that were found cut. Each step compares the
    texts found last with those not found that lie in their buckets and end alike.
    """
    shared = bands.drop("many")
    near = _texts_of(docs, shared)
    keys = ["key", "before", "last"]
    ends = stage(end_words(near).where("open").drop("open").join(shared, "doc_id"), "alike")
    found = new = stage(cut.select("doc_id").distinct(), "cut")
    while not new.isEmpty():
        targets = ends.join(new, "doc_id", "left_semi").select(*keys, F.col("doc_id").alias("other"), "n_words")
        seekers = ends.join(found, "doc_id", "left_anti").join(targets.select(*keys).distinct(), keys, "left_semi")
        new = stage(seek(docs, seekers, targets, keys, "same", shorter_first=True).distinct(), "cut")
        found = found.unionByName(new)
    return found


# --- all together ----------------------------------------------------------------------------


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", posted: str = "posted_at") -> DataFrame:
    """(doc_id, source, reason) of every text that its source cut off; a copy of a cut text counts as cut.

    reason: the first that holds of 'limit', 'marked limit', 'markup', 'copy ends
    early', 'closing words', 'copy of a cut text'.

    Defined cases: a null or blank text is not cut; a null source counts as a
    source of its own; equal texts are compared once and share every verdict that
    rests on the text's end; a null doc_id is left out; without any text the result
    is empty. Limits need SPIKE_TEXTS different texts, so small tables may show none.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), F.col(posted).alias("posted"))
    src = src.where(F.col("doc_id").isNotNull() & (F.trim("text") != ""))
    ends = text_ends(src)
    ends = stage(ends, "ends")

    sizes = (
        ends.select("source", "h1", "h2", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("measure", "len"))
        .distinct()
        .groupBy("source", "measure", "len")
        .agg(F.count("*").alias("texts"))
    )
    sizes = stage(sizes, "sizes")
    limits = stage(length_limits(sizes), "limits")
    at_limit = _at_limit(ends, limits)
    marked = _at_marked_limit(ends, marked_limits(sizes, ends))
    markup = ends.where("open_markup").select("doc_id")

    open_ends = ends.where("open_end and not code and last is not null").select("doc_id", "last", "prev", "prev2", "h1")
    often = stage(frequent_pairs(open_ends), "pairs")
    counts = stage(closing_counts(docs, text, often), "closings")
    closing = unfinished_ends(open_ends, counts, often)

    one = ends.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    distinct = stage(src.select("doc_id", "text").join(one, "doc_id", "left_semi"), "texts")
    bands = shared_bands(distinct)
    judged = stage(judged_pairs(distinct, copy_pairs(distinct, bands)), "judged")
    early = judged.where("ends = 'early'").select("doc_id").unionByName(early_beside_rest(distinct, bands, judged)).distinct()

    ranked = None
    for rank, (reason, part) in enumerate((("limit", at_limit), ("marked limit", marked), ("markup", markup), ("copy ends early", early), ("closing words", closing))):
        part = part.select("doc_id", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = stage(ranked.groupBy("doc_id").agg(F.min(F.struct("rank", "reason"))["reason"].alias("reason")), "verdicts")

    # A verdict on an unfinished end holds for equal texts and for near-copies that end in the same place.
    known = ends.join(first, "doc_id", "left")
    cut_text = known.where("reason is not null and open_end").groupBy("h1", "h2").agg(F.lit(True).alias("same_text"))
    # Texts are compared once: one stands for those equal to it.
    cut_docs = known.join(cut_text, ["h1", "h2"], "left_semi").select("doc_id").join(one, "doc_id", "left_semi")
    cut_docs = stage(alike_cut(distinct, bands, cut_docs), "alike")
    same = judged.where("ends = 'same'")
    mates = same.join(cut_docs.withColumnRenamed("doc_id", "other"), "other", "left_semi").select("doc_id")
    mates = mates.unionByName(cut_docs).unionByName(same.join(cut_docs, "doc_id", "left_semi").select(F.col("other").alias("doc_id")))
    mate_text = ends.join(mates.distinct(), "doc_id", "left_semi").groupBy("h1", "h2").agg(F.lit(True).alias("mate"))
    out = known.join(cut_text, ["h1", "h2"], "left").join(mate_text, ["h1", "h2"], "left")
    reason = F.coalesce("reason", F.when(F.col("same_text") | F.col("mate"), "copy of a cut text"))
    return out.select("doc_id", "source", reason.alias("reason")).where("reason is not null").dropDuplicates(["doc_id"])


def _at_limit(ends: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id) of the texts at a limit of their source: those whose end is open, and the others in months in which the limit held.

    Below a limit in bytes, up to three bytes may be missing where the next sign didn't fit.
    """
    lim = F.broadcast(limits) if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else limits
    long = ends.select("doc_id", "source", "month", "open_end", (F.col("bytes") > F.col("chars")).alias("wide"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("measure", "len"))
    at = long.join(lim, ["source", "measure"])
    hit = at.where((F.col("len") == F.col("at")) | ((F.col("measure") == "bytes") & F.col("wide") & F.col("open_end") & F.col("len").between(F.col("at") - 3, F.col("at") - 1)))
    per = at.where("month is not null").groupBy("source", "measure", "month", "at")
    held = per.agg(F.count(F.when(F.col("len") == F.col("at"), 1)).alias("n"), F.count(F.when(F.col("len") > F.col("at"), 1)).alias("over")).where("n > over").drop("n", "over")
    closed = hit.where("not open_end").join(held, ["source", "measure", "month", "at"], "left_semi")
    return hit.where("open_end").select("doc_id").unionByName(closed.select("doc_id")).distinct()


def _at_marked_limit(ends: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id) of the texts that end in a mark of omission just below their source's limit, but not in a word that trails off on purpose."""
    marks = skew_join(ends.where("marked"), limits, ["source"], "left").withColumn("inside", (F.col("chars") > F.col("low")) & (F.col("chars") <= F.col("high")))
    outside = marks.where("inside is null or not inside").groupBy("last").agg(F.count("*").alias("n"))
    total = outside.agg(F.sum("n")).collect()[0][0] or 0
    wilful = outside.where(F.col("n") >= DELIBERATE * total).select("last")  # at most 1 / DELIBERATE words
    return marks.where("inside").join(F.broadcast(wilful), "last", "left_anti").select("doc_id").distinct()


def truncation_report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(source, posts, cut, share): how often each source cuts off."""
    per = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("posts"))
    cut = found.groupBy("source").agg(F.count("*").alias("cut"))
    return per.join(cut, "source", "left").select("source", "posts", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("posts")).alias("share"))
