import random
import re

import pytest

from setwise.llm import truncation

NOUNS = "lamp chair river window garden bottle ladder engine ticket copper basket meadow".split()
VERBS = "painted cleaned carried measured repaired polished".split()


def line(rng):
    return f"my {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} because the {rng.choice(NOUNS)} looked {rng.choice(VERBS)}."


def text(rng, n):
    return " ".join(line(rng) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, source string, text string, posted_at timestamp")


def corpus():
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(600):
        src = ("free", "limited", "marked", "broken")[i % 4]
        t = text(rng, rng.randrange(2, 9))
        if src == "limited" and len(t) > 300:
            t = t[:300]
            cut.add(i)
        if src == "marked" and len(t) > 400:
            t = t[:395].rsplit(" ", 1)[0] + "..."
            cut.add(i)
        if src == "broken" and i % 8 == 3:
            t = t[: t.rindex("because") + len("because")]
            cut.add(i)
        if src == "free" and i % 3 == 0:
            t = t[:-1]  # merely lacks the stop
        if src == "free" and i % 3 == 1:
            t += " So we shall see..."  # trails off on purpose
        rows.append((i, src, t))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    got = {r.doc_id for r in truncation.truncated(table(spark, rows)).collect()}
    assert len(got & cut) >= 0.95 * len(cut)
    assert len(got - cut) <= 0.03 * len(rows)


def test_copies_tell(spark):
    rng = random.Random(9)
    whole = text(rng, 12)
    stop = whole.index("near the", len(whole) * 9 // 10 - 40) - 1
    rows = [(1, "a", whole), (2, "b", whole[:stop]), (3, "c", whole[:stop]), (4, "d", whole + "\n\nsee you there")] + [(10 + i, "a", text(rng, 5)) for i in range(60)]
    found = {r.doc_id: r.reason for r in truncation.truncated(table(spark, rows)).collect()}
    assert found[2] == "copy ends early" and 3 in found and 1 not in found and 4 not in found


def test_compare_ends():
    rng = random.Random(2)
    whole = text(rng, 12)
    assert truncation.compare_ends(whole[: whole.index("near the", len(whole) - 90) - 1], whole) == "early"
    assert truncation.compare_ends(whole.rsplit(". ", 1)[0] + ".", whole) is None
    assert truncation.compare_ends(whole[:-1], whole[:-1]) == "same"
    assert truncation.compare_ends("short", whole) is None


def test_pairs_are_a_star(spark):
    rng = random.Random(1)
    t = text(rng, 10)
    docs = spark.createDataFrame([(i, t + f" extra {i}") for i in range(40)], "doc_id bigint, text string")
    pairs = truncation.copy_pairs(docs).collect()
    assert len(pairs) < 40 * truncation.BANDS
    assert {p.doc_id for p in pairs} | {p.other for p in pairs} == set(range(40))


def crowd():
    """A large group of near-copies: the longest differ before the place where three shorter copies are cut, the others hold it."""
    rng = random.Random(21)
    whole = text(rng, 14)
    stop = whole.index("near the", len(whole) - 90) - 1
    rows = []
    for i in range(2, 70):
        ws, n = whole.split(), len(whole[:stop].split())
        ws[rng.randrange(5, 25)] = f"word{i}"
        if i < 40:  # longer, and another word shortly before the cut
            ws[n - (3, 8)[i % 2]] = f"odd{i}"
            ws += f"signed{i} by member {i} today".split()
        if i >= 67:
            ws = ws[:n]
        rows.append((i, "b" if i >= 67 else "a", " ".join(ws)))
    return rows


def test_outliers_are_longest_of_a_large_group(spark):
    rows = crowd()
    docs = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, text string")
    brute = {a for a, _, t in rows for b, _, u in rows if a != b and truncation.compare_ends(t, u) == "early"}
    bands = truncation.shared_bands(docs)
    judged = truncation.stage(truncation.judged_pairs(docs, truncation.copy_pairs(docs, bands)), "judged")
    star = {r.doc_id for r in judged.where("ends = 'early'").collect()}
    rest = {r.doc_id for r in truncation.early_beside_rest(docs, bands, judged).collect()}
    assert brute == {67, 68, 69} and star != brute
    assert star | rest == brute
    assert brute <= {r.doc_id for r in truncation.truncated(table(spark, rows)).where("reason = 'copy ends early'").collect()}


def test_a_cut_spreads_over_all_reposts(spark):
    rng = random.Random(31)
    whole = text(rng, 14)
    whole = whole[: whole.rindex("near the") - 1]
    posts = []
    for i in range(6):
        ws = whole.split()
        ws[12 * i + 3] = f"word{i}"
        posts.append((i, " ".join(ws)))
    # A chain: each step is a near-copy, its ends are not.
    for i in range(6, 10):
        ws = posts[-1][1].split()
        for j in range(3):
            ws[80 + 20 * (i - 6) + 6 * j] = f"step{i}x{j}"
        posts.append((i, " ".join(ws)))
    docs = spark.createDataFrame(posts, "doc_id bigint, text string")
    pairs = {(a, b) for a, t in posts for b, u in posts if a != b and truncation.compare_ends(t, u) == "same"}
    want = {0}
    while more := {b for a, b in pairs if a in want} - want:
        want |= more
    assert len(want) > len({0} | {b for a, b in pairs if a == 0}) and want == set(range(10))
    bands = truncation.shared_bands(docs)
    got = truncation.alike_cut(docs, bands, docs.select("doc_id").where("doc_id = 0"))
    assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("share", [0.5, 0.7, 0.8, 0.9])
def test_cut_copies_are_found_whatever_is_missing(spark, share):
    """Real posts beside a copy of each that ends inside a sentence at a share of its length."""
    posts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 500").orderBy("doc_id").collect()
    rows, seen = [], set()
    for p in posts:
        at = int(len(p.text) * share)
        cut = p.text[:at].rstrip()
        line = p.text[max(p.text.rfind(x, 0, at) for x in "\n.!?") + 1 :].split("\n")[0]
        if p.text in seen or not (cut[-1].isalnum() and p.text[at].isalnum() and len(re.findall(r"\w+", line)) > 8):
            continue
        seen.add(p.text)
        rows += [(2 * len(seen), p.text), (2 * len(seen) + 1, cut)]
        if len(seen) == 120:
            break
    docs = truncation.stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    bands = truncation.shared_bands(docs)
    judged = truncation.stage(truncation.judged_pairs(docs, truncation.copy_pairs(docs, bands)), "judged")
    found = {r.doc_id for r in judged.where("ends = 'early'").collect()} | {r.doc_id for r in truncation.early_beside_rest(docs, bands, judged).collect()}
    cuts = {k for k, _ in rows if k % 2}
    assert len(cuts) >= 50 and len(found & cuts) >= 0.9 * len(cuts), (len(found & cuts), len(cuts))


def test_words_that_texts_break_off_in(spark):
    """A rare word that ends texts behind ever other words hangs; a signature and a word whose stop was left out don't."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        t = text(rng, 4)
        end = (f" and the {rng.choice(NOUNS)} {rng.choice('bdfg')}{rng.choice('aeiou')}{rng.choice('klmn')}{rng.choice('aeiou')} whence", "\nyours Quentin", f" it was {rng.choice(VERBS)} again", "")[i % 4]
        rows.append((i, "a", t + " We did it again." + end))
    found = {r.doc_id: r.reason for r in truncation.truncated(table(spark, rows)).collect()}
    assert {k for k in found if k % 4} == set() and {k for k in range(0, 120, 4)} <= set(found)


def test_nulls_empty_long_and_clashing(spark):
    rows = [(1, None, "nothing"), (2, "a", None), (3, "a", ""), (4, "a", "   "), (None, "a", "because"), (5, "a", "it broke because"), (5, "a", "it broke because"), (6, "b", "word " * 50_000 + "end."), (7, "b", "see <a hre")]
    df = table(spark, rows).selectExpr("*", "1 as chars", "'x' as reason", "2 as month", "3 as h1", "'y' as last")
    got = sorted((r.doc_id, r.reason) for r in truncation.truncated(df).collect())
    assert got == [(7, "markup")]  # too few texts to know what closes


def test_empty_table(spark):
    df = table(spark, [(1, "a", "x")]).limit(0)
    assert truncation.truncated(df).count() == 0
    assert truncation.truncation_report(df, truncation.truncated(df)).count() == 0
