"""Filling containers of fixed capacity with texts (problem 7).

The lengths in tokens are gathered as a histogram, at most one entry a length up to
the capacity. A configuration linear program over it - minimise the number of
containers, each filled by one configuration, so that every length is covered - is
solved by multiplicative weights; its pricing problem, the most valuable
configuration, is a knapsack solved by dynamic programming. The solution is
rounded down and what is left is solved again; the last rest - at most some texts
for each of the ROUNDS * lengths configurations, however many texts there are - is
placed by pricing within the remaining numbers and by best fit.
Texts get their places by rank within their length.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage

TOKENIZER = os.environ.get("SETWISE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
ROUNDS = 60  # rounds of multiplicative weights
PASSES, FEW = 30, 3  # solutions one after another, each for what the one before left, until it is so many texts a length
RATE = 0.25  # their learning rate
GOOD = 0.98  # a configuration counts as optimal from this share of the best value on
REST_ROUNDS = 40  # rounds over the rounded-off rest before best fit
SALT = 64  # parts that the texts of one length are ranked in


# --- lengths ---------------------------------------------------------------------------------


def count_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text, whole, in tokens of a public byte-level vocabulary (a .tiktoken file)."""

    def run(frames: Iterator) -> Iterator:
        import base64

        import pyarrow as pa
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        piece = 100_000  # very long texts go to the encoder in parts; their tokens are those of the whole text
        for b in frames:
            ns = []
            for t in b.column(1).to_pylist():
                if len(t) <= piece:
                    ns.append(len(enc.encode_ordinary(t)))
                else:
                    ns.append(sum(len(enc.encode_ordinary(p)) for p in _pieces(t, piece)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int32())], names=["doc_id", "n_tokens"])

    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return src.mapInArrow(run, "doc_id bigint, n_tokens int")


_SEAM = re.compile(r"(?<=\S) (?=[^\W\d_])")


def _pieces(t: str, size: int) -> Iterator[str]:
    """A long text in parts of about `size` characters, cut only where a token must begin: before a blank that a word follows."""
    i = 0
    while i < len(t):
        m = _SEAM.search(t, i + size)
        j = m.start() if m else len(t)
        yield t[i:j]
        i = j


# --- the plan, on the driver: its size depends on the capacity alone ---------------------------


@dataclass
class Plan:
    """Configurations (length -> number) and how many containers each fills."""

    capacity: int
    configs: list[dict[int, int]]
    times: list[int]
    lower_bound: int

    @property
    def containers(self) -> int:
        return sum(self.times)


def _best_values(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): for every size up to capacity the best value of an unbounded knapsack, and the index of an item to take first (-1: leave one unit free)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        m = int(np.searchsorted(lengths, c, side="right"))
        best[c], last[c] = best[c - 1], -1
        if m:
            v = best[c - lengths[:m]] + values[:m]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], last[c] = v[i], i
    return best, last


def _filled(last: np.ndarray) -> np.ndarray:
    """For every size the largest size up to it at which an item is taken (0: none)."""
    at = np.arange(len(last))
    return np.maximum.accumulate(np.where(last >= 0, at, 0))


def _trace(size: int, lengths: np.ndarray, last: np.ndarray, filled: np.ndarray) -> Counter:
    out: Counter = Counter()
    size = int(filled[size])
    while size > 0:
        i = int(last[size])
        out[i] += 1
        size = int(filled[size - int(lengths[i])])
    return out


def solve_configurations(histogram: dict[int, int], capacity: int) -> Plan:
    """A packing of the histogram (length -> number, lengths 1..capacity) into containers of the capacity.

    Multiplicative weights: a length's weight is its price; each round prices the
    best configuration through every length by one dynamic programme, takes those
    of nearly optimal value into the mix, and lowers the prices of lengths that the
    mix covers more than their share. The mix is scaled to cover all, rounded down,
    and the rest is filled by pricing bounded by what remains, then by best fit.
    """
    hist = {int(k): int(v) for k, v in histogram.items() if v > 0 and 0 < k <= capacity}
    total = sum(k * v for k, v in hist.items())
    if not hist:
        return Plan(capacity, [], [], 0)
    big = sum(v for k, v in hist.items() if 2 * k > capacity)
    bound = max(-(-total // capacity), big)
    lengths = np.array(sorted(hist), np.int64)
    left = np.array([hist[int(k)] for k in lengths], np.int64)
    configs: list[dict[int, int]] = []
    times: list[int] = []

    def take(config, n: int) -> None:
        if n > 0:
            for j, k in config:
                left[j] -= k * n
            configs.append({int(lengths[j]): k for j, k in config})
            times.append(int(n))

    # Solve, round down, and solve again for what rounding left, until that is a few texts a length.
    for _ in range(PASSES):
        before = int(left.sum())
        if before <= FEW * len(lengths):
            break
        there = np.nonzero(left > 0)[0]
        mix, ratio = _solve(lengths[there], left[there].astype(float), capacity)
        full = {c: capacity - sum(int(lengths[there[j]]) * k for j, k in c) for c in mix}
        order = sorted(mix, key=lambda c: (full[c], -mix[c]))
        for c in order:
            # its amount, scaled down where the mix covers one of its lengths too often
            n = int(mix[c] * min(ratio[j] for j, _ in c))
            take([(int(there[j]), k) for j, k in c], int(min(n, min(left[there[j]] // k for j, k in c))))
        if left.sum() > 0.98 * before:
            break

    for _ in range(REST_ROUNDS):  # the rest: the fullest configuration of what remains, again and again
        there = np.nonzero(left > 0)[0]
        if not len(there) or left.sum() <= 64:
            break
        c = _fullest(lengths[there], left[there], capacity)
        c = [(int(there[j]), n) for j, n in c]
        take(c, max(1, int(min(left[j] // n for j, n in c))))
    for config in _best_fit([int(lengths[j]) for j in np.nonzero(left > 0)[0] for _ in range(int(left[j]))], capacity):
        configs.append(config)
        times.append(1)
    return Plan(capacity, configs, times, bound)


def _solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Counter, np.ndarray]:
    """Multiplicative weights: (a mix of configurations with amounts, per length the demand over what the mix covers)."""
    price = lengths / capacity
    mix: Counter = Counter()
    covered = np.zeros(len(lengths))
    for _ in range(ROUNDS):
        best, last = _best_values(lengths, price, capacity)
        filled = _filled(last)
        through = price + best[capacity - lengths]
        gain = np.zeros(len(lengths))
        for i in np.nonzero(through >= GOOD * best[capacity])[0]:
            config = _trace(capacity - int(lengths[i]), lengths, last, filled)
            config[int(i)] += 1
            # in proportion to the scarcest of its lengths, so that no round overfills one
            share = min(counts[j] / n for j, n in config.items())
            mix[tuple(sorted(config.items()))] += share
            for j, n in config.items():
                gain[j] += n * share
        covered += gain
        load = covered / counts
        price = price * np.exp(-RATE * (load / max(load.mean(), 1e-12) - 1).clip(-1, 1))
        price = np.maximum(price, 1e-9) / max(_value_bound(price, lengths, capacity), 1e-12)
    return mix, np.where(covered > 0, counts / np.maximum(covered, 1e-12), 0)


def _value_bound(price: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    return float((price / lengths).max() * capacity)


def _fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The fullest configuration within the remaining numbers that holds the longest length: bounded subset sums, longest first."""
    reach = np.full(capacity + 1, -1, np.int64)  # the last length index by which a size was first reached
    i0 = len(lengths) - 1
    start = int(lengths[i0])
    reach[start] = i0
    used = np.zeros(capacity + 1, np.int64)
    used[start] = 1
    prev = np.full(capacity + 1, -1, np.int64)
    for i in range(i0, -1, -1):
        k = int(lengths[i])
        most = min(int(left[i]), capacity // k)
        for step in range(1 + (i == i0), most + 1):
            at = np.nonzero((reach >= 0) & (reach >= i) & ((reach > i) if step == 1 else (used == step - 1) & (reach == i)))[0]
            at = at[at + k <= capacity]
            new = at[reach[at + k] < 0]
            if not len(new):
                break
            reach[new + k], used[new + k], prev[new + k] = i, step, new
        if reach[capacity] >= 0:
            break
    size = int(np.nonzero(reach >= 0)[0].max())
    out: Counter = Counter()
    while size != start:
        out[int(reach[size])] += 1
        size = int(prev[size])
    out[i0] += 1
    return sorted(out.items())


def _best_fit(items: list[int], capacity: int) -> list[dict[int, int]]:
    """Best fit decreasing; the open bins are kept in the order of their free space."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free space, bin)
    for k in sorted(items, reverse=True):
        at = bisect.bisect_left(free, (k, -1))
        if at == len(free):
            bins.append([k])
            room, no = capacity - k, len(bins) - 1
        else:
            room, no = free.pop(at)
            bins[no].append(k)
            room -= k
        if room:
            bisect.insort(free, (room, no))
    return [dict(Counter(b)) for b in bins]


# --- places ----------------------------------------------------------------------------------


def split_items(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part_no, start, n_tokens): a text longer than the capacity as full pieces and a last one; any other, an empty one too, whole."""
    parts = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no")
    rows = lengths.select("doc_id", "n_tokens", at)
    start = (F.col("part_no") * capacity).cast("int")
    return rows.select("doc_id", "part_no", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(lengths: DataFrame, capacity: int) -> tuple[DataFrame, Plan]:
    """((doc_id, part_no, start, n_tokens, container_id), plan) for texts with (doc_id, n_tokens).

    Every piece is in exactly one container, no container holds more than the
    capacity. Empty texts go to container 0. Ranks within a length come from SALT
    parts and their offsets, so a length that many texts share is no single task.
    """
    items = split_items(lengths, capacity)
    hist = {r[0]: r[1] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    plan = solve_configurations(hist, capacity)
    starts, widths, base, first, end = _ranges(plan)

    keyed = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(SALT)).cast("int"))
    part = keyed.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = part.select("n_tokens", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))  # at most capacity * SALT rows
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy("doc_id", "part_no")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "_salt"]).select("doc_id", "part_no", "start", "n_tokens", (F.col("_before") + F.col("_row")).alias("rank"))

    def place(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            n = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            r = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros(len(n), np.int64)
            for k in np.unique(n):
                if k == 0:
                    continue
                at = n == k
                lo, hi = first[int(k)], end[int(k)]
                i = lo + np.searchsorted(starts[lo:hi], r[at], side="right") - 1
                out[at] = base[i] + (r[at] - starts[i]) // widths[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out)], names=["doc_id", "part_no", "start", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id bigint, part_no int, start int, n_tokens int, container_id bigint"), plan


def _ranges(plan: Plan):
    """Per length, sorted: from which rank on a configuration's containers take its texts, how many each, and the first container."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at: Counter = Counter()
    container = 0
    for config, times in zip(plan.configs, plan.times):
        for k, n in config.items():
            rows.setdefault(k, []).append((at[k], n, container))
            at[k] += n * times
        container += times
    starts, widths, base, first, end = [], [], [], {}, {}
    for k, lst in rows.items():
        first[k] = len(starts)
        for s, n, c in lst:
            starts.append(s)
            widths.append(n)
            base.append(c)
        end[k] = len(starts)
    return np.array(starts, np.int64), np.array(widths, np.int64), np.array(base, np.int64), first, end


def pack_windows(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[tuple[str, Plan]]]:
    """((window_name, container_id, doc_id, part_no, start, n_tokens), plans): all texts packed once for each window.

    windows: a short table (window_name, capacity_tokens). Texts are tokenised once.
    Defined cases: a null text or doc_id is no item; an empty text is an item of no
    tokens; windows without name or positive capacity are skipped; empty tables
    give empty results.
    """
    lengths = stage(count_tokens(docs, doc_id, text, tokenizer), "lengths")
    out, plans = None, []
    wanted = windows.select("window_name", "capacity_tokens").dropna().where("capacity_tokens > 0").distinct()
    for name, cap in sorted(wanted.collect()):
        packed, plan = pack(lengths, cap)
        plans.append((name, plan))
        packed = packed.select(F.lit(name).alias("window_name"), "container_id", "doc_id", "part_no", "start", "n_tokens")
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "window_name string, container_id bigint, doc_id bigint, part_no int, start int, n_tokens int")
    return out, plans
