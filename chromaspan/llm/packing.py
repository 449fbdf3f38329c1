"""Packing pieces of documents into as few sequences as possible, by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence. The program covers the histogram of lengths
with the fewest configurations. It is solved by multiplicative weights: each length has a weight that shrinks
as it is covered; a knapsack dynamic program prices the best configurations under the weights, until every length
is covered; the answer's fractions are rounded to whole numbers of sequences, never beyond what is there. Only
pieces that rounding leaves over fill the gaps of these sequences and then new ones, best fit first.

The histogram has at most ``capacity`` rows, so the plan is bounded however many documents there are. The
plan says, for each length, which ranks go where; ranks are given to pieces without gathering a length's
pieces: each task counts its own, and the counts of earlier tasks are added.

Defined cases: a null text is the empty text, which still has its closing id; repeated rows are documents of
their own; an empty table gives an empty plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, encoders

#: How fast a length's weight falls as it is covered, how near the best a configuration must be, and the longest step.
RATE, NEAR, STEP = 0.05, 0.005, 0.2
#: Shares of the solution that rounding tries, the whole one first. Without the program (0) only for histograms, mostly
#: small ones of long pieces, whose solution is not within rounding of the optimum: never more sequences than best fit.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, path: str, capacity: int, close_id: int = 0) -> DataFrame:
    """Every document's ids and a closing id, cut into pieces of ``capacity`` ids where longer.

    part and rank number the pieces of a length within a task.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, seen = encoders.word_encoder(path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        last = int(close_id).to_bytes(4, "little")
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lo, hi in common.text_chunks([len(t) for t in texts]):
                rows = []
                for doc, raw in zip(ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    raw += last
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k // (4 * capacity), k // 4, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return common.whole_texts(docs).mapInArrow(run, PIECES)


def _price(lengths, values, capacity: int):
    """The most valuable fillings of every capacity: an unbounded knapsack over the lengths of at most half of it.

    Returns (value, index of the length taken or -1) by capacity; a configuration has one longer length at most.
    """
    import numpy as np

    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    live = np.flatnonzero((values > 0) & (lengths <= capacity // 2))
    own, worth = lengths[live], values[live]
    ends = np.searchsorted(own, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if e := ends[c]:
            gain = best[c - own[:e]] + worth[:e]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], took[c] = gain[k], live[k]
    return best, took


def _worth(lengths, left, capacity: int):
    """Values of the lengths of which no configuration has more than 1, chosen for the highest bound on what is left:
    for some x up to half the capacity, 1 above capacity - x, 0 below x, and length / capacity between (x = 0: all)."""
    import numpy as np

    size, n = np.cumsum(np.concatenate(([0.0], lengths * left))) / capacity, np.cumsum(np.concatenate(([0.0], left)))
    x = np.concatenate(([0], lengths[lengths <= capacity // 2] + 1))
    x = x[x <= capacity // 2]
    low, high = np.searchsorted(lengths, x, "left"), np.searchsorted(lengths, capacity - x, "right")
    x = int(x[(n[-1] - n[high] + size[high] - size[low]).argmax()])
    share = lengths / capacity
    return 0.99 * np.where(lengths > capacity - x, 1.0, np.where(lengths < x, 0.0, share)) + 0.01 * share


def configurations(histogram: dict[int, int], capacity: int, rate: float = RATE, near: float = NEAR, most: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Fractional numbers of configurations that cover the whole histogram: [({length: copies}, number)].

    Weights are _worth() of what is left * exp(-rate * share covered beyond the least covered length). Each round prices
    fillings once and goes through the best configuration around each length, least covered first. It takes those
    within ``near`` of the round's best, as long as none of their lengths has run ``most`` ahead; a step is whole,
    and at most ``most`` of the scarcest length, until less than one sequence is left of it. Every round takes
    one at least, which uses a length up or moves it by about ``most``: rounds follow the number of lengths.
    """
    import numpy as np

    lengths = np.array(sorted(histogram), np.int64)
    there = np.array([histogram[int(x)] for x in lengths], float)
    left = there.copy()
    taken: dict[tuple, float] = {}
    while (left > 1e-9).any():
        open_, share = left > 1e-9, 1 - left / there
        limit = share[open_].min() + most
        values = np.where(open_, _worth(lengths, left, capacity) * np.exp(-rate * (share - share[open_].min())), 0.0)
        best, took = _price(lengths, values, capacity)
        own = np.where(open_, values + best[capacity - lengths], 0.0)
        good = [int(k) for k in np.lexsort((-lengths, share)) if own[k] >= (1 - near) * own.max()]
        any_ = False
        for start in good:
            if any_ and (left[start] <= 1e-9 or 1 - left[start] / there[start] >= limit):
                continue
            found, c = {start: 1}, capacity - int(lengths[start])
            while c > 0:
                if (k := int(took[c])) < 0:
                    c -= 1
                else:
                    found[k] = found.get(k, 0) + 1
                    c -= int(lengths[k])
            k, a = np.array(list(found), np.int64), np.array(list(found.values()), float)
            if any_ and ((left[k] <= 1e-9) | (1 - left[k] / there[k] >= limit)).any():
                continue
            step = min(float((left[k] / a).min()), max(1.0, most * float((there[k] / a).min())))
            step = float(int(step)) if step > 1 else step
            left[k] -= a * step
            any_ = True
            key = tuple(sorted((int(lengths[i]), n) for i, n in found.items()))
            taken[key] = taken.get(key, 0.0) + step
    return [(dict(key), x) for key, x in taken.items()]


def solution(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """The program's solution for all lengths that leave room, fullest configurations first."""
    solved = configurations({k: n for k, n in histogram.items() if n and k != capacity}, capacity)
    return sorted(solved, key=lambda t: (-sum(k * n for k, n in t[0].items()), sorted(t[0].items())))


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(contents, number)]: contents are (length, copies) in order, number is how many sequences have them.

    The solution is rounded down and what rounding leaves is placed best fit. A smaller share of it only counts
    if that takes fewer sequences.
    """
    there = {k: n for k, n in histogram.items() if n}
    solved = solution(there, capacity)
    return min((rounded(there, capacity, [(own, x * share) for own, x in solved]) for share in SHARES), key=lambda p: sum(n for _, n in p))


def whole_numbers(left: dict[int, int], solved: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the configurations, never beyond ``left``, which keeps what they leave."""
    out = []
    for own, x in solved:
        number = min(int(x + 1e-9), *(left[k] // n for k, n in own.items()))
        if number > 0:
            for k, n in own.items():
                left[k] -= n * number
            out.append((own, number))
    return out


def rounded(histogram: dict[int, int], capacity: int, solved: list[tuple[dict[int, int], float]]) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole numbers of the configurations, never beyond what is there; the rest best fit, longest first."""
    left = dict(histogram)
    groups: list[list] = []  # contents, number, room
    full = left.pop(capacity, 0)
    if full:
        groups.append([[(capacity, 1)], full, 0])
    for own, number in whole_numbers(left, solved):
        groups.append([sorted(own.items(), reverse=True), number, capacity - sum(k * n for k, n in own.items())])
    by_room: dict[int, list[int]] = {}
    for g, (_, _, room) in enumerate(groups):
        by_room.setdefault(room, []).append(g)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            room = min((r for r, own in by_room.items() if r >= length and own), default=None)
            if room is None:
                copies = min(capacity // length, n)
                g = [[(length, copies)], n // copies, capacity - length * copies]
                n -= copies * g[1]
                groups.append(g)
                by_room.setdefault(g[2], []).append(len(groups) - 1)
                continue
            i = by_room[room].pop()
            contents, number, _ = groups[i]
            if number > n:
                groups.append([list(contents), number - n, room])
                by_room[room].append(len(groups) - 1)
                groups[i][1] = number = n
            groups[i][0] = [*contents, (length, 1)]
            groups[i][2] = room - length
            by_room.setdefault(room - length, []).append(i)
            n -= number
    return [(contents, number) for contents, number, _ in groups]


def plan_arrays(packed: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple]:
    """length -> arrays (first rank, copies per sequence, first sequence, offset), ranks ascending."""
    import numpy as np

    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for contents, number in packed:
        offset = 0
        for length, copies in contents:
            first = ranks.get(length, 0)
            rows.setdefault(length, []).append((first, copies, sequence, offset))
            ranks[length] = first + copies * number
            offset += length * copies
        sequence += number
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, close_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut = common.staged(pieces(docs, path, capacity, close_id))
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(plan_arrays(pack(histogram, capacity)))  # bounded by the number of lengths
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (np.asarray(b.column(b.schema.names.index(c))) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                first, copies, at, begin = where[int(k)]
                row = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[row]
                sequence[own] = at[row] + nth // copies[row]
                offset[own] = begin[row] + nth % copies[row] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
