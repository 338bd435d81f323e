"""Best-fit packing by a configuration linear program.

Only the histogram of lengths matters: at most ``room`` numbers, whatever the number of pieces. A configuration says
how many pieces of each length share a sequence. The program asks for the least total of configurations that covers
the histogram, and is solved by multiplicative weights: every length has a price, a knapsack dynamic program finds for every
large length (and for a sequence without one) what is worth most beside it, all configurations that come close to the best value are used a
little, and prices fall as lengths are served. The fractional plan is rounded, as long as configurations waste no more than the program's
bound allows, and what rounding leaves is a smaller program of its own, a few times. The last pieces are put by best fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def prices(value: np.ndarray, sizes: np.ndarray, room: int, noise: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to ``room`` what a knapsack of any numbers of ``sizes`` (ascending) is worth, and its last size (position; -1 empty, -2 as one less).

    ``noise`` (numbers that shift the choice at each capacity, not the worth) makes choices of nearly equal worth vary from capacity to capacity.
    """
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    if not len(sizes):
        return best, last
    end = int(sizes[-1])
    worth, where = np.full(end, -np.inf), np.zeros(end, int)
    worth[end - sizes], where[end - sizes] = value, np.arange(len(sizes))  # the largest size first: it wins ties
    for c in range(int(sizes[0]), room + 1):
        m = min(c, end)
        more = worth[end - m :] + best[c - m : c]
        at = (c * 7919) % (len(noise) - m) if noise is not None else 0
        j = int((more if noise is None else more + noise[at : at + m]).argmax())
        best[c], last[c] = (more[j], where[end - m + j]) if more[j] > best[c - 1] else (best[c - 1], min(-2, last[c - 1]) if last[c - 1] == -1 else -2)
        if best[c] == 0:
            last[c] = -1
    return best, last


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 24, step: float = 0.1, rate: float = 0.2, near: float = 0.05, seed: int = 0) -> tuple[dict[tuple, float], np.ndarray, float]:
    """({configuration: times}, how often each length is served, lower bound of the program) by multiplicative weights."""
    rng = np.random.default_rng(seed)
    small, large = np.flatnonzero(sizes <= room // 2), np.flatnonzero(sizes > room // 2)
    weight, served, used = sizes / room, np.zeros(len(sizes)), {}
    least = max(sizes @ demand / room, demand[large].sum())
    for r in range(rounds):
        if r % 8 == 0:  # no plan is shorter than what the pieces are worth at prices that let no sequence be worth more than 1
            best, _ = prices(weight[small], sizes[small], room)
            least = max(least, weight @ demand / max([best[room], *(weight[large] + best[room - sizes[large]])]))
        best, last = prices(weight[small], sizes[small], room, 0.01 * 0.97**r * rng.random(3 * room))
        value = np.append(weight[large] + best[room - sizes[large]], best[room])
        configs = []
        for k in np.flatnonzero(value >= (1 - near) * value.max()):
            config, at = ({int(large[k]): 1}, room - int(sizes[large[k]])) if k < len(large) else ({}, room)
            while at > 0 and last[at] != -1:
                i = int(small[last[at]]) if last[at] >= 0 else -1
                if i < 0 or config.get(i, 0) >= demand[i]:
                    at -= 1
                else:
                    config[i], at = config.get(i, 0) + 1, at - int(sizes[i])
            configs.append(config)
        of = np.repeat(np.arange(len(configs)), [len(c) for c in configs])
        i, n = np.concatenate([np.fromiter(c, int) for c in configs]), np.concatenate([np.fromiter(c.values(), float) for c in configs])
        times, over = np.full(len(configs), np.inf), np.ones(len(configs))
        np.minimum.at(times, of, step * demand[i] / n)
        np.maximum.at(over, of, np.bincount(i, n * times[of] / demand[i], len(sizes))[i] / step)  # so no length is served by more than step
        times /= over
        load = np.bincount(i, n * times[of] / demand[i], len(sizes))
        for c, by in zip(configs, times, strict=True):
            key = tuple(sorted(c.items()))
            used[key] = used.get(key, 0.0) + by
        served += load
        weight = weight * np.exp(-rate * load / step)
        weight /= weight.max()
        if served.min() >= 1:
            break
    return used, served, float(least)


def fill(sizes: np.ndarray, most: np.ndarray, room: int) -> dict[int, int]:
    """Counts by position in ``sizes`` (ascending), ``most`` of each at most, that fill ``room`` as far as any choice does; large ones first."""
    reach, every, steps = 1, (1 << (room + 1)) - 1, []  # bit c: some choice fills c
    for k in np.flatnonzero((sizes <= room) & (most > 0))[::-1]:
        left, unit = int(min(most[k], room // sizes[k])), 1
        while left > 0:
            n = min(unit, left)
            steps.append((int(k), n, n * int(sizes[k]), reach))
            reach |= (reach << n * int(sizes[k])) & every
            left, unit = left - n, unit * 2
        if reach >> room:
            break
    at, found = reach.bit_length() - 1, {}
    for k, n, w, before in reversed(steps):
        if not before >> at & 1:
            found[k] = found.get(k, 0) + n
            at -= w
    return found


def rest(sizes: np.ndarray, left: np.ndarray, room: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(times, counts by position) that hold all of ``left``: the largest piece and what fills its sequence best from all others, as often as these last."""
    left = left.copy()
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        config = fill(sizes, left, room - int(sizes[largest]))
        left[largest] += 1
        config[largest] = config.get(largest, 0) + 1
        k, n = np.fromiter(config, int), np.fromiter(config.values(), np.int64)
        times = int((left[k] // n).min())
        left[k] -= times * n
        yield times, config


def plan(lengths: dict[int, int], room: int, phases: int = 4, slack: float = 0.001) -> tuple[list[tuple[int, dict[int, int]]], dict[str, float]]:
    """(times, {length: count}) that hold the histogram ``lengths`` exactly, and a report. Works on the histogram alone.

    Each phase solves the program for what is left and rounds it; what rounding leaves goes by best fit, which needs some pieces to choose from, so phases
    end before they would lengthen the plan, or when one places less than a tenth of what is left.
    The report: ``sequences``, ``bound`` (no plan has fewer), ``solved`` (share of pieces that the program places, full ones among them).
    """
    total = lambda configs: sum(times for times, _ in configs)
    whole = [(lengths[room], {room: 1})] if lengths.get(room) else []
    sizes = np.array(sorted(x for x, n in lengths.items() if n and x < room), np.int64)
    demand = np.array([lengths[int(x)] for x in sizes], np.int64)
    left, solved, bound = demand.copy(), [], 0.0
    best, by_program = list(rest(sizes, demand, room)), 0
    for phase in range(phases):
        on = np.flatnonzero(left)
        if not len(on):
            break
        used, served, least = solve(sizes[on], left[on], room, seed=phase)
        bound, before = max(bound, least) if phase == 0 else bound, left.sum()
        scale, full = max(1e-9, float(np.median(served))), (1 - slack) * min(room, sizes[on] @ left[on] / least)
        for config, by in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            k, n = on[[x for x, _ in config]], np.array([x for _, x in config])
            times = int(min(math.ceil(by / scale - 0.5), (left[k] // n).min()))
            if times > 0 and sizes[k] @ n >= full:
                left[k] -= times * n
                solved.append((times, dict(zip(k.tolist(), n.tolist(), strict=True))))
        now = solved + list(rest(sizes, left, room))
        if total(now) > total(best):
            break
        best, by_program = now, (demand - left).sum()
        if before - left.sum() < 0.1 * before:
            break
    full = sum(n for n, _ in whole)
    report = {"sequences": total(best) + full, "bound": math.ceil(bound - 1e-6) + full, "solved": float((by_program + full) / max(1, demand.sum() + full))}
    return whole + [(times, {int(sizes[k]): int(n) for k, n in config.items()}) for times, config in best], report


def places(configs: list[tuple[int, dict[int, int]]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length the runs of places in order of rank: first rank, first sequence, places a sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, config in configs:
        offset = 0
        for size, n in sorted(config.items(), reverse=True):
            runs.setdefault(size, []).append((rank.get(size, 0), sequence, n, offset))
            rank[size] = rank.get(size, 0) + times * n
            offset += size * n
        sequence += times
    return {size: dict(zip(("rank", "sequence", "n", "offset"), np.array(x, np.int64).T, strict=True)) for size, x in runs.items()}


def pack(df: DataFrame, room: int = 2048, length: str = "length", group_rows: int = 50_000, key: list[str] | None = None) -> DataFrame:
    """``df`` with sequence_id and offset: pieces with ``length`` from 1 to ``room`` in as few sequences as the plan finds.

    ``key``: the columns that order equal lengths (all columns if None); rows alike in them may change places, which changes nothing.
    Pieces of a length are ranked in groups of about ``group_rows``, by a hash of the key, so a length that most rows have is no single task. Only the
    histogram (``room`` numbers) comes to the driver and only the plan made from it is broadcast. An empty table gives
    an empty result. Lengths outside 1 to ``room``, null among them, are an error. Columns named sequence_id and offset are replaced.
    """
    df = df.drop("sequence_id", "offset")
    rows = written(df.withColumn("_salt", F.pmod(F.xxhash64(*(key or df.columns)), F.lit(2**31)).cast("int")), "pieces")
    per = {r[0]: r[1] for r in rows.groupBy(length).agg(F.count("*")).collect()}  # one row for each length
    if any(x is None or not 1 <= x <= room for x in per):
        raise ValueError(f"a length is not between 1 and {room}")
    where = df.sparkSession.sparkContext.broadcast(places(plan({int(x): int(n) for x, n in per.items()}, room)[0]))
    groups = F.array(*[F.lit(-(-per.get(x, 0) // group_rows) or 1) for x in range(1, room + 1)])
    rows = rows.withColumn("_salt", F.col("_salt") % F.get(groups, F.col(length).cast("int") - 1))
    counts = rows.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    first = counts.select(length, "_salt", F.coalesce(F.sum("_n").over(Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*(key or df.columns)))
    # the join deals rows out as the ranks do
    ranked = rows.withColumn("_in", rank).join(first.hint("shuffle_hash"), [length, "_salt"]).withColumn("_rank", F.col("_first") + F.col("_in") - 1).drop("_first", "_in", "_salt")

    names = df.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # columns of df pass through as they are
            size, at = (np.asarray(batch.column(n)).astype(np.int64) for n in (length, "_rank"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for x in np.unique(size):
                some, runs = size == x, where.value[int(x)]
                k = np.searchsorted(runs["rank"], at[some], "right") - 1
                behind = at[some] - runs["rank"][k]
                sequence[some] = runs["sequence"][k] + behind // runs["n"][k]
                offset[some] = runs["offset"][k] + behind % runs["n"][k] * x
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = ranked.select(*names, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return ranked.mapInArrow(deal, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids) from :func:`pack` over pieces with their ids: the packed training sequences themselves."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", ids))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p[ids])).alias("ids"))
