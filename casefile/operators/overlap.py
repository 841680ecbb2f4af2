"""The turn that overlaps each segment most, found without the pairs of those that overlap.

What a turn b shares with a segment a is the least of four lengths, so the best turn is the best of four kinds: of the turns that
hold a, the first; of those inside a, the longest; of those that begin before a, the one that ends last; of those that end
after a, the one that begins last before its end's begin. Each kind is a search among sorted rows. A long recording is cut into
stretches; a row goes to the stretches of its begin and its end, where it meets all rows that begin or end there. Turns that share no
stretch with a segment lie before, behind, around or inside it by whole stretches, so four turns for each pair of stretches
stand for all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a stretch, about; stretches of a recording at most (a power of two). Beyond FEW * MOST rows of one recording stretches grow.
FEW, MOST = 8_192, 1_024


def _best_before(first: np.ndarray, second: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the greatest ``value`` (-1: none) of the rows before it in both orders (places from 0 to n - 1, each once).

    Halves of ever larger stretches of the first order meet: what is in the left one is before what is in the right one, so a
    running maximum along the second order tells the rest."""
    n, along = len(first), np.argsort(second)
    best, wide = np.full(n, -1, np.int64), int(value.max(initial=0)) + 2
    for k in range(max(n - 1, 0).bit_length()):
        whole, right = first >> (k + 1), (first >> k) & 1
        o = along[np.argsort(whole[along], kind="stable")]
        lift = whole[o] * wide
        so_far = np.maximum.accumulate(np.where(right[o] == 0, value[o], -1) + lift) - lift
        best[o] = np.where(right[o] == 1, np.maximum(best[o], so_far), best[o])
    return best


def _places(*keys: np.ndarray) -> np.ndarray:
    """Each row's place in the order of the keys, the first counts most."""
    place = np.empty(len(keys[0]), np.int64)
    place[np.lexsort(keys[::-1])] = np.arange(len(place))
    return place


def _candidates(low: np.ndarray, high: np.ndarray, strict: np.ndarray, d: pd.DataFrame) -> list[np.ndarray]:
    """For each row of ``d`` (turn, start, end, nth) four rows of turns, -1 for none; ``low`` and ``high`` are where rows lie. A segment that is
    ``strict`` shares nothing with turns that touch its ends."""
    turn, nth = d["turn"].to_numpy(), d["nth"].to_numpy()
    start, end = d["start"].to_numpy(), d["end"].to_numpy()
    size = end - start
    whole = turn & (size >= 0)
    a_first, a_last = np.where(turn, 1, np.where(strict, 0, 2)), np.where(turn, 1, np.where(strict, 2, 0))
    from_low, from_high = _places(low, a_first), _places(-high, 2 - a_last)
    of = {}
    for name, rows, keys in (("held", whole, (nth,)), ("inside", turn, (-size, nth)), ("ends", whole, (-end, nth)), ("begins", whole, (start, nth))):
        place = len(turn) - 1 - _places(*keys)
        at = np.empty(len(turn), np.int64)
        at[place] = np.arange(len(turn))
        of[name] = np.where(rows, place, -1), at
    last = len(turn) - 1
    after_low = _places(-low, np.where(turn, 1, 0))
    before_high = _places(high, np.where(turn, 1, 0))

    def running(order: np.ndarray, value: np.ndarray) -> np.ndarray:
        o = np.argsort(order)
        out = np.empty(last + 1, np.int64)
        out[o] = np.maximum.accumulate(value[o])
        return out

    found = {
        "held": _best_before(from_low, from_high, of["held"][0]),
        "inside": _best_before(after_low, before_high, of["inside"][0]),
        "ends": running(from_low, of["ends"][0]),
        "begins": running(from_high, of["begins"][0]),
    }
    return [np.where(v >= 0, of[name][1][v], -1) for name, v in found.items()]


FOUND = ["nth", "overlap", "r_nth", "r_what"]


def _shared(d: pd.DataFrame, by: str) -> pd.DataFrame:
    """The best turn of each segment among the rows of one stretch."""
    start, end, turn = d["start"].to_numpy(), d["end"].to_numpy(), d["turn"].to_numpy()
    rows = _candidates(np.minimum(start, end), np.maximum(start, end), end <= start, d)
    segments = np.flatnonzero(~turn)
    best, overlap, nth = np.full(len(segments), -1), np.full(len(segments), -np.inf), d["nth"].to_numpy()
    a, b = start[segments], end[segments]
    for r in (c[segments] for c in rows):
        with np.errstate(invalid="ignore"):
            o = np.minimum(b, end[r]) - np.maximum(a, start[r])
        better = (r >= 0) & (start[r] < b) & (end[r] > a) & ((best < 0) | (o > overlap) | ((o == overlap) & (nth[r] < nth[best])))
        best, overlap = np.where(better, r, best), np.where(better, o, overlap)
    met = best >= 0
    own, other = d.iloc[segments[met]], d.iloc[best[met]]
    return pd.DataFrame({by: own[by].to_numpy(), "nth": own["nth"].to_numpy(), "overlap": overlap[met], "r_nth": other["nth"].to_numpy(), "r_what": other["what"].to_numpy()})


def _across(d: pd.DataFrame, by: str) -> pd.DataFrame:
    """For each pair of stretches that segments lie in, the turns that lie apart from both, four at most."""
    out = []
    segments = np.flatnonzero(~d["turn"].to_numpy())
    for c in _candidates(d["p"].to_numpy(), d["q"].to_numpy(), np.ones(len(d), bool), d):
        some = segments[c[segments] >= 0]
        own, other = d.iloc[some], d.iloc[c[some]]
        out.append(pd.DataFrame({by: own[by].to_numpy(), "p": own["p"].to_numpy(), "q": own["q"].to_numpy(), "r_start": other["start"].to_numpy(), "r_end": other["end"].to_numpy(), "r_nth": other["nth"].to_numpy(), "r_what": other["what"].to_numpy()}))
    return pd.concat(out)


def _placed(rows: DataFrame, by: str) -> DataFrame:
    """Rows with p and q, the stretches of their begin and end. Bounds are one number for about FEW rows, so they suit a broadcast."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    long = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW)
    marks = rows.select(by, F.explode(F.array(low, high)).alias("_v")).join(F.broadcast(long), by)
    parts = F.least(F.lit(MOST), F.ceil(F.col("_n") / FEW)).cast("int")
    cuts = marks.groupBy(by, "_n").agg(F.percentile_approx("_v", [k / MOST for k in range(1, MOST)], 10 * MOST).alias("_c"))
    cuts = cuts.select(by, F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.element_at("_c", F.floor(k * MOST / parts).cast("int")))).alias("_cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST.bit_length() - 1))])

    def at(v: Column) -> Column:
        """How many bounds are not over a value."""
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) <= v, n + step).otherwise(n))

    return rows.join(F.broadcast(cuts), by, "left").withColumns({"p": at(low), "q": at(high)}).drop("_cuts")


def most_overlapping(segments: DataFrame, turns: DataFrame, by: str, nth: str, what: str) -> DataFrame:
    """``by``, ``nth`` and r_what: for each segment (by, nth, start, end) that any turn (also with ``what``) overlaps, what of the turn that
    overlaps it most, of the smallest nth at ties. Rows are copied to two stretches at most, however many overlap."""
    times = [F.col(c).cast("double").alias(c) for c in ("start", "end")]
    side = lambda df, turn: df.select(by, F.col(nth).alias("nth"), *times, F.lit(turn).alias("turn"), (F.col(what) if turn else F.lit(None).cast(turns.schema[what].dataType)).alias("what")).dropna(subset=[by, "nth", "start", "end"])
    rows = _placed(side(segments, False).unionByName(side(turns, True)), by)
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    key, whats = f"`{by}` {kind[by]}", f"r_nth {kind['nth']}, r_what {kind['what']}"
    near = rows.withColumn("at", F.explode(F.array_distinct(F.array("p", "q")))).drop("p", "q").groupBy(by, "at").applyInPandas(lambda d: _shared(d, by), f"{key}, nth {kind['nth']}, overlap double, {whats}")
    one = F.struct("start", "end", "nth", "what")
    whole = F.col("end") >= F.col("start")
    best = lambda order, where=None: F.max_by(one if where is None else F.when(where, one), order if where is None else F.when(where, order))
    ends = [best(-F.col("nth"), whole), best(F.struct(F.col("end") - F.col("start"), -F.col("nth"))), best(F.struct("end", -F.col("nth")), whole), best(F.struct(-F.col("start"), -F.col("nth")), whole)]
    stand = rows.filter("turn").groupBy(by, "p", "q").agg(F.array_distinct(F.array_compact(F.array(*ends))).alias("s")).select(by, "p", "q", F.explode("s").alias("s")).select(by, "p", "q", "s.*", F.lit(True).alias("turn"))
    own = rows.filter("not turn")
    asked = own.select(by, "p", "q").distinct().select(by, "p", "q", *[F.lit(0).cast(kind[c]).alias(c) for c in ("start", "end", "nth")], F.lit(None).cast(kind["what"]).alias("what"), F.lit(False).alias("turn"))
    long = rows.filter("p > 0 or q > 0").select(by).distinct()
    far = stand.unionByName(asked).join(long, by, "left_semi").groupBy(by).applyInPandas(lambda d: _across(d, by), f"{key}, p int, q int, r_start double, r_end double, {whats}")
    met = own.join(far, [by, "p", "q"]).filter("r_start < end and r_end > start")
    met = met.select(by, "nth", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("overlap"), "r_nth", "r_what")
    found = near.unionByName(met).groupBy(by, "nth").agg(F.max_by("r_what", F.struct("overlap", -F.col("r_nth"))).alias("r_what"))
    return found.select(by, F.col("nth").alias(nth), "r_what")
