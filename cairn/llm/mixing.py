"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's rows form blocks. With weights as integers a_i that add up to a
period D, block j (from 1) of a source may start at floor((j-1) D / a_i) and
must be placed by ceil(j D / a_i); earliest deadline first among the released
blocks fills every slot, and after t slots a source has t a_i / D blocks,
give or take less than one. The integers stand for the weights exactly, so D
may have any length. The order repeats with the period: what is dealt and kept
as a table is one period or, where that is longer than the mix, the mix, one
entry for each block.
"""

from __future__ import annotations

import heapq
import json
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import gapless, hash60

#: Sources that may have a weight, at most.
SOURCES = 1000
#: Slots of a source in one row of the table, and up to which the table is broadcast.
CHUNK, BROADCAST_SLOTS = 64, 1 << 22
PHASES = "array<struct<source: string, phases: array<struct<phase: int, first: bigint, last: bigint, base: bigint, period: bigint, quota: bigint, chunk: bigint>>>>"


def quotas(weights: Mapping[str, float], period: int | None = None) -> dict[str, int]:
    """Weights as the least integers in the same ratio, or those that add up
    to `period`. A weight is what its decimal digits say: nothing is rounded.
    Sources of no weight get no quota."""
    live = {s: Fraction(str(w)) for s, w in sorted(weights.items()) if w > 0}
    if not live:
        return {}
    unit = math.lcm(*(w.denominator for w in live.values()))
    out = _least({s: int(w * unit) for s, w in live.items()})
    times, rest = divmod(period or sum(out.values()), sum(out.values()))
    if rest:
        raise ValueError(f"weights are not multiples of 1/{period}")
    return {s: a * times for s, a in out.items()}


def _least(quota: Mapping[str, int]) -> dict[str, int]:
    common = math.gcd(*quota.values())
    return {s: a // common for s, a in quota.items()}


def dealt(quota: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first."""
    period, done, t = sum(quota.values()), dict.fromkeys(quota, 0), 0
    waiting, ready = [(0, s) for s in sorted(quota)], []
    while True:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // quota[s]), s))
        s = heapq.heappop(ready)[1]
        done[s] += 1
        heapq.heappush(waiting, (done[s] * period // quota[s], s))
        t += 1
        yield s


def one_period(quota: Mapping[str, int]) -> list[str]:
    """The source of each slot of a period."""
    return list(islice(dealt(quota), sum(quota.values())))


def timetable(quota: Mapping[str, int], blocks: Mapping[str, int]) -> tuple[dict[str, list[dict]], int]:
    """Phases of each source and the number of slots. A phase ends where the
    order asks for a source that has no block left; the others go on, their
    weights in the same ratio, in the next. So every block has a slot. `slots`
    are a source's places in a period, or in the phase where that is shorter."""
    left = {s: n for s, n in blocks.items() if n > 0 and s in quota}
    used, base, phase, out = dict.fromkeys(left, 0), 0, 0, {s: [] for s in left}
    while left:
        live = _least({s: quota[s] for s in sorted(left)})
        period, whole = sum(live.values()), min(left[s] // a for s, a in live.items())
        given = {s: whole * a for s, a in live.items()}
        length, places = whole * period, {s: array("q") for s in live}
        ended = all(given[s] == left[s] for s in live)
        for t, s in enumerate(dealt(live)):
            ended = ended or given[s] == left[s]
            if t == period or (ended and not whole):
                break
            if not ended:
                given[s] += 1
                length += 1
            places[s].append(t)
        for s in live:
            out[s].append(
                {"phase": phase, "first": used[s], "last": used[s] + given[s], "base": base, "period": period if whole else 0, "quota": max(1, len(places[s])), "slots": places[s]}
            )
            used[s] += given[s]
            left[s] -= given[s]
        base, phase = base + length, phase + 1
        left = {s: n for s, n in left.items() if n}
    return out, base


def tempered(counts: Mapping[str, int], alpha: float) -> dict[str, float]:
    """Target weights that follow the sources' sizes to the power `alpha`."""
    return {s: n**alpha for s, n in counts.items()}


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = 16,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """`docs` with `mix_block` (of the row's source), `mix_phase`, `mix_slot`
    (of the block in the mix) and `mix_position` (of the row, from 0 without
    gaps). All rows are returned.

    `weights` gives the target share of each source; None means its number of
    rows to the power `alpha`. At most `SOURCES` sources may have a weight. A
    source of no weight, with null sources, comes after the mix and has a null
    phase. Rows of a source follow the hash of the id, then the id; rows that
    share an id may swap. When a source ends, the others keep their ratio. Null
    sources count as one source, null ids as one id. An empty table gives no
    rows. Columns of these four names in `docs` are replaced.

    A source may hold any share of the rows: numbering works in blocks of its
    hash range. The driver sees one count for each source that has a weight,
    and deals one slot for each block of a period or, if less, of the table.
    """
    added = ["mix_block", "mix_phase", "mix_slot", "mix_position"]
    keep = [c for c in docs.columns if c not in added]
    named = F.col(source_col).cast("string")
    if weights is not None:
        named = F.when(named.isin([s for s, w in weights.items() if w > 0]), named)
    # one column holds those of `docs`, so that no name can clash
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])
    rows = docs.select(row.alias("_row"), named.alias("_source"), hash60(F.col(id_col)).alias("_h"), F.col(id_col).alias("_id"))
    tally = rows.groupBy("_source").count().limit(SOURCES + 2).collect()
    sizes = {r["_source"]: r["count"] for r in tally}
    rest = sizes.pop(None, 0)
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: give weights")
    quota = quotas(tempered(sizes, alpha) if weights is None else {s: w for s, w in weights.items() if s in sizes})
    phases, slots = timetable(quota, {s: -(-n // block_rows) for s, n in sizes.items()})

    rows = gapless(rows, "_source", ["_h", "_id"], "_index")
    rows = rows.withColumn("mix_block", F.floor(F.col("_index") / block_rows).cast("long"))
    places = _chunks(phases)
    table = json.dumps([{"source": s, "phases": [{k: v for k, v in p.items() if k != "slots"} for p in own]} for s, own in phases.items()])
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), PHASES)))
    plan = plan.select(F.col("source").alias("_s"), "phases")
    rows = rows.join(F.broadcast(plan), F.col("_source") == F.col("_s"), "left")
    mine = F.filter("phases", lambda p: (F.col("mix_block") >= p["first"]) & (F.col("mix_block") < p["last"]))[0]
    rows = rows.withColumn("_p", mine)
    local = F.col("mix_block") - F.col("_p.first")
    rows = rows.withColumn("_k", local % F.col("_p.quota"))
    chunk = F.col("_p.chunk") + F.floor(F.col("_k") / CHUNK).cast("long")
    rows = rows.withColumn("_chunk", F.coalesce(chunk, -1 - F.col("mix_block")))  # blocks after the mix have none
    kept = docs.sparkSession.createDataFrame(places)
    rows = rows.join(F.broadcast(kept) if len(places) * CHUNK <= BROADCAST_SLOTS else kept, "_chunk", "left")
    slot = F.col("_p.base") + F.floor(local / F.col("_p.quota")).cast("long") * F.col("_p.period") + F.element_at("_slots", (F.col("_k") % CHUNK + 1).cast("int"))
    rows = rows.withColumn("mix_phase", F.col("_p.phase")).withColumn("mix_slot", F.coalesce(slot, F.lit(slots) + F.col("mix_block")))
    position = F.col("mix_slot") * block_rows + F.col("_index") % block_rows - _gaps(phases, sizes, block_rows, F.col("mix_slot"))
    return rows.withColumn("mix_position", position).select(*[F.col("_row").getField(c).alias(c) for c in keep], *added)


def _chunks(phases: Mapping[str, list[dict]]) -> pa.Table:
    """The slots of all phases in rows of at most `CHUNK`, numbered; sets the
    number of each phase's first row as its `chunk`."""
    values, offsets = array("q"), array("i", [0])
    for p in (p for own in phases.values() for p in own):
        p["chunk"] = len(offsets) - 1
        for k in range(0, len(p["slots"]), CHUNK):
            values.extend(p["slots"][k : k + CHUNK])
            offsets.append(len(values))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
    return pa.table({"_chunk": pa.array(range(len(lists)), pa.int64()), "_slots": lists})


def _gaps(phases: Mapping[str, list[dict]], sizes: Mapping[str, int], block_rows: int, slot: Column) -> Column:
    """Rows missing from blocks before `slot`: only a source's last block can
    be short, so there is one entry for each source at most."""
    short = []
    for s, own in phases.items():
        missing = -sizes[s] % block_rows
        if missing:
            p = next(p for p in reversed(own) if p["last"] > p["first"])
            k = p["last"] - 1 - p["first"]
            short.append((p["base"] + k // p["quota"] * p["period"] + p["slots"][k % p["quota"]], missing))
    if not short:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"s": s, "n": n} for s, n in short])), "array<struct<s: bigint, n: bigint>>")
    return F.aggregate(F.filter(table, lambda x: x["s"] < slot), F.lit(0).cast("long"), lambda a, x: a + x["n"])
