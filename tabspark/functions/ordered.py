"""Ordered scans (number, lag, fill, running sums, folds) over keys of any size.

A plain window sends all rows of a key to one task. Here the rows of a key are first cut into
chunks of consecutive rows, scanned chunk by chunk, and what a chunk needs from its neighbours
travels as one summary row per chunk:

1. keys with about ``spark.tabspark.splitRows`` rows or more are large; in those, a row whose (key, order) hash falls
   on 0 modulo that number starts a new chunk, so cuts are the same on every evaluation and need no counting or sort;
2. the scan runs in a window over (key, chunk);
3. ``groupBy(key, chunk)`` gives the summaries (partial aggregation), a window over the few chunk
   rows of a key turns them into carries, and the carries are joined back on (key, chunk).

Without large keys, however many rows there are, the scan is the plain window, with no join. With chunks the rows are
checkpointed before each pass, so a long chain of scans neither repeats work nor grows its plan.
Orders must be total, ascending and free of nulls. Null keys are keys like others: all joins on keys are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .session import checkpoint, split_rows

CHUNK = "_chunk"
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
UP_TO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Scan(NamedTuple):
    """One scanned column: in the window, as chunk summary, as carry, and the two put together."""

    local: Callable[[WindowSpec, WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec, WindowSpec], Column]
    combine: Callable[[Column, Column], Column]
    plain: Callable[[WindowSpec, WindowSpec], Column] | None = None


def number() -> Scan:
    """1-based position in the key."""
    return Scan(
        lambda w, d: F.row_number().over(w).cast("long"),
        lambda o: F.count(F.lit(1)),
        lambda s, w, d: F.sum(s).over(w.rowsBetween(*BEFORE)),
        lambda own, c: own + F.coalesce(c, F.lit(0)),
    )


def running_sum(value: Column | str, before: bool = False) -> Scan:
    v = as_col(value)
    frame = BEFORE if before else UP_TO
    return Scan(
        lambda w, d: F.coalesce(F.sum(v).over(w.rowsBetween(*frame)), F.lit(0)),
        lambda o: F.sum(v),
        lambda s, w, d: F.sum(s).over(w.rowsBetween(*BEFORE)),
        lambda own, c: own + F.coalesce(c, F.lit(0)),
    )


def running_max(value: Column | str, before: bool = False) -> Scan:
    v = as_col(value)
    frame = BEFORE if before else UP_TO
    return Scan(
        lambda w, d: F.max(v).over(w.rowsBetween(*frame)),
        lambda o: F.max(v),
        lambda s, w, d: F.max(s).over(w.rowsBetween(*BEFORE)),
        lambda own, c: F.greatest(own, c),
    )


def later_min(value: Column | str) -> Scan:
    """Smallest value from this row to the end of the key."""
    v = as_col(value)
    return Scan(
        lambda w, d: F.min(v).over(d.rowsBetween(*UP_TO)),
        lambda o: F.min(v),
        lambda s, w, d: F.min(s).over(d.rowsBetween(*BEFORE)),
        lambda own, c: F.least(own, c),
    )


def fill(value: Column | str, before: bool = False) -> Scan:
    """Last non-null value up to this row (or strictly before it)."""
    v = as_col(value)
    frame = BEFORE if before else UP_TO
    return Scan(
        lambda w, d: F.last(v, ignorenulls=True).over(w.rowsBetween(*frame)),
        lambda o: F.max_by(v, F.when(v.isNotNull(), o)),
        lambda s, w, d: F.last(s, ignorenulls=True).over(w.rowsBetween(*BEFORE)),
        lambda own, c: F.coalesce(own, c),
    )


def fill_back(value: Column | str, after: bool = False) -> Scan:
    """First non-null value from this row on (or strictly after it)."""
    v = as_col(value)
    frame = BEFORE if after else UP_TO
    return Scan(
        lambda w, d: F.last(v, ignorenulls=True).over(d.rowsBetween(*frame)),
        lambda o: F.min_by(v, F.when(v.isNotNull(), o)),
        lambda s, w, d: F.last(s, ignorenulls=True).over(d.rowsBetween(*BEFORE)),
        lambda own, c: F.coalesce(own, c),
    )


def lag(value: Column | str) -> Scan:
    v = as_col(value)
    boxed = F.struct(v.alias("v"))
    return Scan(
        lambda w, d: F.lag(boxed).over(w),
        lambda o: F.max_by(boxed, o),
        lambda s, w, d: F.lag(s).over(w),
        lambda own, c: F.coalesce(own, c)["v"],
        lambda w, d: F.lag(v).over(w),
    )


def lead(value: Column | str) -> Scan:
    v = as_col(value)
    boxed = F.struct(v.alias("v"))
    return Scan(
        lambda w, d: F.lead(boxed).over(w),
        lambda o: F.min_by(boxed, o),
        lambda s, w, d: F.lead(s).over(w),
        lambda own, c: F.coalesce(own, c)["v"],
        lambda w, d: F.lead(v).over(w),
    )


def _total(f: Callable[[Column], Column], again: Callable[[Column], Column], v: Column) -> Scan:
    return Scan(
        lambda w, d: F.lit(None),
        lambda o: f(v),
        lambda s, w, d: again(s).over(w.rowsBetween(*ALL)),
        lambda own, c: c,
        lambda w, d: f(v).over(w.rowsBetween(*ALL)),
    )


def total_sum(value: Column | str) -> Scan:
    return _total(F.sum, F.sum, as_col(value))


def total_count() -> Scan:
    return _total(F.count, F.sum, F.lit(1))


def total_max(value: Column | str) -> Scan:
    return _total(F.max, F.max, as_col(value))


def total_min(value: Column | str) -> Scan:
    return _total(F.min, F.min, as_col(value))


State = list[float]
Step = Callable[[dict[str, np.ndarray], State], tuple[dict[str, object], State]]
Exits = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]


class Ordered:
    """The rows of ``df`` in a total order inside each key, cut into chunks where a key is large."""

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame | None = None
    ) -> None:
        self._df, self.keys, self.order, self.cuts = df, list(keys), list(order), cuts

    @property
    def chunked(self) -> bool:
        return self.cuts is not None

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else self.keys

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Row-wise change that leaves the keys and the order columns as they are."""
        return Ordered(change(self._df), self.keys, self.order, self.cuts)

    def with_columns(self, **columns: Column) -> Ordered:
        return self.map(lambda df: df.withColumns(columns))

    def _order_struct(self) -> Column:
        return F.struct(*self.order)

    def refine(self, more: Sequence[str], order: Sequence[str]) -> Ordered:
        """The same rows under finer keys: when no key was large, no finer key is."""
        return ordered(self.df, [*self.keys, *more], order, like=self)

    def ranged(self, low: float, high: float, **values: str) -> DataFrame:
        """Aggregates (SQL text) of the rows whose first order column lies in [own + low, own + high], low <= 0 <= high.

        In chunked keys a row also visits the chunks whose frames reach it.
        """
        pos = self.order[0]
        if not self.chunked:
            return self._df.withColumns(_range_frame(values, self.keys, pos, low, high))
        at = F.col(pos)
        spots = F.transform("_cuts", lambda c: c[pos])
        visits = meet(self._df.drop(CHUNK), self.cuts, self.keys, "left").withColumn("_spots", spots)
        home = cuts_up_to(F.col("_cuts"), self._order_struct())
        first = cuts_up_to(F.col("_spots"), at - high, strict=True)
        last = cuts_up_to(F.col("_spots"), at - low)
        visits = visits.withColumn("_home", home).withColumn(
            CHUNK, F.explode(F.sequence(F.least(first, home), F.greatest(last, home)))
        )
        out = visits.drop("_cuts", "_spots").withColumns(_range_frame(values, self.parts, pos, low, high))
        return out.where(F.col("_home") == F.col(CHUNK)).drop("_home", CHUNK)

    def add(self, **scans: Scan) -> Ordered:
        """New columns, all from one pass over the rows."""
        up = Window.partitionBy(*self.parts).orderBy(*self.order)
        down = Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() for c in self.order])
        if not self.chunked:
            added = {name: (s.plain or s.local)(up, down) for name, s in scans.items()}
            return self.map(lambda df: df.withColumns(added))
        rows = checkpoint(self._df)  # read twice: for the summaries and for the scan itself
        by_chunk = Window.partitionBy(*self.keys).orderBy(CHUNK)
        back = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc())
        sums = rows.groupBy(*self.parts).agg(
            *[s.summary(self._order_struct()).alias(f"_s_{name}") for name, s in scans.items()]
        )
        carries = sums.select(
            *self.parts,
            *[s.carry(F.col(f"_s_{name}"), by_chunk, back).alias(f"_c_{name}") for name, s in scans.items()],
        )
        local = rows.withColumns({name: s.local(up, down) for name, s in scans.items()})
        joined = meet(local, carries, self.parts).withColumns(
            {name: s.combine(F.col(name), F.col(f"_c_{name}")) for name, s in scans.items()}
        )
        return Ordered(joined.drop(*[f"_c_{name}" for name in scans]), self.keys, self.order, self.cuts)

    def lags(self, prefix: str, value: str, most: int) -> Ordered:
        """The values 1 to ``most`` rows before, as ``prefix1`` and so on; one pass where no key is cut."""
        if not self.chunked:
            up = Window.partitionBy(*self.keys).orderBy(*self.order)
            return self.with_columns(**{f"{prefix}{k}": F.lag(value, k).over(up) for k in range(1, most + 1)})
        rows = self
        for k in range(1, most + 1):
            rows = rows.add(**{f"{prefix}{k}": lag(value if k == 1 else f"{prefix}{k - 1}")})
        return rows

    def islands(self, name: str, starts: Column) -> Ordered:
        """Number of the run each row is in; a run begins where ``starts`` holds."""
        return self.add(**{name: running_sum(F.when(starts, 1).otherwise(0).cast("long"))})

    def fold(self, step: Step, outputs: str, init: State) -> Ordered:
        """Columns from a state machine over the rows of each key.

        ``step(columns, state)`` gets a run of consecutive rows as arrays and gives the output
        columns and the state after them; it must not depend on where the runs are cut. In chunked
        keys every chunk starts from ``init`` first; chunks whose true entry state turns out to
        differ are run again until no entry state changes, so the result is that of one pass.
        """
        rows = self._df
        if self.chunked:
            rows = checkpoint(rows)  # read once a round, and for the result
            rows = meet(rows, self._entries(rows, step, init), self.parts)
        return self._stepped(rows, step, outputs, init)

    def walk(self, exits: Exits, step: Step, outputs: str, states: int, init: int = 0) -> Ordered:
        """``fold`` for machines whose one state is a number below ``states``: two passes, however chunks depend on each other.

        ``exits(columns, states)`` gives the states after a run of rows for an array of states before it. A chunk is
        summed up as the map from every entry state to its exit. Maps compose: those of a key's chunks, applied in
        order, give the true entry states, from which the rows are walked once.
        """
        if not self.chunked:
            return self._stepped(self._df, step, outputs, [float(init)])
        rows = checkpoint(self._df)  # read for the maps and for the result
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        parts = ", ".join(f"`{c}` {types[c]}" for c in self.parts)
        keyed = rows.repartition(*self.parts).sortWithinPartitions(*self.parts, *self.order)
        maps = keyed.mapInPandas(_map_runner(self.parts, exits, states), f"{parts}, _map array<int>")
        by_key = maps.repartition(*self.keys).sortWithinPartitions(*self.keys, CHUNK)
        entries = by_key.mapInPandas(_compose_runner(self.keys, self.parts, init), f"{parts}, _entry array<double>")
        return self._stepped(meet(rows, entries, self.parts), step, outputs, [float(init)])

    def _stepped(self, rows: DataFrame, step: Step, outputs: str, init: State) -> Ordered:
        fields = [f.name for f in _fields(self._df.sparkSession, outputs)]
        columns = [c for c in self._df.columns]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self._df.schema.fields), outputs])
        keyed = rows.repartition(*self.parts).sortWithinPartitions(*self.parts, *self.order)
        out = keyed.mapInPandas(_runner(self.parts, columns, fields, step, init, self.chunked), schema)
        return Ordered(out, self.keys, self.order, self.cuts)

    def _entries(self, data: DataFrame, step: Step, init: State) -> DataFrame:
        start = F.array(*[F.lit(float(v)) for v in init]).cast("array<double>")
        before = Window.partitionBy(*self.keys).orderBy(CHUNK)

        def exits(rows: DataFrame) -> DataFrame:
            keyed = rows.repartition(*self.parts).sortWithinPartitions(*self.parts, *self.order)
            types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
            schema = ", ".join([*(f"`{c}` {types[c]}" for c in self.parts), "_exit array<double>"])
            return keyed.mapInPandas(_exit_runner(self.parts, step), schema)

        first = data.withColumn("_entry", start)
        known = checkpoint(exits(first).withColumn("_used", start))
        while True:
            entry = F.coalesce(F.lag("_exit").over(before), start)
            now = known.withColumn("_entry", entry)
            stale = now.where(F.col("_entry") != F.col("_used")).select(*self.parts, "_entry")
            if stale.isEmpty():
                return now.select(*self.parts, "_entry")
            again = meet(exits(meet(data, stale, self.parts)), stale.withColumnRenamed("_entry", "_used"), self.parts)
            known = checkpoint(meet(known, stale.select(*self.parts), self.parts, "left_anti").unionByName(again))


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where nulls are equal; the keys come out once."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, same), how).drop(*[f"_of_{k}" for k in keys])


def _range_frame(values: dict[str, str], parts: list[str], pos: str, low: float, high: float) -> dict[str, Column]:
    def bound(v: float) -> str:
        return f"{abs(v)}D" if isinstance(v, float) else str(abs(v))

    by = ", ".join(f"`{p}`" for p in parts)
    frame = f"range between {bound(low)} preceding and {bound(high)} following"
    return {name: F.expr(f"{v} over (partition by {by} order by `{pos}` {frame})") for name, v in values.items()}


def _fields(spark, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def segments(pdf: pd.DataFrame, parts: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of each run of equal keys in a batch."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    arrays = [pdf[p].to_numpy() for p in parts]
    for values in arrays:
        null = pd.isna(values)
        change[1:] |= (values[1:] != values[:-1]) & ~(null[1:] & null[:-1])
    cuts = np.flatnonzero(change)
    for begin, end in zip(cuts, [*cuts[1:], len(pdf)]):
        yield tuple(None if pd.isna(values[begin]) else values[begin] for values in arrays), begin, end


def _runner(parts, columns, outputs, step, init, chunked):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, list(init)
        for pdf in batches:
            if pdf.empty:
                continue
            arrays = {c: pdf[c].to_numpy() for c in columns}
            made: dict[str, list] = {name: [] for name in outputs}
            for key, begin, end in segments(pdf, parts):
                if key != current:
                    current = key
                    state = list(pdf["_entry"].iat[begin]) if chunked else list(init)
                got, state = step({c: a[begin:end] for c, a in arrays.items()}, state)
                for name in outputs:
                    made[name].extend(got[name])
            result = pdf[columns].copy(deep=False)
            for name in outputs:
                result[name] = pd.Series(made[name], index=pdf.index)
            yield result

    return run


def _exit_runner(parts, step):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        done: list[tuple] = []
        for pdf in batches:
            if pdf.empty:
                continue
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns if c != "_entry"}
            for key, begin, end in segments(pdf, parts):
                if key != current:
                    if current is not None:
                        done.append((*current, [float(v) for v in state]))
                    current, state = key, list(pdf["_entry"].iat[begin])
                _, state = step({c: a[begin:end] for c, a in arrays.items()}, state)
            if done:
                yield pd.DataFrame(done, columns=[*parts, "_exit"])
                done = []
        if current is not None:
            yield pd.DataFrame([(*current, [float(v) for v in state])], columns=[*parts, "_exit"])

    return run


def _map_runner(parts, exits, states):
    """The map of each chunk: its exit for every entry state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reached = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
            done: list[tuple] = []
            for key, begin, end in segments(pdf, parts):
                if key != current:
                    if current is not None:
                        done.append((*current, reached.tolist()))
                    current, reached = key, np.arange(states)
                reached = exits({c: a[begin:end] for c, a in arrays.items()}, reached)
            if done:
                yield pd.DataFrame(done, columns=[*parts, "_map"])
        if current is not None:
            yield pd.DataFrame([(*current, reached.tolist())], columns=[*parts, "_map"])

    return run


def _compose_runner(keys, parts, init):
    """The entry state of each chunk of a key, whose maps come in order; only the state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, init
        for pdf in batches:
            if pdf.empty:
                continue
            entries = []
            for key, begin, end in segments(pdf, keys):
                if key != current:
                    current, state = key, init
                for k in range(begin, end):
                    entries.append([float(state)])
                    state = int(pdf["_map"].iat[k][state])
            result = pdf[parts].copy(deep=False)
            result["_entry"] = pd.Series(entries, index=pdf.index)
            yield result

    return run


LOOKED_AT = 16  # rows of a chunk that are looked at to tell large keys


def large_keys(df: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """Keys with about ``every`` rows or more, from a share of the rows; only the key columns are read for it."""
    share = min(1.0, LOOKED_AT / every)
    seen = df.select(*keys).sample(share, seed=0).groupBy(*keys).agg(F.count("*").alias("_n"))
    return seen.where(F.col("_n") >= share * every).select(*keys)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], like: Ordered | None = None) -> Ordered:
    """Rows ready for scans; large keys are cut into chunks of consecutive rows.

    ``like``: rows already looked at, of which ``df`` holds no more per key. When they had no large key, the
    sampling pass over ``df`` is left out.
    """
    keys, order = list(keys), list(order)
    if like is not None and not like.chunked and set(like.keys) <= set(keys):
        return Ordered(df, keys, order)
    every = split_rows(df.sparkSession)
    large = large_keys(df, keys, every)
    if large.isEmpty():
        return Ordered(df, keys, order)
    sampled = F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0
    cuts = df.where(sampled).select(*keys, F.struct(*order).alias("_cut"))
    cuts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))
    # Stored: the look at the keys need not find the same ones twice, and every pass over the rows reads the cuts.
    per_key = checkpoint(meet(cuts, large, keys, "left_semi"))
    if per_key.isEmpty():
        return Ordered(df, keys, order)
    place = cuts_up_to(F.col("_cuts"), F.struct(*order))
    chunked = meet(df, per_key, keys, "left").withColumn(CHUNK, place).drop("_cuts")
    return Ordered(chunked, keys, order, per_key)


def gathered(df: DataFrame, keys: Sequence[str], like: Ordered | None) -> DataFrame:
    """Rows of a key brought together once: scans, groups and joins by these and further keys then need no shuffle of their own.

    Only where ``like`` knows that no key is large; else the rows stay as they are.
    """
    return df if like is None or like.chunked or not set(like.keys) <= set(keys) else df.repartition(*keys)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a null among their keys: those a join on the keys would keep."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def cuts_up_to(cuts: Column, value: Column, strict: bool = False) -> Column:
    """How many of the sorted ``cuts`` are not after (``strict``: are before) ``value``, by binary search."""
    powers = F.array(*[F.lit(1 << b) for b in range(23, -1, -1)])
    found = F.aggregate(
        powers,
        F.lit(0),
        lambda low, power: F.when(
            F.get(cuts, low + power - 1) < value if strict else F.get(cuts, low + power - 1) <= value, low + power
        ).otherwise(low),
    )
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)
