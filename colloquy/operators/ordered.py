"""Ordered computations that no key can turn into one task.

Rows are range-partitioned by (keys, order), so a key with a third of all rows lies over as many partitions as its
size asks for. A value that runs along a key is computed inside each (key, partition) by an ordinary window, and what
comes from the partitions before is carried over by a window over one row per (key, partition).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime

PART = "__part"


class Ordered:
    """df cut into ordered parts; keys and order together must tell rows apart."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        self.keys, self.order = list(keys), list(order)
        # written, as every use must see the same parts; drawing the ranges reads df's last shuffle a second time
        self.df = runtime.stored(df.repartitionByRange(*self.keys, *self.order).withColumn(PART, F.spark_partition_id()), "ordered")

    @property
    def inside(self) -> Window:
        return Window.partitionBy(*self.keys, PART).orderBy(*self.order)

    def columns(self, **made: Made) -> Ordered:
        """df with several running columns, of which none needs another: one aggregation and one join for all."""
        along = Window.partitionBy(*self.keys).orderBy(PART)
        totals = self.df.groupBy(*self.keys, PART).agg(*[m.total(F.struct(*self.order)).alias(f"__t_{n}") for n, m in made.items()])
        carried = totals.select(*self.keys, PART, *[m.carried(F.col(f"__t_{n}"), along).alias(f"__c_{n}") for n, m in made.items()])
        own = self.df.select("*", *[m.own(self.inside).alias(f"__o_{n}") for n, m in made.items()]).join(carried, [*self.keys, PART])
        new = object.__new__(Ordered)
        new.keys, new.order = self.keys, self.order
        kept = [c for c in self.df.columns if c not in made]
        new.df = own.select(*kept, *[m.joined(F.col(f"__o_{n}"), F.col(f"__c_{n}")).alias(n) for n, m in made.items()])
        return new

    def running_sum(self, name: str, value: Column, exclusive: bool = False) -> Ordered:
        return self.columns(**{name: running_sum(value, exclusive)})

    def running_max(self, name: str, value: Column) -> Ordered:
        return self.columns(**{name: running_max(value)})

    def last_known(self, name: str, value: Column) -> Ordered:
        return self.columns(**{name: last_known(value)})

    def neighbour(self, name: str, value: Column, step: int) -> Ordered:
        return self.columns(**{name: neighbour(value, step)})

    def select(self, *cols) -> DataFrame:
        return self.df.select(*cols)


class Made(NamedTuple):
    """A running column: a part's total, what comes from the parts before (or behind), a row's own, and both together."""

    total: Callable[[Column], Column]
    carried: Callable[[Column, Window], Column]
    own: Callable[[Window], Column]
    joined: Callable[[Column, Column], Column]


def running_sum(value: Column, exclusive: bool = False) -> Made:
    """Sum of value over the rows up to this one (before it, if exclusive); nulls count 0."""
    v = F.coalesce(value, F.lit(0))
    return Made(
        lambda at: F.sum(v),
        lambda t, along: F.sum(t).over(along) - t,
        lambda inside: F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - (v if exclusive else 0),
        lambda own, carried: own + carried,
    )


def running_max(value: Column) -> Made:
    """Greatest value over the rows up to this one."""
    return Made(
        lambda at: F.max(value),
        lambda t, along: F.max(t).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        lambda inside: F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        lambda own, carried: F.when(carried.isNull() | (own > carried), own).otherwise(carried),
    )


def last_known(value: Column) -> Made:
    """The last value that is not null up to this row."""
    return Made(
        lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda t, along: F.last(t, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        lambda inside: F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        lambda own, carried: F.coalesce(own, carried),
    )


def neighbour(value: Column, step: int) -> Made:
    """struct(v) of the row before (step -1) or after (step 1), null where there is none."""
    v, near = F.struct(value.alias("v")), F.lag if step < 0 else F.lead
    return Made(
        lambda at: F.max_by(v, at) if step < 0 else F.min_by(v, at),
        lambda t, along: near(t).over(along),
        lambda inside: near(v).over(inside),
        lambda own, carried: F.coalesce(own, carried),
    )
