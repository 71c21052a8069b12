"""Searches by equality, pattern and state; contracts of records; sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import over_previous


def equal_to(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns all equal the given values; a null is wanted as None."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()), F.lit(True)))


def key_like(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose key matches, letters of either case."""
    return rows.where(F.col(key).rlike(f"(?i){pattern}"))


def listed(tasks: DataFrame, status: str | None = None, priority: str | None = None, tag: str | None = None) -> DataFrame:
    """Tasks by state, priority and tag, newest first."""
    conditions = [F.col("status") == status] * (status is not None) + [F.col("priority") == priority] * (priority is not None) + [F.array_contains("tags", tag)] * (tag is not None)
    return reduce(lambda df, c: df.where(c), conditions, tasks).orderBy(F.col("created_at").desc(), "task_id")


def texts_like(pairs: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Pairs of key and value: the key is, begins or ends with one of *keys*; key or value holds *part*, in either case."""
    key = reduce(lambda a, b: a | b, ((F.col("key") == k) | F.col("key").startswith(k) | F.col("key").endswith(k) for k in keys), F.lit(not keys))
    low = F.lit(part.lower())
    return pairs.where(key & (F.lower("key").contains(low) | F.lower("value").contains(low)))


def runnable(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """Ids of pending tasks all of whose needs are completed; a need that is no task is not. Tasks need an id.

    ``tasks``: id, status. ``needs``: id, need.
    """
    done = tasks.where("status = 'completed'").select(F.col("id").alias("need"))
    waiting = needs.where("need is not null").join(done, "need", "left_anti").select("id")
    return tasks.where("status = 'pending' and id is not null").select("id").distinct().join(waiting, "id", "left_anti")


class Field:
    """What a field must be: there, of a type, and as a test says."""

    def __init__(self, name: str, required: bool = False, cast: str | None = None, test: Callable[[Column], Column] | None = None):
        self.name, self.required, self.cast, self.test = name, required, cast, test


def violations(rows: DataFrame, key: str, contract: list[Field]) -> DataFrame:
    """``key, field, error`` for all faults of all rows: missing, type or value."""
    faults = []
    for f in contract:
        c = F.col(f.name)
        missing = c.isNull() if f.required else F.lit(False)
        wrong = c.isNotNull() & c.try_cast(f.cast).isNull() if f.cast else F.lit(False)
        bad = c.isNotNull() & ~F.coalesce(f.test(c), F.lit(False)) if f.test else F.lit(False)
        faults.append(F.when(missing, F.struct(F.lit(f.name).alias("field"), F.lit("missing").alias("error"))))
        faults.append(F.when(wrong, F.struct(F.lit(f.name).alias("field"), F.lit("type").alias("error"))).when(bad, F.struct(F.lit(f.name).alias("field"), F.lit("value").alias("error"))))
    return rows.select(key, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")).select(key, "f.field", "f.error")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """``user_id, begin, finish, events``: runs of a user's events with no pause of *gap* or longer. Events without a time are in none."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("begin"), F.max("ts").alias("finish"))
    return s.select("user_id", "begin", "finish", "events")


def seconds_to_next(events: DataFrame, key: str, at: str, ident: str, *keep: str) -> DataFrame:
    """Seconds from each event to the next of its key; null for the last. Events without a time come first."""
    e = over_previous(events.select(key, at, ident, *keep), [key], [F.col(at).desc(), F.col(ident).desc()], 1, {"following": lambda w: F.lag(at).over(w)})
    return e.select(ident, *keep, ((F.unix_millis(F.col("following").cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp"))) / 1000).alias("seconds"))


def first_category(value: Column, patterns: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The category of the first pattern that occurs."""
    return F.coalesce(*(F.when(value.rlike(p), F.lit(name)) for name, p in patterns), F.lit(otherwise))


class Registry:
    """Named operators with their descriptions."""

    def __init__(self):
        self._items: dict[str, Callable] = {}

    def register(self, name: str, function: Callable) -> None:
        if name in self._items:
            raise ValueError(f"{name} is registered already")
        self._items[name] = function

    def get(self, name: str) -> Callable:
        return self._items[name]

    def schema(self) -> dict[str, str]:
        return {name: (f.__doc__ or "").strip().split("\n")[0] for name, f in sorted(self._items.items())}
