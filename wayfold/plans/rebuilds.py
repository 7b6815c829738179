"""Outputs rebuilt in the order of what they are made from, and held against what their inputs give now.

Outputs are views (``views.View``) kept in a store (``sources.commits.Store``): an output and the
stamp of what it was made from become visible with one manifest, so a rebuild that is killed
leaves the output that was there. The driver only starts Spark jobs and compares stamps.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial
from graphlib import CycleError, TopologicalSorter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Store
from .views import View, stamp

# What becomes of a step.
DONE, WARNED, CURRENT, FAILED, BLOCKED = "done", "warned", "current", "failed", "blocked"


@dataclass(frozen=True)
class Step:
    """Work with a name: what it comes after, why it is needed now (null: it is not), and warnings that it returns."""

    name: str
    run: Callable[[], list[str] | None]
    after: tuple[str, ...] = ()
    needed: Callable[[], str | None] = lambda: "always"


@dataclass(frozen=True)
class Outcome:
    """What became of a step, and what is to be said of it: its reason, warnings, error, or what held it up."""

    state: str
    said: str = ""


def checked(steps: list[Step]) -> dict[str, Step]:
    """Steps by name; ValueError for a name given twice, a step after one that is not there, and a cycle."""
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps):
        names = [s.name for s in steps]
        raise ValueError(f"steps given twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    if unknown := sorted({a for s in steps for a in s.after if a not in by_name}):
        raise ValueError(f"no such steps: {', '.join(unknown)}")
    try:
        TopologicalSorter({s.name: s.after for s in steps}).prepare()
    except CycleError as e:
        raise ValueError(f"steps wait for each other: {' <- '.join(e.args[1])}") from e
    return by_name


def attempt(step: Step) -> Outcome:
    """Run a step if it is needed; whatever it raises fails it."""
    try:
        why = step.needed()
        if why is None:
            return Outcome(CURRENT)
        warnings = step.run()
        return Outcome(WARNED, "; ".join(warnings)) if warnings else Outcome(DONE, why)
    except Exception as e:
        return Outcome(FAILED, f"{type(e).__name__}: {e}")


def run(spark: SparkSession, steps: list[Step], at_once: int = 4) -> dict[str, Outcome]:
    """Run steps, ``at_once`` of those that nothing holds up at the same time; outcomes in the order given.

    A step that fails blocks those after it, and no other.
    """
    by_name = checked(steps)
    waiting, done, running = TopologicalSorter({s.name: s.after for s in steps}), {}, {}
    waiting.prepare()
    with ThreadPoolExecutor(at_once) as pool:
        while waiting.is_active():
            for name in waiting.get_ready():
                lost = [a for a in by_name[name].after if done[a].state in (FAILED, BLOCKED)]
                if lost:
                    done[name] = Outcome(BLOCKED, f"after {', '.join(lost)}")
                    waiting.done(name)
                else:
                    running[pool.submit(inheritable_thread_target(spark)(attempt), by_name[name])] = name
            ended = wait(running, return_when=FIRST_COMPLETED).done if running else ()
            for future in ended:
                name = running.pop(future)
                done[name] = future.result()
                waiting.done(name)
    return {s.name: done[s.name] for s in steps}


def row_differences(published: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``n_published`` and ``n_rebuilt``; order doesn't count.

    Nulls are equal to each other. Rows are counted before they are shuffled, so many copies of one row are no hot group.
    """
    sides = (F.lit(1).alias("__published"), F.lit(0).alias("__rebuilt")), (F.lit(0).alias("__published"), F.lit(1).alias("__rebuilt"))
    both = published.select("*", *sides[0]).unionByName(rebuilt.select("*", *sides[1]))
    counted = both.groupBy(*published.columns).agg(F.sum("__published").alias("n_published"), F.sum("__rebuilt").alias("n_rebuilt"))
    return counted.where("n_published <> n_rebuilt")


class Outputs:
    """Views in a store, made from given tables and from each other."""

    def __init__(self, store: Store, views: list[View], tables: dict[str, DataFrame]):
        self.store, self.views, self.tables = store, {v.name: v for v in views}, tables
        if both := sorted(set(self.views) & set(tables)):
            raise ValueError(f"outputs that are given tables: {', '.join(both)}")

    def table(self, name: str) -> DataFrame:
        """A published output, or a given table."""
        return self.store.read(name) if name in self.views else self.tables[name]

    def made(self, view: View) -> DataFrame:
        """What a view's inputs give now."""
        return view.make(*[self.table(i) for i in view.inputs])

    def stale(self, view: View) -> str | None:
        """Why a view has to be made: it is missing, or inputs are not what it was made from."""
        version = self.store.version()
        if view.name not in version.tables:
            return "missing"
        built = {r["label"]: r["digest"] for r in self.store.read(f"{view.name}.stamp", version).collect()}
        changed = [i for i in view.inputs if built.get(i) != stamp(self.table(i))]
        gone = sorted(set(built) - set(view.inputs))
        return f"changed: {', '.join(changed + gone)}" if changed or gone else None

    def build(self, view: View) -> None:
        """Make a view and publish it with its stamp."""
        stamps = self.store.spark.createDataFrame([(i, stamp(self.table(i))) for i in view.inputs], "label string, digest string")
        self.store.replace({view.name: self.made(view), f"{view.name}.stamp": stamps}, f"build {view.name}")

    def irreproducible(self, view: View) -> str | None:
        """How the published output differs from what its inputs give now, or null."""
        published, rebuilt = self.table(view.name), self.made(view)
        if dict(published.dtypes) != dict(rebuilt.dtypes):
            return "not what its inputs give: other columns"
        n = row_differences(published, rebuilt).count()
        return f"not what its inputs give: {n} rows differ" if n else None

    def steps(self, everything: bool = False) -> list[Step]:
        """A step for each view, after those it is made from: needed where it is stale, or cheap (not ``dear``) with ``everything``."""

        def needed(v: View) -> str | None:
            return self.stale(v) or ("asked for" if everything and not v.dear else None)

        return [Step(v.name, partial(self.build, v), tuple(i for i in v.inputs if i in self.views), partial(needed, v)) for v in self.views.values()]

    def update(self, everything: bool = False, at_once: int = 4) -> dict[str, Outcome]:
        """Build what is stale, and with ``everything`` what is cheap as well."""
        return run(self.store.spark, self.steps(everything), at_once)

    def problems(self, at_once: int = 4) -> dict[str, str]:
        """Outputs that are stale, that a rebuild from published inputs gives other rows for, or that can't be rebuilt; nothing is published."""

        def look(v: View) -> list[str] | None:
            why = self.stale(v) or self.irreproducible(v)
            return [why] if why else None

        got = run(self.store.spark, [Step(v.name, partial(look, v)) for v in self.views.values()], at_once)
        return {n: f"cannot be rebuilt: {o.said}" if o.state == FAILED else o.said for n, o in got.items() if o.state in (WARNED, FAILED)}
