"""Keyed state machines given as tables of rules: one definition, run over a batch or a stream.

A rule says: in this state, once this condition has held for so many seconds, go to that state. Conditions are boolean
columns worked out beforehand by column expressions; a null leaves a condition's clock as it was (nothing is known).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skylattice.operators.sequence import ordered_fold


@dataclass(frozen=True)
class Rule:
    """In ``state`` (``*``: in any), after ``condition`` has held longer than ``hold`` seconds, go to ``to``."""

    state: str
    condition: str
    hold: float
    to: str


@dataclass
class Machine:
    """The state of one key."""

    state: str
    entered: float | None = None
    since: dict[str, float] = field(default_factory=dict)
    spent: dict[str, float] = field(default_factory=dict)
    last: float | None = None

    def advance(self, t: float, conditions: dict[str, bool | None], rules: tuple[Rule, ...]) -> str:
        """Take one row; the first rule that fires decides. Returns the reason, or an empty text."""
        if self.entered is None:
            self.entered = t
        if self.last is not None:
            self.spent[self.state] = self.spent.get(self.state, 0.0) + t - self.last
        self.last = t
        for name, held in conditions.items():
            if held is None:
                continue
            if not held:
                self.since.pop(name, None)
            else:
                self.since.setdefault(name, t)
        for r in rules:
            if r.state not in (self.state, "*") or r.to == self.state:
                continue
            start = self.entered if r.condition == "timeout" else self.since.get(r.condition)
            if start is not None and t - start >= r.hold:
                self.state, self.entered = r.to, t
                return r.condition
        return ""

    def dump(self) -> tuple:
        """As plain values for a state store."""
        import json

        return (json.dumps([self.state, self.entered, self.since, self.spent, self.last]),)

    @staticmethod
    def load(v: tuple) -> Machine:
        """The inverse."""
        import json

        return Machine(*json.loads(v[0]))


def _step(rules: tuple[Rule, ...], names: list[str], key: list[str]):
    def step(m: Machine, rows: pd.DataFrame) -> tuple[Machine, pd.DataFrame]:
        out = []
        for r in rows.itertuples(index=False):
            c = {n: None if pd.isna(v := getattr(r, n)) else bool(v) for n in names}
            why = m.advance(float(r.t), c, rules)
            out.append((*(getattr(r, k) for k in key), float(r.t), m.state, why, m.spent.get(m.state, 0.0)))
        return m, pd.DataFrame(out, columns=[*key, "t", "state", "reason", "spent"])

    return step


def _schema(rows: DataFrame, key: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in key) + ", t double, state string, reason string, spent double"


def run_batch(rows: DataFrame, key: list[str], rules: tuple[Rule, ...], start: str, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Every row's state after it, the reason if it changed, and the time spent in that state so far."""
    names = sorted({r.condition for r in rules} - {"timeout"})
    return ordered_fold(rows.where("t is not null"), key, list(order), lambda: Machine(start), _step(rules, names, key), _schema(rows, key))


def run_stream(rows: DataFrame, key: list[str], rules: tuple[Rule, ...], start: str) -> DataFrame:
    """The same over a stream: a key's machine is kept in the state store; rows of a trigger are taken in order of time."""
    names = sorted({r.condition for r in rules} - {"timeout"})
    step = _step(rules, names, key)

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Machine.load(state.get) if state.exists else Machine(start)
        b = pd.concat(list(batches)).sort_values("t", kind="stable")
        m, out = step(m, b)
        state.update(m.dump())
        yield out

    return rows.where("t is not null").groupBy(*key).applyInPandasWithState(update, _schema(rows, key), "machine string", "append", GroupStateTimeout.NoTimeout)
