"""Phases with dependencies: checks, levels, freshness and parallel runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from threading import Lock


@dataclass
class Phase:
    """A step: what it needs, and run(results of what it needs). With inputs and config it is fresh as long as their hash is the sealed one."""

    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    inputs: Callable[[], object] = lambda: None
    config: object = None

    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.inputs(), self.config], sort_keys=True, default=str).encode()).hexdigest()


class Dag:
    def __init__(self, phases: Iterable[Phase]):
        self.phases = {p.name: p for p in phases}

    def errors(self) -> list[str]:
        """What is wrong: needs that are no phases, and a cycle."""
        out = [f"{p.name} needs {n}, which is no phase" for p in self.phases.values() for n in p.needs if n not in self.phases]
        state: dict[str, int] = {}

        def walk(name: str, path: list[str]) -> None:
            if state.get(name) == 1:
                out.append("cycle: " + " -> ".join([*path[path.index(name) :], name]))
                return
            if state.get(name) == 2 or name not in self.phases:
                return
            state[name] = 1
            for n in self.phases[name].needs:
                walk(n, [*path, name])
            state[name] = 2

        for name in self.phases:
            walk(name, [])
        return out

    def ancestors(self, name: str) -> set[str]:
        out, todo = set(), list(self.phases[name].needs)
        while todo:
            n = todo.pop()
            if n not in out and n in self.phases:
                out.add(n)
                todo += self.phases[n].needs
        return out

    def descendants(self, name: str) -> set[str]:
        return {n for n in self.phases if name in self.ancestors(n)}

    def only(self, names: Iterable[str]) -> Dag:
        keep = set(names)
        return Dag(p for p in self.phases.values() if p.name in keep)

    def target(self, name: str) -> Dag:
        return self.only(self.ancestors(name) | {name})

    def levels(self) -> list[list[str]]:
        """Phases by level: one more than the highest of what they need; needs that were left out do not count."""
        level: dict[str, int] = {}

        def of(name: str) -> int:
            if name not in level:
                level[name] = 1 + max((of(n) for n in self.phases[name].needs if n in self.phases), default=-1)
            return level[name]

        for name in self.phases:
            of(name)
        return [sorted(n for n in level if level[n] == k) for k in range(max(level.values(), default=-1) + 1)]


@dataclass
class Run:
    results: dict = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def execute(dag: Dag, seals: dict[str, str] | Manifest | None = None, force: bool = False, threads: int = 4) -> Run:
    """Runs a level after the other, the phases of a level side by side (Spark jobs from several threads). A failure stops what needs it and nothing else.

    seals (name to key) is read and brought up to date: a phase with the sealed key is skipped, unless one that it needs ran.
    """
    if found := dag.errors():
        raise ValueError("; ".join(found))
    out, seals, ran = Run(), {} if seals is None else seals, set()
    for level in dag.levels():

        def one(name: str) -> tuple[str, object, str | None]:
            phase = dag.phases[name]
            if any(n in out.failed for n in phase.needs):
                return name, None, "a phase that it needs failed"
            try:
                return name, phase.run({n: out.results.get(n) for n in phase.needs}), None
            except Exception as e:  # noqa: BLE001 - recorded, and the others go on
                return name, None, f"{type(e).__name__}: {e}"

        keys = {n: dag.phases[n].key() for n in level}
        todo = [n for n in level if force or seals.get(n) != keys[n] or ran & set(dag.phases[n].needs)]
        out.skipped += [n for n in level if n not in todo]
        with ThreadPoolExecutor(max(1, min(threads, len(todo)))) as pool:
            for name, value, error in pool.map(one, todo):
                if error:
                    out.failed[name] = error
                    seals.pop(name, None)
                else:
                    out.results[name], seals[name] = value, keys[name]
                    ran.add(name)
    return out


class Manifest:
    """The seals of a folder in one small JSON file on the driver, for execute(): a dict that is written, beside its place and then moved there, after each change."""

    def __init__(self, path: str):
        self.path, self.lock = path, Lock()
        try:
            self.held: dict[str, str] = json.loads(Path(path).read_text())
        except (FileNotFoundError, json.JSONDecodeError):  # no build yet, or half a file: everything runs
            self.held = {}

    def _write(self) -> None:
        from fernweave.sources.graph_json import write_atomically

        write_atomically(self.path, json.dumps(self.held, sort_keys=True, indent=1))

    def get(self, name: str) -> str | None:
        return self.held.get(name)

    def __setitem__(self, name: str, key: str) -> None:
        with self.lock:
            self.held[name] = key
            self._write()

    def pop(self, name: str, default: str | None = None) -> str | None:
        with self.lock:
            if name not in self.held:
                return default
            out = self.held.pop(name)
            self._write()
            return out
