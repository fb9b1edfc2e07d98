"""Named jobs that run after each other: each once, after all that it needs."""
from __future__ import annotations

from collections.abc import Callable, Iterable


class Jobs:
    """A list of jobs; `run` runs the wanted ones and what they need, in an order that respects the needs."""

    def __init__(self) -> None:
        self.steps: dict[str, tuple[tuple[str, ...], Callable[[], object]]] = {}

    def add(self, name: str, work: Callable[[], object], after: Iterable[str] = ()) -> None:
        if name in self.steps:
            raise ValueError(f"job {name} exists")
        self.steps[name] = (tuple(after), work)

    def order(self, *wanted: str) -> list[str]:
        done: dict[str, bool] = {}

        def visit(name: str) -> None:
            if name not in self.steps:
                raise KeyError(f"no job {name}")
            if done.get(name) is False:
                raise ValueError(f"job {name} needs itself")
            if name not in done:
                done[name] = False
                for needed in self.steps[name][0]:
                    visit(needed)
                done[name] = True
                out.append(name)

        out: list[str] = []
        for name in wanted or tuple(self.steps):
            visit(name)
        return out

    def run(self, *wanted: str) -> dict[str, object]:
        return {name: self.steps[name][1]() for name in self.order(*wanted)}
