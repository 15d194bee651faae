"""Pipelines: a chain of stages over a shared context, with attached side processors.

A stage turns a DataFrame into a DataFrame; the chain is one lazy plan, so what one stage does is optimised
with the next.  A context (name -> object) is resolved before anything runs."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


class PipelineError(RuntimeError):
    """A chain that doesn't fit together or can't start."""


class Status(Enum):
    NOT_STARTED, RUNNING, STOPPING, STOPPED = range(4)


class Context(dict):
    """Named objects and the folder that relative paths are in."""

    def __init__(self, working_dir: str = ".", **values):
        super().__init__(values)
        self.working_dir = working_dir
        self.warnings: list[str] = []

    def set(self, name: str, value):
        """Sets a value and gives the one before; overwriting is told in ``warnings``."""
        before = self.get(name)
        if name in self:
            self.warnings.append(f"{name} is overwritten")
        self[name] = value
        return before

    def names(self) -> list[str]:
        return sorted(self)

    def path(self, name: str) -> str:
        return name if os.path.isabs(name) or "://" in name else os.path.join(self.working_dir, name)


@dataclass
class Stage:
    """A processor.  Subclasses override apply() and, where they need to, the hooks.

    ``in_schema``/``out_schema`` None: any.  ``publishes`` names attributes put in the context, ``needs`` maps
    attributes to (context name, type or None) that are taken from it."""

    in_schema: T.StructType | None = field(default=None, kw_only=True)
    out_schema: T.StructType | None = field(default=None, kw_only=True)
    publishes: tuple[str, ...] = field(default=(), kw_only=True)
    needs: dict = field(default_factory=dict, kw_only=True)
    is_source: bool = field(default=True, kw_only=True)
    is_sink: bool = field(default=True, kw_only=True)
    problem: str | None = field(default=None, init=False)

    def open(self, context: Context) -> None:
        """Before anything runs, with the context filled."""

    def apply(self, df: DataFrame | None) -> DataFrame | None:
        return df

    def close(self) -> None:
        """After all have run."""

    def fail_start(self, reason: str) -> None:
        self.problem = reason

    def can_start(self) -> bool:
        return self.problem is None


@dataclass
class Function(Stage):
    """A stage of one function, which may take a DataFrame or, as a source, None."""

    function: Callable[[DataFrame | None], DataFrame | None] = None

    def apply(self, df):
        return self.function(df)


@dataclass
class Tee(Stage):
    """Prints rows and passes them on."""

    rows: int = 20

    def apply(self, df):
        df.show(self.rows, truncate=False)
        return df


@dataclass
class FanIn(Stage):
    """Gives the rows of its branches together, each made of what comes in; what comes in itself is given where a branch does."""

    branches: list[Callable[[DataFrame | None], DataFrame]] = field(default_factory=list)

    def apply(self, df):
        out = None
        for b in self.branches:
            made = b(df)
            out = made if out is None else out.unionByName(made)
        return out


class Attached:
    """A side processor; its errors are told and don't stop the chain."""

    def can_start(self) -> bool:
        return True

    def before_context(self, pipeline: Pipeline) -> None: ...
    def after_context(self, pipeline: Pipeline) -> None: ...
    def chain_stopped(self, pipeline: Pipeline) -> None: ...
    def stop(self) -> None: ...


class Pipeline:
    def __init__(self, stages: list[Stage], attached: list[Attached] = (), context: Context | None = None):
        if not stages:
            raise PipelineError("a pipeline has at least one stage")
        self.stages, self.attached = list(stages), list(attached)
        self.context = context if context is not None else Context()
        self.state = Status.NOT_STARTED
        self.errors: list[str] = []
        self.query: StreamingQuery | None = None
        self.result: DataFrame | None = None

    def check(self) -> None:
        """Neighbours fit if one gives what the next takes; a schema that isn't told fits anything."""
        for a, b in zip(self.stages, self.stages[1:], strict=False):
            if not a.is_source or not b.is_sink or (a.out_schema is not None and b.in_schema is not None and a.out_schema != b.in_schema):
                raise PipelineError(f"{type(a).__name__} and {type(b).__name__} do not match")

    def _side(self, hook: str) -> None:
        for a in self.attached:
            try:
                getattr(a, hook)(self)
            except Exception as problem:  # a side processor never stops the chain
                self.errors.append(f"{type(a).__name__}: {problem}")

    def _share(self) -> None:
        published: set[str] = set()
        for s in self.stages:
            for name in s.publishes:
                if name in published:
                    raise PipelineError(f"{name} is published twice")
                published.add(name)
                self.context[name] = getattr(s, name)
        for s in self.stages:
            for attribute, (name, kind) in s.needs.items():
                if name not in self.context:
                    raise PipelineError(f"{type(s).__name__} needs {name}, which isn't in the context")
                if kind is not None and not isinstance(self.context[name], kind):
                    raise PipelineError(f"{name} is no {kind.__name__}")
                setattr(s, attribute, self.context[name])

    def plan(self, source: DataFrame | None = None) -> DataFrame | None:
        """The chain as one DataFrame; nothing runs yet, apart from what stages do themselves."""
        self.check()
        self.attached = [a for a in self.attached if a.can_start()]
        self._side("before_context")
        self._share()
        for s in self.stages:
            s.open(self.context)
        held = [s for s in self.stages if not s.can_start()]
        if held:
            raise PipelineError("; ".join(f"{type(s).__name__}: {s.problem}" for s in held))
        self._side("after_context")
        df = source
        for s in self.stages:
            df = s.apply(df)
        return df

    def start(self, source: DataFrame | None = None, sink: Callable[[DataFrame], StreamingQuery | None] | None = None, blocking: bool = True):
        """Plans and runs the chain.  ``sink`` takes the last DataFrame: it writes a batch, or starts a stream and
        returns its query, for which ``blocking`` waits."""
        df = self.plan(source)
        self.state = Status.RUNNING
        try:
            self.result = df
            if sink is not None and df is not None:
                self.query = sink(df)
            if self.query is not None and not blocking:
                return self.query
            if self.query is not None:
                self.query.awaitTermination()
        finally:
            if self.query is None or not self.query.isActive:
                self._ended()
        return df

    def _ended(self) -> None:
        if self.state == Status.STOPPED:
            return
        self.state = Status.STOPPED
        for s in self.stages:
            s.close()
        self._side("chain_stopped")

    def status(self) -> Status:
        if self.query is not None and not self.query.isActive and self.state == Status.RUNNING:
            self._ended()
        return self.state

    def stop(self) -> None:
        """No more input; what has arrived is worked off first."""
        if self.query is not None and self.query.isActive:
            self.state = Status.STOPPING
            self.query.processAllAvailable()
            self.query.stop()
        self._ended()

    def kill(self, spark: SparkSession) -> None:
        """Ends at once."""
        if self.query is not None:
            self.query.stop()
        spark.sparkContext.cancelAllJobs()
        self._ended()
