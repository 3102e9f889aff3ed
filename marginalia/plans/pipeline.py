"""Named steps with run modes and parameters, as a configuration file sets them, and branches by document features."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.model import cut_lineage


@dataclass(frozen=True)
class Step:
    """fn(df, **params). when: always, never, or (feature column, value): only rows with that value go through, the others pass by."""

    name: str
    fn: Callable[..., DataFrame]
    when: str | tuple[str, str] = "always"
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    """Steps in order. before and after see the whole corpus at its start and end (df -> df), aborted gets the error if a step fails.

    properties: values that `{name}` in text parameters stands for; features: columns given to documents that lack them.
    """

    steps: tuple[Step, ...]
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None
    aborted: Callable[[Exception], None] | None = None
    properties: dict[str, str] = field(default_factory=dict)
    features: dict[str, str] = field(default_factory=dict)

    def configure(self, config: dict[str, dict[str, Any]]) -> Plan:
        """config: {'prrun': {step: mode}, 'prparm' and 'prinit': {'step.param': value}, 'propset': {name: value},
        'docfeature': {name: value}}; unknown sections and names raise an error. prparm wins over prinit."""
        if unknown := set(config) - {"prrun", "prparm", "prinit", "propset", "docfeature"}:
            raise KeyError(f"no such sections: {sorted(unknown)}")
        steps = {s.name: s for s in self.steps}
        for name, mode in config.get("prrun", {}).items():
            feature, eq, value = mode.partition("=") if isinstance(mode, str) else ("", "", "")
            steps[name] = replace(steps[name], when=(feature, value) if eq else mode)
        for section in ("prinit", "prparm"):
            for key, value in config.get(section, {}).items():
                name, param = key.rsplit(".", 1)
                steps[name] = replace(steps[name], params=steps[name].params | {param: value})
        return replace(self, steps=tuple(steps[s.name] for s in self.steps), properties=self.properties | config.get("propset", {}), features=self.features | config.get("docfeature", {}))

    def run(self, df: DataFrame, ignore_errors: bool = False, time_limit: float | None = None) -> DataFrame:
        """The corpus after all steps. ignore_errors: a step that fails is left out (and told to `aborted`); time_limit: each
        step is worked out at once, and cancelled as failed after so many seconds."""
        for name, value in self.features.items():
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
        df = self.before(df) if self.before else df
        for s in self.steps:
            try:
                df = self._step(s, df, time_limit)
            except Exception as e:
                if self.aborted:
                    self.aborted(e)
                if not ignore_errors:
                    raise
        return self.after(df) if self.after else df

    def _step(self, s: Step, df: DataFrame, time_limit: float | None) -> DataFrame:
        if s.when == "never":
            return df
        params = {k: v.format(**self.properties) if isinstance(v, str) and self.properties else v for k, v in s.params.items()}
        if s.when == "always":
            out = s.fn(df, **params)
        else:
            feature, value = s.when
            hit = F.coalesce(F.col(feature) == value, F.lit(False))
            out = s.fn(df.where(hit), **params).unionByName(df.where(~hit), allowMissingColumns=True)
        return out if time_limit is None else within_time(out, time_limit)


def within_time(df: DataFrame, seconds: float) -> DataFrame:
    """df worked out and written to the checkpoint folder; its job is cancelled after so many seconds."""
    context, group = df.sparkSession.sparkContext, f"limit-{uuid.uuid4().hex}"
    context.setJobGroup(group, "step with a time limit", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        return cut_lineage(df)
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def read_config(text: str) -> dict[str, dict[str, Any]]:
    """Configuration of YAML lines: sections at the margin, `key: value` indented under them; true, false and numbers are read as such."""
    out: dict[str, dict[str, Any]] = {}
    section: dict[str, Any] | None = None
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or bare.strip() == "---":
            continue
        key, _, value = bare.strip().partition(":")
        if not line[0].isspace():
            section = out.setdefault(key.strip(), {})
            continue
        if section is None:
            raise ValueError(f"no section before {bare.strip()!r}")
        v = value.strip().strip("\"'")
        section[key.strip()] = {"true": True, "false": False}.get(v, int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+[.]\d+", v) else v)
    return out
