"""What packs may bring: contracts that disprove findings, floors, metrics, and backends that judge cases."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import text as t
from assaylake.operators import floors

#: A contract takes findings (case_id, code and what it needs) and parameters, and gives case_id, code, disproved (null where it cannot tell).
Contract = Callable[[DataFrame, dict], DataFrame]
_CONTRACTS: dict[str, Contract] = {}
GROUP = "assaylake.packs"


def contract(name: str) -> Callable[[Contract], Contract]:
    """Registers a contract under a name; a second of the same name replaces the first."""

    def add(f: Contract) -> Contract:
        _CONTRACTS[name] = f
        return f

    return add


def contracts() -> dict[str, Contract]:
    return dict(_CONTRACTS)


@contract("presence")
def presence(findings: DataFrame, params: dict) -> DataFrame:
    """A finding that something is missing: disproved where a word of ``least`` letters of its ``subject`` stands in the text."""
    words = F.filter(F.split(F.lower("subject"), "[^a-z]+"), lambda w: F.length(w) >= params.get("least", 4))
    held = F.exists(words, lambda w: F.contains(F.lower("text"), w))
    return findings.select("case_id", "code", F.when(F.size(words) > 0, F.coalesce(held, F.lit(False))).alias("disproved"))


@contract("quoted")
def quoted(findings: DataFrame, params: dict) -> DataFrame:
    """A finding that something is not said: disproved where its ``quote``, of ``least`` characters when normalized, stands in the text."""
    quote = t.plain(F.coalesce("quote", F.lit("")))
    there = F.contains(t.plain(F.coalesce("text", F.lit(""))), quote)
    return findings.select("case_id", "code", F.when(F.length(quote) >= params.get("least", 12), there).alias("disproved"))


def checked(declared: list[tuple[str, str, dict]], known: dict[str, Contract] | None = None) -> list[tuple[str, str, dict]]:
    """Declared contracts (code, contract, parameters) in their order; an unknown name is an error here, not in a job."""
    names = contracts() if known is None else known
    for code, name, params in declared:
        if name not in names:
            raise ValueError(f"{code}: no contract of the name {name}")
        if not isinstance(params, dict):
            raise ValueError(f"{code}: parameters of {name} are no mapping")
    return declared


def disproved(findings: DataFrame, declared: list[tuple[str, str, dict]], known: dict[str, Contract] | None = None) -> DataFrame:
    """case_id, code, contract: of each finding the first of its code's contracts that disproves it, null where none does.

    Each contract sees the findings of its codes, all at once, as a table; contracts of the same name and parameters are one
    plan. A contract that cannot tell does not end the chain."""
    names = contracts() if known is None else known
    plans: dict[tuple[str, str], list[tuple[str, int]]] = {}
    for place, (code, name, params) in enumerate(checked(declared, known)):
        plans.setdefault((name, json.dumps(params, sort_keys=True)), []).append((code, place))
    out = findings.select("case_id", "code").distinct().withColumn("place", F.lit(None).cast("int"))
    for (name, params), codes in plans.items():
        places = F.create_map(*[F.lit(x) for pair in codes for x in pair])
        said = names[name](findings.filter(F.col("code").isin(*[c for c, _ in codes])), json.loads(params))
        out = out.unionByName(said.filter("disproved").select("case_id", "code", F.element_at(places, F.col("code")).alias("place")))
    first = out.groupBy("case_id", "code").agg(F.min("place").alias("place"))
    labels = F.array(*[F.lit(name) for _, name, _ in declared]) if declared else F.array().cast("array<string>")
    return first.select("case_id", "code", F.get(labels, F.col("place")).alias("contract"))


def _merge(module: ModuleType) -> list[str]:
    own = getattr(module, "CONTRACTS", {})
    _CONTRACTS.update(own)
    more = getattr(module, "FLOORS", {})
    for name, f in more.items():
        floors.floor(name)(f)
    return sorted([*own, *more])


def load_pack(manifest: str) -> list[str]:
    """Contracts and floors of a pack, from the Python file that its manifest (JSON) names under ``floors``; those of the same name
    as the library's replace them. A manifest that names none brings none."""
    path = Path(manifest)
    name = json.loads(path.read_text()).get("floors")
    if not name:
        return []
    spec = importlib.util.spec_from_file_location(f"pack_{path.parent.name}", path.parent / name)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return _merge(module)


def discover() -> dict[str, list[str]]:
    """What the installed packs bring, by the name of their entry point in the group ``assaylake.packs``."""
    return {e.name: _merge(e.load()) for e in importlib.metadata.entry_points(group=GROUP)}


@dataclass(frozen=True)
class JudgeMetric:
    """A judge's output against what a case expects, as columns: ``expected`` and ``raised`` are arrays of codes.

    What was raised and is not in the lens's part of the expected codes counts against the judge; with
    ``co_raise_aware`` codes that are expected but owned by others are neutral."""

    lens: tuple[str, ...] | None = None
    co_raise_aware: bool = False

    def parts(self, expected: Column, raised: Column) -> dict[str, Column]:
        expected, raised = (F.coalesce(x, F.array().cast("array<string>")) for x in (expected, raised))
        expected, raised = F.array_distinct(expected), F.array_distinct(raised)
        lens = None if self.lens is None else F.array(*[F.lit(c) for c in self.lens]).cast("array<string>")
        truth = expected if lens is None else F.array_intersect(expected, lens)
        neutral = F.array_intersect(raised, F.array_except(expected, lens)) if self.co_raise_aware and lens is not None else F.array().cast("array<string>")
        wrong = F.array_except(F.array_except(raised, truth), neutral)
        return {"tp": F.size(F.array_intersect(raised, truth)), "fp": F.size(wrong), "fn": F.size(F.array_except(truth, raised)), "neutral": F.size(neutral)}

    def exact(self, expected: Column, raised: Column) -> Column:
        """The hard gate of one case."""
        p = self.parts(expected, raised)
        return (p["fp"] == 0) & (p["fn"] == 0)

    def graded(self, expected: Column, raised: Column) -> Column:
        """1 for an exact case, else the harmonic mean of precision and recall."""
        p = self.parts(expected, raised)
        return F.when(self.exact(expected, raised), 1.0).otherwise(2 * p["tp"] / F.nullif(2 * p["tp"] + p["fp"] + p["fn"], F.lit(0)))

    def over(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """accepted, graded, precision, recall and the counts of all cases of each key: sums that combine before the shuffle."""
        e, r = F.col("expected"), F.col("raised")
        each = rows.select(*keys, *[c.cast("long").alias(n) for n, c in self.parts(e, r).items()], self.graded(e, r).alias("graded"))
        n = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "neutral")], F.round(F.avg("graded"), 6).alias("graded"), F.count(F.lit(1)).alias("n"))
        share = lambda other: F.round(F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0), 4)
        return n.select(*keys, ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("accepted"), "graded", share("fp").alias("precision"), share("fn").alias("recall"), "tp", "fp", "fn", "neutral", "n")


@dataclass(frozen=True)
class Pin:
    backend: str
    version: str


@dataclass(frozen=True)
class Verdict:
    compliance: str
    artifact: str
    flags: list[str] = field(default_factory=list)


class Backend:
    """Judges one case. It is made once a task, where its clients and models belong, and may be asked again for the same case."""

    pin = Pin("none", "0")

    def evaluate(self, case: dict) -> Verdict:
        raise NotImplementedError


VERDICTS = "case_id long, compliance string, artifact string, flags array<string>, error string, backend string, version string"


def evaluated(cases: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """Each case (case_id and what the backend reads) with the backend's verdict and pin; where it fails, neutral verdicts and the error.

    Cases go to the backend one by one from Arrow batches, in the tasks where they lie; nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for case in b.to_pylist():
                try:
                    v, error = backend.evaluate(case), None
                except Exception as e:  # one case's failure is that case's result
                    v, error = Verdict("NEUTRAL", "NEUTRAL"), f"{type(e).__name__}: {e}"
                rows.append((case["case_id"], v.compliance, v.artifact, list(v.flags), error, backend.pin.backend, backend.pin.version))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in VERDICTS.split(", ")])

    return cases.mapInArrow(run, VERDICTS)
