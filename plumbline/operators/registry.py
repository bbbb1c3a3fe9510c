"""Rules of a scan that users can add to: detectors, and the dimension rows of mechanisms that the library has not."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import RuleError
from ..functions.mechanisms import MECHANISMS
from .detectors import DETECTORS, Detector

#: What a rule's expressions see of a unit.
COLUMNS = "kind string, unit string, ord int, loc string, text string, a map<string,string>, shadow string"
LAYERS, COSTS = ("surface", "inner", "routing"), "ABCD"


class Registry:
    """Detectors in the order in which they report, and the mechanisms that they name."""

    def __init__(self, detectors: list[Detector] | None = None) -> None:
        self.detectors: list[Detector] = list(DETECTORS if detectors is None else detectors)
        self.mechanisms: dict[str, tuple] = {m[0]: m for m in MECHANISMS}

    def describe(self, mechanism: str, layer: str, severity: float, tier: int, cost_class: str = "A") -> None:
        """Add a mechanism to the dimension."""
        if not mechanism or mechanism in self.mechanisms:
            raise RuleError(f"mechanism {mechanism!r} is empty or known")
        if layer not in LAYERS or cost_class not in COSTS or not 0 <= severity <= 1 or tier not in (0, 1, 2, 3):
            raise RuleError(f"{mechanism}: layer {layer!r}, severity {severity}, tier {tier} or cost class {cost_class!r} is out of range")
        self.mechanisms[mechanism] = (mechanism, layer, float(severity), tier, cost_class)

    def register(self, detector: Detector) -> Detector:
        """Add a detector of a known mechanism; its expressions must be sound SQL over a unit (where there is a session to tell)."""
        if detector.mechanism not in self.mechanisms:
            raise RuleError(f"mechanism {detector.mechanism!r} is not described")
        if not detector.unit or not detector.when:
            raise RuleError(f"{detector.mechanism}: no unit or no condition")
        if any((d.mechanism, d.unit, d.when) == (detector.mechanism, detector.unit, detector.when) for d in self.detectors):
            raise RuleError(f"{detector.mechanism} on {detector.unit} exists")
        spark = SparkSession.getActiveSession()
        if spark:
            try:
                spark.createDataFrame([], COLUMNS).select(*[F.expr(e) for e in (detector.when, detector.confidence, detector.tier, detector.severity, detector.payload)])
            except AnalysisException as e:
                raise RuleError(f"{detector.mechanism}: {e.getCondition()}") from e
        self.detectors.append(detector)
        return detector

    def unregister(self, mechanism: str) -> None:
        """Take out all detectors of a mechanism; its dimension row stays."""
        self.get(mechanism)
        self.detectors = [d for d in self.detectors if d.mechanism != mechanism]

    def clear(self) -> None:
        self.detectors = []

    def get(self, mechanism: str) -> list[Detector]:
        found = [d for d in self.detectors if d.mechanism == mechanism]
        if not found:
            raise KeyError(mechanism)
        return found

    def names(self) -> list[str]:
        return list(dict.fromkeys(d.mechanism for d in self.detectors))

    def __contains__(self, mechanism: object) -> bool:
        return any(d.mechanism == mechanism for d in self.detectors)

    def __iter__(self) -> Iterator[Detector]:
        return iter(self.detectors)

    def __len__(self) -> int:
        return len(self.detectors)
