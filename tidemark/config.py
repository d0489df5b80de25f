"""Settings of a run: paths, thresholds, check limits, known failures; from a dictionary, JSON or YAML file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from tidemark.operators.labels import Failure, us

#: Plausible ranges of the analog channels.
RANGES = {"TP2": (-0.1, 12.0), "TP3": (0.0, 12.0), "H1": (-0.1, 12.0), "DV_pressure": (-0.1, 12.0), "Reservoirs": (0.0, 12.0), "Oil_temperature": (0.0, 110.0), "Motor_current": (-0.05, 15.0)}


@dataclass
class Config:
    paths: dict[str, str]
    expected_interval_seconds: int = 10
    gap_threshold_seconds: int = 60
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(RANGES))
    twin_eps: float = 0.01
    twin_max: float = 0.5
    antiphase_eps: float = 0.02
    failures: list[Failure] = field(default_factory=list)
    degraded: list[tuple[int, int]] = field(default_factory=list)
    invalid: list[tuple[int, int]] = field(default_factory=list)
    off_max: float = 1.0
    offloaded_max: float = 4.75
    threshold_q: float = 0.99
    #: Scores that are computed and judged; alarms go by zmax.
    scorers: list[str] = field(default_factory=lambda: ["zmax"])

    @classmethod
    def of(cls, raw: dict, root: str | Path = ".") -> Config:
        """Relative paths are taken from root; paths with a scheme stay as they are."""
        place = lambda p: p if "://" in p or p.startswith("/") else str(Path(root) / p)
        pre, checks, labels, modes = raw.get("preprocessing", {}), raw.get("checks", {}), raw.get("labels", {}), raw.get("features", {}).get("motor_modes", {})
        span = lambda pairs: [(us(str(a)), us(str(b))) for a, b in pairs]
        when = lambda x: us(str(x)) if x else None
        return cls(
            paths={k: place(v) for k, v in raw.get("paths", {}).items()},
            expected_interval_seconds=pre.get("expected_interval_seconds", 10), gap_threshold_seconds=pre.get("gap_threshold_seconds", 60),
            ranges={x["sensor"]: (float(x["min"]), float(x["max"])) for x in checks["analog_ranges"]} if "analog_ranges" in checks else dict(RANGES),
            twin_eps=checks.get("tp3_reservoirs_eps", 0.01), twin_max=checks.get("tp3_reservoirs_max", 0.5), antiphase_eps=checks.get("valve_antiphase_eps", 0.02),
            failures=[Failure(f["failure_id"], f["fault_type"], when(f["start"]), when(f["end"]), when(f.get("maintenance"))) for f in raw.get("failure_windows", [])],
            degraded=span(labels.get("degraded_periods", [])), invalid=span(labels.get("invalid_periods", [])),
            off_max=modes.get("off_max", 1.0), offloaded_max=modes.get("offloaded_max", 4.75), threshold_q=raw.get("threshold_q", 0.99), scorers=list(raw.get("scorers", ["zmax"])),
        )

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Paths of the file are relative to the folder above the file's own."""
        text = Path(path).read_text()
        if str(path).endswith(".json"):
            raw = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as e:
                raise ImportError("reading YAML needs the yaml package; write the settings as JSON") from e
            raw = yaml.safe_load(text)
        return cls.of(raw, Path(path).resolve().parent.parent)
