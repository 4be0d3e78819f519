"""Settings of a run: which days are predicted, how far the features look back, how data are split."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from pathlib import Path
from typing import Any

SECTIONS = ("paths", "labels", "features", "split")


def _days(first: str, n: int) -> tuple[str, ...]:
    return tuple(str(date.fromisoformat(first) + timedelta(days=i)) for i in range(n))


@dataclass(frozen=True)
class Settings:
    prediction_days: tuple[str, ...] = _days("2024-01-18", 13)
    lookback_days: int = 3
    sale_day: str = "2024-01-24"
    windows: tuple[int, ...] = (1, 7, 0)
    test_days: tuple[str, ...] = ("2024-01-30",)
    first_validation_day: str = "2024-01-22"
    negative_ratio: int = 20
    seed: int = 48
    models: dict[str, Any] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    root: Path = Path(".")

    def __post_init__(self) -> None:
        for d in (*self.prediction_days, *self.test_days, self.sale_day, self.first_validation_day):
            if str(date.fromisoformat(d)) != d:
                raise ValueError(f"not an ISO day: {d}")
        if not {0, 1, 7} <= set(self.windows):
            raise ValueError("features.windows needs 0 (all history), 1 and 7")
        if self.lookback_days < 1:
            raise ValueError("labels.lookback_days must be at least 1")

    @property
    def trainval_days(self) -> tuple[str, ...]:
        return tuple(d for d in sorted(self.prediction_days) if d not in self.test_days)

    def resolve(self, name: str) -> Path:
        """A configured path, taken from the project's root unless absolute."""
        path = Path(self.paths[name])
        return path if path.is_absolute() else self.root / path


def load_settings(path: str | Path) -> Settings:
    """Settings from YAML; the project's root is the parent of the file's folder."""
    import yaml

    path = Path(path).resolve()
    if not path.is_file():
        raise FileNotFoundError(f"no settings at {path}")
    raw = yaml.safe_load(path.read_text())
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no mapping")
    if absent := [s for s in SECTIONS if s not in raw]:
        raise ValueError(f"{path} lacks the sections {', '.join(absent)}")
    try:
        return Settings(
            prediction_days=tuple(map(str, raw["labels"]["prediction_days"])),
            lookback_days=int(raw["labels"]["lookback_days"]),
            sale_day=str(raw["labels"]["sale_day"]),
            windows=tuple(map(int, raw["features"]["windows"])),
            test_days=tuple(map(str, raw["split"]["test_days"])),
            first_validation_day=str(raw["split"]["first_validation_day"]),
            negative_ratio=int(raw["split"]["negative_ratio"]),
            seed=int(raw["split"]["seed"]),
            models=dict(raw.get("models") or {}),
            paths=dict(raw["paths"]),
            root=path.parent.parent,
        )
    except KeyError as e:
        raise ValueError(f"{path} lacks {e}") from e
