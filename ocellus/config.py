"""Settings of an analysis as one immutable value that plan builders receive."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    # The defaults that results depend on
    min_area_um2: float = 250.0
    max_area_um2: float = 25000.0
    grid_cell_um: float = 1100.0
    nms_iou: tuple[int, int] = (3, 10)
    merge_iou: tuple[int, int] = (2, 10)
    confidence: float = 0.95
    tissue_confidence: float = 0.5
    default_mpp: float = 0.50
    min_tumor_px: int = 100
    min_total_tumor_px: int = 50
    roi_coverage: float = 0.2
    tissue_coverage: float = 0.1
    zone_near_um: float = 1500.0
    zone_intermediate_um: float = 5000.0
    close_um: float = 100.0
    medium_um: float = 500.0
    annotated_max_px: int = 250_000_000
    curation_min_count: int = 100
    retry_failed: bool = False
    extended_properties: bool = False
    window: tuple[int, int] | None = None
    stride: tuple[int, int] | None = None
    output_dir: str | None = None
    resume_batch: str | None = None

    def with_saved(self, saved: dict, protected: tuple[str, ...] = ("output_dir", "resume_batch", "extended_properties")) -> EngineConfig:
        """Overlay a saved snapshot: its keys win, but protected keys keep their current value when one is set."""
        known = {k: v for k, v in saved.items() if k in self.__dataclass_fields__ and not (k in protected and getattr(self, k))}
        return replace(self, **known)

    def validated(self) -> EngineConfig:
        if not 0 < self.min_area_um2 < self.max_area_um2:
            raise ValueError("areas must satisfy 0 < min < max")
        if not 0 <= self.roi_coverage <= 1 or not 0 <= self.tissue_coverage <= 1:
            raise ValueError("coverages must lie in [0, 1]")
        for pair in (self.window, self.stride):
            if pair is not None and min(pair) <= 0:
                raise ValueError("window and stride must be positive")
        if self.default_mpp <= 0:
            raise ValueError("default_mpp must be positive")
        return self


DEFAULTS = EngineConfig()
