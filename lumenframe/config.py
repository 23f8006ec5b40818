"""Configuration of an analysis; values become literals of the plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

ROLES = ("nuclear", "cytoplasm", "membrane", "stain", "none")
METHODS = ("threshold", "model", "presegmented", "none")


@dataclass(frozen=True)
class StainConfig:
    """Segmentation of one stain channel."""

    method: str = "threshold"
    threshold_min: float = 18
    threshold_max: float = 255
    min_object_size: int = 100
    output: str = "binary"  # or labeled: objects split where they touch
    doublet_threshold: float = 0.7
    watershed_min_distance: int = 80

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method: {self.method}")
        if self.output not in ("binary", "labeled"):
            raise ValueError(f"unknown output: {self.output}")


@dataclass(frozen=True)
class CytoplasmConfig:
    """Flooding of the cytoplasm from nuclei: over the channel's intensity for a ``membrane``, else over the distance to nuclei."""

    threshold_min: float = 18
    threshold_max: float = 255
    min_object_size: int = 0
    source: str = "channel"


@dataclass(frozen=True)
class Config:
    """Defaults of a run; ``channel_roles`` maps channel stems to roles in order."""

    pixel_size_um: float | None = 0.0613414  # fixed value of the format's users; wins over file metadata
    z_size_um: float | None = None
    threshold_min: float = 18
    threshold_max: float = 255
    min_object_size: int = 2500
    connectivity: int = 2
    edge_margin: int = 5
    doublet_threshold: float = 0.7
    watershed_min_distance: int = 80
    input_mode: str = "auto"
    filter_stain: str | None = None
    filter_condition: str = "contains"
    remove_outliers: bool = True
    outlier_mad_threshold: float = 4.0
    channel_roles: Mapping[str, str] = field(default_factory=dict)
    stains: Mapping[str, StainConfig] = field(default_factory=dict)
    cytoplasm: CytoplasmConfig = CytoplasmConfig()

    def __post_init__(self):
        if unknown := set(self.channel_roles.values()) - set(ROLES):
            raise ValueError(f"unknown roles: {sorted(unknown)}")
        if self.connectivity not in (1, 2):
            raise ValueError("connectivity is 1 or 2")

    def stem(self, role: str) -> str | None:
        return next((s for s, r in self.channel_roles.items() if r == role), None)

    def stain_stems(self) -> list[str]:
        """Stain channels in order, without those whose method is none."""
        return [s for s, r in self.channel_roles.items() if r == "stain" and self.stains.get(s, StainConfig()).method != "none"]

    def bands(self) -> dict[str, tuple[float, float]]:
        """Threshold bands of the channels that thresholds segment: the nuclear one and stains."""
        out = {s: (self.threshold_min, self.threshold_max) for s in [self.stem("nuclear")] if s}
        of = {s: self.stains.get(s, StainConfig()) for s in self.stain_stems()}
        return out | {s: (c.threshold_min, c.threshold_max) for s, c in of.items() if c.method == "threshold"}

    def cytoplasm_stem(self) -> str | None:
        """The channel that the cytoplasm is flooded in; a membrane source may also be given the cytoplasm's role."""
        return (self.stem("membrane") if self.cytoplasm.source == "membrane" else None) or self.stem("cytoplasm")

    def primary_stem(self) -> str | None:
        return self.stem("nuclear") or next(iter(self.stain_stems()), None)
