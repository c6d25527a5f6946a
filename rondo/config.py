"""Parameters of the engine with their defaults; field names are the flags' names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    window_beats: int = 4
    window_overlap: float = 0.5
    max_t_ms_sanity: int = 3_600_000
    sample_maps: int = 2000
    max_windows_per_map: int = 64
    seed: int = 2025
    k: int = 200
    pre_k: int = 8000
    max_stage3: int = 8000
    linkage: str = "ward"
    top_k: int = 10
    max_points: int = 0
    contour_grid: int = 180
    contour_smooth: int = 3
    contour_smooth_sphere: int = 6
    star_boost_power: float = 2.0
    star_boost_cap: float = 15.0
    bpm_low_boost_power: float = 1.6
    perf_low_points: int = 25_000
    perf_mid_points: int = 100_000
    perf_high_points: int = 250_000
    sphere_radius: float = 1.0
    sphere_mesh_subdivisions: int = 7

    def lod_sizes(self) -> tuple[int, int, int]:
        """Nested sample sizes: at least 1000, and none smaller than the one before."""
        low = max(1000, self.perf_low_points)
        mid = max(low, self.perf_mid_points)
        return low, mid, max(mid, self.perf_high_points)
