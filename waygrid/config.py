"""Thresholds of the engine in one place. Every operator takes them as arguments too."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # track cleaning
    min_track_points: int = 10
    sigma: float = 3.0
    max_speed_mph: float = 200.0
    max_speed_mps: float = 140.0
    iqr_factor: float = 2.0
    iqr_min_share: float = 0.4
    iqr_fallback_mps: float = 138.9
    min_dt_s: float = 0.1
    max_dt_s: float = 3600.0
    # matching
    top_k: int = 5
    min_pair_points: int = 3
    min_track_s: float = 5.0
    duration_low: float = 0.7
    duration_high: float = 2.0
    # offset search
    max_offset_s: float = 90.0
    coarse_step_s: float = 0.05
    fine_step_s: float = 0.01
    coarse_grid_s: float = 0.2
    fine_grid_s: float = 0.1
    min_overlap_s: float = 8.0
    min_coarse_points: int = 20
    min_fine_points: int = 30
    refine_from: float = 0.3
    # detections
    min_confidence: float = 0.05
    moving_px: float = 20.0
    centroid_px: float = 100.0
    band_degrees: float = 1e-4


DEFAULT = EngineConfig()

# Fixed values of the domain.
EARTH_MILES = 3958.8
EARTH_METERS = 6371000.0
#: Quality grades by least score.
QUALITY = (("excellent", 0.85), ("very_good", 0.70), ("good", 0.55), ("fair", 0.40), ("poor", 0.25))
QUALITY_LEVELS = ("very_poor", "poor", "fair", "good", "very_good", "excellent")
#: Weights of the ensemble, with and without the visual components.
ENSEMBLE = {"motion": 0.25, "temporal": 0.20, "statistical": 0.15, "optical_flow": 0.15, "cnn_feature": 0.15, "advanced_dtw": 0.10}
ENSEMBLE_BASIC = {"motion": 0.4, "temporal": 0.3, "statistical": 0.3}
#: Weights of the adaptive ensemble; anything else weighs 0.5.
ADAPTIVE = {"statistical": 1.0, "temporal": 1.0, "dtw": 1.2, "optical_flow": 1.1, "lighting_time": 0.8, "motion_elevation": 1.3, "complexity_terrain": 0.9, "stability_movement": 1.0, "learned_embedding": 1.4, "synchronized_events": 1.2}
