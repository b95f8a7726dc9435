"""Parameters of the analytics, with the values that the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BeatConfig:
    """Beats to daily measurements. Times in seconds, durations in milliseconds."""

    tail_trim_s: float = 15.0
    window_s: float = 60.0
    step_s: float = 30.0
    stable_rel: float = 0.08
    min_pairs: int = 20
    start_min_s: float = 45.0
    tail_s: float = 120.0
    tail_min_s: float = 75.0
    tail_min_pairs: int = 60
    artifact_ok_max: float = 15.0
    artifact_max: float = 20.0
    min_ms: float = 300.0
    max_ms: float = 2000.0
    delta_max: float = 0.20
    cv_max: float = 0.20
    mismatch_max: float = 0.15
    hr_min: float = 35.0
    hr_max: float = 100.0
    bin_ms: float = 50.0


@dataclass(frozen=True)
class AuditConfig:
    """Rolling regression with memory."""

    days: int = 90
    min_days: int = 60
    min_iqr: float = 0.03
    min_r2: float = 0.10
    max_jump: float = 0.15
    beta_min: float = 0.1
    beta_max: float = 3.0


@dataclass(frozen=True)
class GateConfig:
    """Daily decision: baselines, gates, warnings."""

    roll_n: int = 3
    base_days: int = 60
    shadow_days: tuple[int, int] = (42, 28)
    min_roll: int = 3
    min_base: int = 30
    min_shadow: tuple[int, int] = (21, 14)
    swc_mult: float = 0.5
    swc_floor: float = 0.04879
    veto_mult: float = 2.0
    decision_mode: str = "O2_SHADOW"
    tag_steps: tuple[float, float, float] = (0.5, 1.0, 2.0)
    warning_mode: str = "healthy85"
    healthy_start: str = "2025-07-01"
    healthy_end: str = "2025-09-30"
    healthy_factor: float = 0.85
    p20: float = 0.20
    bad_gates: tuple[str, ...] = ("ROJO",)


@dataclass(frozen=True)
class SessionConfig:
    """Sensor streams to training sessions."""

    gap_max_s: int = 60
    hr_drop_max: float = 10.0
    exit_s: int = 30
    smooth_s: int = 10
    min_block_s: int = 180
    late_rise: float = 8.0
    late_min_s: float = 2400.0
    drift_min_s: float = 1800.0
    drift_min_speed: float = 0.5
    moving_min_speed: float = 0.3
    skip_s: int = 600
    effort_days: int = 60
    effort_min_prev: int = 5
    anchor_start: str = "2025-06-01"
    anchor_end: str = "2025-08-31"


@dataclass(frozen=True)
class DfaConfig:
    """Fractal scaling windows and the beat layers under them."""

    win_beats: int = 300
    step_beats: int = 60
    scale_min: int = 4
    scale_max: int = 16
    min_core: float = 0.80
    min_strict: float = 0.70
    max_run: int = 12
    local_beats: int = 5
    local_rel: float = 0.18
    rmssd_s: int = 60
    rmssd_min_valid: float = 0.80
    rmssd_min_beats: int = 20


@dataclass(frozen=True)
class LevelConfig:
    """The heart rate at which alpha is 0.75."""

    target: float = 0.75
    bin_bpm: float = 3.0
    min_windows: int = 20
    min_r2: float = 0.55
    min_bins: int = 4
    min_per_bin: int = 3
    min_span: float = 0.15
    near: float = 0.05
    min_near: int = 6
    min_side: int = 4
