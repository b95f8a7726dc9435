"""Column contracts, in order. Every table also carries the key column `entity`, which comes first."""

from __future__ import annotations

# The column names of the exchanged tables.
CORE = (
    "Fecha Calidad HRV_Stability Stability_Subtype Artifact_pct Tiempo_Estabilizacion HR_stable RRbar_s RMSSD_stable RMSSD_stable_last2 "
    "tail_mismatch_pct lnRMSSD Flags SI_baevsky SD1 SD2 SD1_SD2_ratio Notes"
).split()
AUDIT = (
    "Fecha HR_stable RRbar_s RMSSD_stable lnRMSSD cRMSSD beta_mode beta_est_90d beta_use_90d R2_winsor_90d Color_Agudo_Diario Color_Tendencia Color_Tiebreak"
).split()
FINAL = (
    "Fecha Calidad HRV_Stability Artifact_pct Tiempo_Estabilizacion Stability_Subtype tail_mismatch_pct HR_today RMSSD_stable lnRMSSD_today "
    "lnRMSSD_used HR_used n_roll3 gate_raw_today gate_raw_reason unstable_note ln_base60 HR_base60 n_base60 SWC_ln SWC_HR d_ln d_HR "
    "gate_base60 gate_razon_base60 gate_shadow42 gate_razon_shadow42 n_base42 gate_shadow28 gate_razon_shadow28 n_base28 "
    "decision_mode gate_final gate_final_delta decision_path override_reason residual_ln residual_z residual_tag gate_badge quality_flag "
    "Color_operativo Action Action_detail bad_streak bad_7d baseline60_degraded healthy_rmssd healthy_hr healthy_period flag_sistemico flag_razon "
    "warning_threshold warning_mode veto_agudo ln_pre_veto swc_ln_floor reason_text"
).split()
DASHBOARD = "Fecha Calidad HR_today RMSSD_stable gate_badge Action gate_razon_base60 decision_path baseline60_degraded reason_text".split()
SESSIONS = (
    "session_id Fecha start_time sport sport_raw source vt1_used vt2_used zones_source duration_min moving_min distance_km elev_gain_m elev_loss_m "
    "elev_density hr_mean hr_max hr_p95 z1_pct z2_pct z3_pct z2_total_min z3_total_min work_blocks_min work_blocks_z3pct work_n_blocks work_total_min "
    "work_longest_min work_avg_z3_pct late_intensity cardiac_drift_pct intensity_category session_group load effort_vs_recent effort_vs_anchor rpe feel "
    "rpe_present notes_present notes_raw stream_dt_est pipeline_version"
).split()
DAYS = (
    "Fecha n_sessions total_duration_min has_aerobic has_strength has_mobility load_day intensity_cat_day work_total_min_day work_n_blocks_day z3_min_day "
    "hr_max_day hr_p95_max_day late_intensity_day cardiac_drift_worst elev_gain_day elev_loss_day strength_min_day mobility_min_day rpe_max_day "
    "effort_above_typical_aerobic effort_above_typical_strength effort_above_anchor_aerobic n_with_rpe n_with_notes elev_density_day z3_7d_sum z3_7d_nobs "
    "work_7d_sum work_7d_nobs finish_strong_7d_count load_3d load_3d_nobs load_7d load_7d_nobs load_14d load_14d_nobs load_28d load_28d_nobs elev_loss_7d_sum"
).split()
SLEEP = (
    "Fecha polar_sleep_duration_min polar_sleep_span_min polar_deep_pct polar_rem_pct polar_efficiency_pct polar_continuity polar_continuity_index "
    "polar_interruptions_long polar_interruptions_total polar_sleep_score polar_night_rmssd polar_night_rri polar_night_resp sleep_dur_p10 sleep_dur_p90 sleep_int_p90"
).split()

# Gates in rising order, and the gate of no decision.
GATES = ("VERDE", "ÁMBAR", "ROJO")
NO_GATE = "NO"
VERDE, AMBAR, ROJO = GATES

# Provider sport -> sport.
SPORTS = {
    "TrailRun": "trail_run", "Hike": "hike", "Run": "road_run", "VirtualRun": "road_run", "Ride": "bike", "VirtualRide": "bike",
    "Swim": "swim", "Elliptical": "elliptical", "WeightTraining": "strength", "Workout": "mobility", "Other": "other",
}
AEROBIC = ("trail_run", "hike", "road_run", "bike", "swim", "elliptical")
# Default thresholds (first, second) by sport, in beats per minute.
THRESHOLDS = {
    "trail_run": (143, 161), "hike": (143, 161), "road_run": (143, 161), "bike": (139, 156), "swim": (134, 149), "elliptical": (139, 156),
    "strength": (142, 163), "mobility": (142, 163), "other": (143, 161),
}
