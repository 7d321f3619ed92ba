"""Fixed values that must equal the published method for results to agree."""

# fixed values: kinematics and runs
NOMINAL_DT_S = 1.0 / 14.77
MIN_DT_S = 1e-6
SMOOTH_TAPS = 15
STATIONARY_BELOW_MS = 0.10
ALONG_ROW_ABOVE_MS = 0.30
CORRIDOR_GAP_M = 1.2
SUBSAMPLE_M = 1.5
MIN_HEADING_SPEED_MS = 0.05
PHASE_EDGE_BELOW, PHASE_DEEP_ABOVE = 0.34, 0.66

# fixed values: row fit
NEAR_M, FAR_M = 5.0, 10.0
SEED_HALF_M, INLIER_M, FAR_TOL_M, ADJACENT_GAP_M = 0.25, 0.25, 0.5, 0.7
SWEEP_SPAN_M, SWEEP_STEP_M, SWEEP_STEPS = 0.30, 0.05, 13
MIN_POINTS, MAX_ABS_Y_M, MIN_X_SPAN_M, MIN_DISTINCT_X = 3, 3.0, 1.0, 3
LOOK_M, STEEP_SLOPE, SLOPE_MISMATCH = 2.0, 0.3, 0.2
HALF_SPACING_PRIMARY_M, HALF_SPACING_SENSITIVITY_M = 1.2, 0.96

# fixed values: detections on the 640-pixel stretch
FRAME_PX, MID_PX = 640, 320
OVERSIZE_FRACTION, NEAR_FRACTION, MIN_COMPONENT_PX = 0.15, 0.10, 40

# fixed values: geometry filter applied to fitted frames
FILTER_OFFSET_M, FILTER_HEADING_DEG, FILTER_PARALLEL, FILTER_MIN_POINTS = 0.71, 6.7, 0.22, 12

# fixed values: model grid and paired comparison
ARMS, SEEDS = ("A", "B", "C"), (42, 43, 44)
PAIRS = (("A", "B"), ("A", "C"), ("B", "C"))
OFFSET_FLOOR_M = 0.038
HEADING_FLOOR_DEG = {"A": 1.33, "B": 1.36, "C": 1.29}

# fixed values: autocorrelation and block length
LAG_MAX_M, LAG_BIN_M, DECORR_FALLBACK_M = 3.0, 0.15, 1.5
DECORR_THRESHOLD, DECORR_THRESHOLD_STRICT = 0.1, 0.05
MIN_SAMPLES_PER_DECORR, MIN_BLOCKS = 3.0, 8

# fixed values: sweeps
CLASS_THRESHOLDS = (1, 2, 3, 5, 8, 12)
VIABLE_COVERAGE_PCT = 70.0
WINDOW_GRID_M = (5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 9.5, 10.0)
GAIN_GRID = {
    "kp": (0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.30),
    "kpsi": (0.0, 0.0005, 0.001, 0.002, 0.005),
    "kd": (0.0, 0.005, 0.02, 0.05),
    "ki": (0.0, 0.001, 0.003, 0.01),
}

# fixed values: command law
ZETA, SETTLE_M, SETTLE_FACTOR, TILT_DEG = 1.0, 20.0, 5.8, 2.31
SETTLE_GRID_M = (5.0, 10.0, 20.0, 30.0)
SPAN_SHORT_ROWS, SPAN_LONG_ROWS = 15, 74

# fixed values: sample matching
HIGH_SIMILARITY, COARSE_STRIDE, FINE_HALF, SHORTLIST = 0.60, 10, 30, 30
BAND_LOW, BAND_HIGH = 40, 200

# fixed values: surveyed lines and screening
LINE_REACH_M, MIN_TRAVEL_M, METRES_PER_DEG_LON, METRES_PER_DEG_LAT = 1.6, 0.15, 111320.0, 110540.0
SCREEN_CONF, DISTANT_FRACTION, MIN_LINE_ROWS = 0.20, 0.001, 40
