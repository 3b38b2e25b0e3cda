"""Data contract and rule constants whose numbers decide results."""

# --- fixed values: cameras -------------------------------------------------
ANGLES = ("FL", "FR", "NL", "NR")
FAR_ANGLES = ("FL", "FR")
NEAR_ANGLES = ("NL", "NR")

# --- fixed values: shot classes --------------------------------------------
MAKE_CLASSES = ("3PT_MAKE", "FG_MAKE", "FREE_THROW_MAKE", "4PT_MAKE")
MISS_CLASSES = ("3PT_MISS", "FG_MISS", "FREE_THROW_MISS", "4PT_MISS")
SCOPE_CLASSES = ("3PT_MAKE", "FG_MAKE", "FREE_THROW_MAKE",
                 "3PT_MISS", "FG_MISS", "FREE_THROW_MISS", "4PT_MISS")

# --- fixed values: time ----------------------------------------------------
FPS = 29.97
WINDOW_BUFFER_S = 2.0

# --- fixed values: world geometry (cm) -------------------------------------
RIM_X, RIM_Y, RIM_Z = 2008.7, 713.2, 304.8
RIM_RADIUS = 22.86
BALL_RADIUS = 12.0
GRAVITY_CM = 980.665
COURT_BOUNDS = ((800.0, 2600.0), (0.0, 1430.0), (-50.0, 1100.0))
LOOSE_BOUNDS = ((0.0, 2400.0), (-200.0, 1700.0), (-50.0, 800.0))
NEAR_HOOP_BOX = (714.0, 826.0, 1138.0, 1080.0)
FAR_HOOP_BOX = (910.0, 297.0, 966.0, 364.0)

# --- fixed values: per-camera shot features --------------------------------
NEAR_RIM_RW = 1.5
THROUGH_X_TOL_RW = 1.0
FAR_LEFT_FRAME_RW = 6.0
ARC_HALF_ROWS = 12
ARC_MIN_POINTS = 5
BOUNCE_WINDOW_ROWS = 18
BOUNCE_MIN_RH = 0.6
BOUNCE_DROP_RH = 0.2
BOUNCE_KICK_RW = 0.75
SENTINELS = {
    "min_dist_rw": 10.0, "min_dist_frac_time": 0.5, "arc_fit_resid": 5.0,
    "arc_apex_dx_rw": 5.0, "cln_arc_fit_resid": 5.0, "cln_arc_apex_dx_rw": 5.0,
    "cln_min_dist_rw": 10.0,
}

# --- fixed values: track cleaning ------------------------------------------
SPIKE_RULERS = 2.5
SPIKE_RETURN = 0.5
MAX_GAP_FRAMES = 12
GAP_EDGE_CONF = 0.30

# --- fixed values: phrases of the trajectory verdict text, in match order ---
RULE_PHRASES = (
    ("gap-stop", "gap_stop"),
    ("rattled in", "rattle_make"),
    ("passed through rim plane", "cross_make"),
    ("lateral-centered crossing", "cross_y_override"),
    ("centered crossing", "bounceback_override"),
    ("smooth descent to", "smooth_make"),
    ("RIM-OUT", "rim_out"),
    ("rim-bounce", "bounce_back"),
    ("crossed rim plane", "cross_too_wide"),
    ("rattle rejected", "y_reject_rattle"),
    ("cross rejected", "y_reject_cross"),
    ("smooth descent rejected", "y_reject_smooth"),
    ("NR-rebound", "nr_rebound"),
    ("no clear make signal", "rule6_default"),
    ("CLEAN", "clean_far"),
    ("UNDECIDED", "undecided"),
)
CONFIDENT_MISS_PREFIXES = (
    "MISS (RIM-OUT", "MISS (rim-bounce", "MISS (crossed rim plane",
    "MISS (rattle rejected", "MISS (cross rejected",
    "MISS (smooth descent rejected", "MISS (NR-rebound", "MISS (CLEAN",
)
