"""Fixed values that must equal the reference tool's for the same results.

They are stated here once, in natural order, and used everywhere else.
"""

# --- fixed values: side spellings -------------------------------------------
# Spellings accepted for side A and side B (compared in lower case).
SIDE_A_SPELLINGS = ("ca", "a", "1", "primary", "p")
SIDE_B_SPELLINGS = ("cb", "b", "2", "standby", "s")
SIDE_A = "CA"
SIDE_B = "CB"

# --- fixed values: namespace aliases -----------------------------------------
# Old namespace names and what they now mean (compared in lower case).
NAMESPACE_ALIASES = {
    "crla": "va",
    "crlb": "vb",
    "crla-readonly": "va-readonly",
    "crlb-readonly": "vb-readonly",
}
# Known namespaces, returned in lower case; any other name passes unchanged.
KNOWN_NAMESPACES = ("va", "vb", "va-readonly", "vb-readonly", "system")
MAIN_NAMESPACE = {SIDE_A: "va", SIDE_B: "vb"}
READONLY_SUFFIX = "-readonly"

# --- fixed values: status vocabularies ---------------------------------------
# Words looked for in a replication status text when starting replication.
START_STATUS_VOCAB = ("replicating", "initializing", "paused", "error", "offline", "stopped")
# Words looked for in a read-only namespace's data_state when starting.
START_STATE_VOCAB = ("add", "ready", "initializing", "replicating", "offline", "error")
# Words looked for in the status text when restarting replication.
RESTART_STATUS_VOCAB = ("replicating", "initializing", "scan")
# Words looked for in the data_state when restarting replication.
RESTART_STATE_VOCAB = ("ready", "initializing", "replicating", "offline", "error")

# --- fixed values: truth words for stored flags -------------------------------
TRUE_WORDS = ("1", "true", "yes", "on")

# --- fixed values: table-name check ------------------------------------------
TABLE_NAME_PATTERN = r"^[A-Za-z0-9_.]+$"
DEFAULT_TABLE = "movr.users"

# --- fixed values: control-state keys ----------------------------------------
REPL_ATOB_ACTIVE = "REPL_ATOB_ACTIVE"
REPL_BTOA_ACTIVE = "REPL_BTOA_ACTIVE"
FAILOVER_ATOB_DONE = "FAILOVER_ATOB_DONE"
FAILOVER_BTOA_DONE = "FAILOVER_BTOA_DONE"
LOAD_MOVR_OK = "LOAD_MOVR_OK"
LOAD_MOVR_VB_OK = "LOAD_MOVR_VB_OK"

# --- fixed values: poll and watch budgets -------------------------------------
# Effective replication poll budget (90 tries, 2 s apart).
MAX_ITERS = 90
POLL_INTERVAL_S = 2
# Ready poll budget on failover (30 tries, 10 s apart).
READY_MAX_ITERS = 30
READY_POLL_INTERVAL_S = 10
# Count watch: 12 ticks, 5 s apart.
WATCH_TICKS = 12
WATCH_EVERY = "5 seconds"

# --- verdict words (ours) -----------------------------------------------------
MATCH, MISMATCH, WAITING = "match", "mismatch", "waiting"
INSERT, UPDATE, DELETE = "insert", "update", "delete"
UPSERT = "upsert"
