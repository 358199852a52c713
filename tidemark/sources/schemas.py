"""Declared schemas of the package's own record types."""

LEDGER = "req_id bigint, ts timestamp_ntz, task string, model string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, cost decimal(18,6), kind string"
PRICES = "model string, full_per_m decimal(18,6), cached_per_m decimal(18,6), chunk bigint"
CATALOG = "cmd string, category string, descr string"
TOOL_SCHEMAS = "name string, descr string, schema_json string, essential boolean, tokens bigint"
SYMBOLS = "sym_id bigint, kind string, name string, file string, line_from int, line_to int, tokens bigint"
EDGES = "src bigint, dst bigint"
TOOL_OUTPUT = "run_id bigint, framework string, pos int, line string"
FSM_STEPS = "run_id bigint, seq int, state string, result_hash string"
ACTIVITY = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
COMMITS = "commit_id string, ts timestamp_ntz, origin string"
TEST_RUNS = "ts timestamp_ntz, suite string, status string"
