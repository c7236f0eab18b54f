"""Schemas of the evaluation records."""

CASE = """case_id string, pack string, agent_type string, transcript string, artifacts array<struct<type string, content string>>,
expected_verdict array<string>, expected_flags array<string>, owner_map map<string, array<string>>, clean_negative boolean, split string"""
RUN = """case_id string, pack string, run_index int, started_at string, duration_ms bigint, verdict string, flags array<string>,
per_judge map<string, struct<verdict string, flags array<string>, confidence double, reason string>>, pin struct<backend string, model string, extra string>"""
CORRECTION = "schema_version string, case_id string, action string, flag_code string, verdict_before string, verdict_after string, contract string, split string"
EVENT_LOG = "seq bigint, ts string, actor string, target_type string, target_id string, action string, before string, after string"
