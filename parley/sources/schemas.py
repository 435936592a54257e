"""Spark schemas of the experiment's records."""

from __future__ import annotations

TRANSITION = "struct<turn int, source string, dest string, event string, valid boolean, blocked_by_guard boolean, fired_by string>"
RECORD = (
    "struct<turn int, user_message string, user_beat int, beat_started_at_turn int, beat_completed_at_turn int, agent_reply string, model string, prompt_hash string, "
    "prompt_tokens int, output_tokens int, llm_latency_s double, turn_latency_s double, cached boolean, state_before string, state_after string, event string, intent string, "
    f"collected map<string,string>, transitions array<{TRANSITION}>>"
)
DIALOGUE = (
    "scenario_id string, agent string, repetition int, seed long, status string, error string, stop_reason string, termination_reason string, active_beat_complete boolean, "
    "goal_reached_seen boolean, goal_reached_at_turn int, script_complete_at_goal_reached boolean, failure_kind string, failure_reason string, failure_metadata string, "
    f"records array<{RECORD}>"
)
SCENARIO = (
    "id string, category string, intent string, user_persona string, user_goal string, script array<string>, required_facts array<string>, forbidden_facts array<string>, "
    "reference_answer string, expected_final_state string, success_criterion string, max_turns int, is_needle boolean, canary string"
)
LLM_CALL = "timestamp string, caller string, role string, model string, digest string, prompt_hash string, messages array<struct<role string, content string>>, text string, prompt_tokens int, output_tokens int, latency_s double, cached boolean, attempts int, error string"
MANIFEST = "exp_id string, seed long, fsm_hash string, dataset_hash string, jobs array<struct<scenario_id string, agent string, repetition int>>"
