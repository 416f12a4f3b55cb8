"""Declared schemas of the tables that the engine reads and writes."""

from __future__ import annotations

FUNCTION = "struct<name: string, arguments: string>"
TOOL_CALL = f"struct<id: string, function: {FUNCTION}>"
MESSAGE = f"struct<role: string, content: string, tool_calls: array<{TOOL_CALL}>, tool_call_id: string>"
PROBLEM = "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string, version string"
VULNERABILITY = "hash string, is_vulnerable boolean, func string, cwe array<string>, cwe_description string"
PREDICTION = "instance_id string, model_name_or_path string, model_patch string"
ROLLOUT = "instance_id string, rollout_no int, status string, generated_diff string, messages array<struct<role: string, content: string>>, tools string"
TASK = "function_name string, docstring string, start_line int, end_line int, implementation string, masked_code string, n_body int, n_vars int, has_control boolean, is_property boolean, is_async boolean, literals array<string>"
BLOCKS = "array<struct<search: string, replace: string>>"
