"""Explicit schemas of the record files. Spellings that drift between files
are all listed; a reader never infers columns from a sample."""

TRIAL = (
    "problem_id string, task_id string, baseline string, passed boolean, iterations bigint, total_tokens bigint, "
    "tokens bigint, input_tokens bigint, output_tokens bigint, api_calls bigint, wall_time_seconds double, "
    "cost double, error string, stopped_reason string"
)
PAIR = (
    "task_id string, category string, run bigint, model string, ss_quality double, ss_meets string, ss_passed boolean, ss_tokens bigint, "
    "rv_quality double, rv_meets string, rv_passed boolean, rv_iters bigint, rv_iterations bigint, rv_tokens bigint, "
    "ss_accuracy double, rv_accuracy double, ss_rubric double, rv_rubric double, ss_n_defects bigint, rv_n_defects bigint, "
    "ss_final_code string, rv_final_code string, single_shot_quality double, single_shot_meets boolean, "
    "single_shot_passed boolean, single_shot_tokens bigint, reviewed_quality double, reviewed_meets boolean, "
    "reviewed_passed boolean, reviewed_tokens bigint, reviewed_iters bigint, quality_delta double"
)
CELL = "passed boolean, tokens_used bigint, num_turns bigint, wall_time_seconds double, error_message string, code_emitted string"
TASK = (
    "task_id string, bug_class string, name string, paper string, category string, description string, buggy_code string, "
    "fixed_code string, test_code string, common_bugs array<string>, requirements array<string>, expected_issues array<string>, "
    "viewport_sizes array<int>, frame_times_ms array<int>, source_video string, difficulty string"
)
VOTE = "rater_id string, pair_id string, modality string, choice string, rt_ms bigint, ts timestamp"
