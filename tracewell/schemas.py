"""Schemas of the records that are read and written, all nullable: fields may be missing in any generation of a file."""

TRACE = "prompt string, max_tokens int, text string, tokens array<string>, logprobs array<map<string, double>>, top_k_ids array<array<int>>, top_k_vals array<array<double>>, test_passed int, test_total int, fail_cause string"
SHORT_TRACE = "prompt string, attempts int, texts array<string>"
EVAL_RECORD = "name string, per_problem array<struct<idx bigint, solved boolean>>"
PLUS_RESULTS = "eval map<string, array<struct<plus_status string>>>"
RUN_EVENT = (
    "t double, kind string, pending int, total int, chunk_size int, idx int, of int, chunk_pass int, chunk_fail int, total_pass int, tested int, eta_s int, secs double, "
    "s_per_prompt double, pass_rate double, gpu_gb double, minutes double, fail_causes map<string, int>, by_difficulty map<string, struct<pass int, fail int, causes map<string, int>>>"
)
SCORED = "idx bigint, positions array<struct<token_id int, topk map<string, double>>>"
