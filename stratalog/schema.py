"""The relations of the store."""

TEMPLATES = "template_id long, pattern string, occurrences long, created_at timestamp, updated_at timestamp"
ENTRIES = "entry_id long, template_id long, log_timestamp long, params array<string>, continuation_text string"
RAWS = "log_id long, content string, log_timestamp long, source string, created_at timestamp"
PLANS = "source_pattern string, final_pattern string"
GROUPS = "source string, seq long, header string, continuation array<string>, source_ts long"
