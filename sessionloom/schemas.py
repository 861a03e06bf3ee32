"""Entities of the engine as DDL strings (data model, tables of sessions, facts, memory, tags)."""

CONVERSATIONS = "id string, project_path string, source_type string, external_id string, first_message_at long, last_message_at long, message_count long, git_branch string, version string, created_at long, updated_at long"
MESSAGES = "id string, conversation_id string, external_id string, parent_external_id string, message_type string, role string, content string, timestamp long, is_sidechain boolean, agent_id string, request_id string, git_branch string, cwd string"
TOOL_USES = "id string, message_id string, external_id string, tool_name string, tool_input string, timestamp long"
TOOL_RESULTS = "id string, tool_use_id string, message_id string, content string, is_error boolean, stdout string, stderr string, is_image boolean, timestamp long"
FILE_EDITS = "id string, conversation_id string, file_path string, message_id string, backup_version long, backup_time long, snapshot_timestamp long"
THINKING_BLOCKS = "id string, message_id string, thinking_content string, signature string, timestamp long"
DECISIONS = "id string, conversation_id string, message_id string, decision_text string, rationale string, alternatives array<string>, context string, timestamp long"
COMMITS = "hash string, message string, author string, timestamp long, branch string, files_changed array<string>"
WORKING_MEMORY = "project_path string, key string, value string, context string, tags array<string>, session_id string, created_at long, updated_at long, expires_at long, confidence string, importance string, pinned boolean, archived boolean, verified_at long"
HANDOFFS = "id string, from_session_id string, project_path string, created_at long, handoff_data string, resumed_by_session_id string, resumed_at long"
TAGS = "id long, name string, project_path string, description string, color string, created_at long, updated_at long"
ITEM_TAGS = "tag_id long, item_type string, item_id long, created_at long"

#: Upsert keys by table.
KEYS = {
    "conversations": ["project_path", "source_type", "external_id"],
    "messages": ["conversation_id", "external_id"],
    "tool_uses": ["message_id", "external_id"],
    "tool_results": ["id"],
    "file_edits": ["id"],
    "thinking_blocks": ["id"],
    **dict.fromkeys(("decisions", "mistakes", "requirements", "validations", "methodologies", "research_findings", "solution_patterns", "session_handoffs", "maintenance_log", "chunk_embeddings"), ["id"]),
    "embeddings": ["message_id"],
    "fact_embeddings": ["kind", "id"],
    "index_runs": ["project_path", "at"],
    "git_commits": ["hash"],
    "working_memory": ["project_path", "key"],
}
