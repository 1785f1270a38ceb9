"""Schemas of the graph documents. They are declared, never inferred: many columns are null throughout a file."""

from __future__ import annotations

NODE = "id STRING, label STRING, file_type STRING, source_file STRING, source_location STRING, source_url STRING, captured_at STRING, author STRING, contributor STRING, rationale STRING, community BIGINT, repo_path STRING, local_id STRING, repo STRING, community_key STRING, community_name STRING"
EDGE = "source STRING, target STRING, relation STRING, confidence STRING, confidence_score DOUBLE, weight DOUBLE, source_file STRING, source_location STRING, context STRING, _origin STRING"
HYPEREDGE = "id STRING, label STRING, nodes ARRAY<STRING>, relation STRING, confidence STRING, confidence_score DOUBLE, source_file STRING"


def _struct(ddl: str) -> str:
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        fields.append(f"{name}: {kind}")
    return f"STRUCT<{', '.join(fields)}>"


FRAGMENT = f"nodes ARRAY<{_struct(NODE)}>, edges ARRAY<{_struct(EDGE)}>, hyperedges ARRAY<{_struct(HYPEREDGE)}>, input_tokens BIGINT, output_tokens BIGINT"
GRAPH = f"directed BOOLEAN, multigraph BOOLEAN, graph STRUCT<hyperedges: ARRAY<{_struct(HYPEREDGE)}>, chunks: ARRAY<STRING>>, nodes ARRAY<{_struct(NODE)}>, links ARRAY<{_struct(EDGE)}>, edges ARRAY<{_struct(EDGE)}>"
ANCHORS = "anchor_count INT, communities ARRAY<STRUCT<label: STRING, size: INT, anchors: ARRAY<STRING>>>"
QUESTIONS = "meta STRUCT<description: STRING, version: INT>, questions ARRAY<STRUCT<id: STRING, question: STRING, mode: STRING, depth: INT, token_budget: INT>>"
TASKS = "tasks ARRAY<STRUCT<id: STRING, instrument: STRING, summary: STRING, prompt: STRING, retrieval: ARRAY<STRUCT<tool: STRING, args: MAP<STRING, STRING>>>, rubric: ARRAY<STRUCT<id: STRING, desc: STRING, any: ARRAY<STRING>>>>>"
CHUNKS = "name STRING, root STRING, targets ARRAY<STRING>, kind STRING, note STRING, labelled BOOLEAN"
