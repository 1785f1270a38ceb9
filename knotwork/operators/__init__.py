"""Operators of the graph engine: each takes DataFrames and returns a DataFrame.

Tables (see ``knotwork.schema``): nodes(repo, local_id, label, source_file, repo_path, community), edges(source_repo, source,
target_repo, target, relation, confidence, ...), hyperedges, anchors(label, idx, anchors), labels(repo, community, name).
Everything durable is keyed on (repo, local_id); community numbers are ephemeral.
"""
