"""Writers: Parquet tables first; JSON documents and reports for small results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import corpus


def write_tables(nodes: DataFrame, edges: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """The graph as Parquet, nodes by repo and edges by the repo of their source: a filter on a chunk reads its files only."""
    nodes.write.mode(mode).partitionBy("repo").parquet(f"{folder}/nodes")
    edges.write.mode(mode).partitionBy("source_repo").parquet(f"{folder}/edges")


def write_graph_document(path: Path, nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None, meta: dict | None = None, links: str = "links") -> int:
    """One JSON document {directed, multigraph, graph, nodes, links}; returns the number of nodes, of which there must be some.

    Rows are streamed, a partition at a time, so the document may be larger than memory. Nulls are left out.
    """

    def rows(df: DataFrame) -> Iterator[str]:
        return (r[0] for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator())

    def write(out, df: DataFrame | None) -> int:
        n = 0
        for text in rows(df) if df is not None else ():
            out.write((",\n" if n else "") + text)
            n += 1
        return n

    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as out:
        out.write('{"directed": false, "multigraph": false, "graph": {"hyperedges": [')
        write(out, hyperedges)
        out.write("]" + "".join(f", {json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in (meta or {}).items()) + '}, "nodes": [')
        n = write(out, nodes)
        out.write(f'], "{links}": [')
        write(out, edges)
        out.write("]}\n")
    if not n:
        part.unlink()
        raise ValueError("a graph without nodes isn't written")
    part.replace(path)
    return n


def write_anchors(anchors: DataFrame, path: Path, count: int) -> int:
    """One anchor file: {"anchor_count", "communities": [{"label", "size", "anchors"}]} in the order of ``entry``.

    anchors: entry, label, anchors, and size if known: a row a curated name.
    """
    size = F.col("size") if "size" in anchors.columns else F.size("anchors")
    found = [r.asDict() for r in anchors.select("entry", "label", size.alias("size"), "anchors").orderBy("entry").toLocalIterator()]
    entries = [{"label": r["label"], "size": r["size"], "anchors": list(r["anchors"])} for r in found]
    path.write_text(json.dumps({"anchor_count": count, "communities": entries}, indent=1, ensure_ascii=False) + "\n", encoding="utf-8")
    return len(entries)


def write_manifest(manifest: DataFrame, folder: Path) -> int:
    """_manifest.json of a folder: [{"chunk", "total", "output", "files"}] in the order of chunks."""
    folder.mkdir(parents=True, exist_ok=True)
    rows = [{"chunk": r["chunk"], "total": r["total"], "output": str((folder / r["output"]).resolve()), "files": list(r["files"])} for r in manifest.orderBy("chunk").toLocalIterator()]
    (folder / "_manifest.json").write_text(json.dumps(rows, indent=1, ensure_ascii=False), encoding="utf-8")
    return len(rows)


def label_document(labels: DataFrame) -> DataFrame:
    """repo, document: each repo's names by community, ordered by number."""
    pairs = F.array_sort(F.collect_list(F.struct("community", "name")))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["community"].cast("string"), p["name"])))
    return labels.where("community IS NOT NULL AND name IS NOT NULL").groupBy("repo").agg(F.to_json(entries).alias("document"))


def write_labels(labels: DataFrame, folder: Path) -> dict[str, int]:
    """One label file a repo (the chunk map is small); repos without names keep their file. Returns names written by repo."""
    out = {}
    for row in label_document(labels).toLocalIterator():
        names = json.loads(row["document"])
        (folder / f"{row['repo']}.json").write_text(json.dumps(names, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        out[row["repo"]] = len(names)
    return out


def report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a small result; a larger one is cut, and says so."""
    found = rows.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r) + " |" for r in found[:most]]
    return "\n".join(lines + (["", f"(the first {most:,} rows)"] if len(found) > most else [])) + "\n"


def checks_report(checks: DataFrame) -> str:
    """A line a check, the failed ones first, then how many there are of each kind."""
    kinds = ["failed", "warned", "passed"]
    found = sorted(((2 if r["ok"] else 1 if r["severity"] == "warn" else 0, r["check"], r["detail"]) for r in checks.collect()), key=lambda x: x[0])
    lines = [f"- {kinds[k]}: {name} ({detail})" for k, name, detail in found]
    return "\n".join([*lines, "", ", ".join(f"{sum(x[0] == k for x in found)} {kind}" for k, kind in enumerate(kinds)), ""])


def coverage_report(covered: DataFrame) -> str:
    """How many files are claimed and how many aren't, by folder, and what is left out on purpose."""
    totals = {r["status"]: r["count"] for r in covered.groupBy("status").count().collect()}
    lines = [f"Claimed files: {totals.get('claimed', 0):,}", f"Unclaimed code files: {totals.get('code', 0):,}", f"Unclaimed data files: {totals.get('data', 0):,}"]
    for status in ("code", "data"):
        found = [f"   {r['top']:28s} {r['n']:>6,}" for r in corpus.unclaimed_by_top(covered, status).collect()]
        lines += [f"\nUnclaimed {status} by folder:", *found] if found else []
    if not totals.get("code") and not totals.get("data"):
        lines.append("\nEvery file belongs to a chunk.")
    left = [f"   {r['n']:>4,}  {r['reason']}" for r in corpus.excluded_by_reason(covered).collect()]
    return "\n".join(lines + (["\nLeft out on purpose:", *left] if left else [])) + "\n"


def chunks_report(validated: DataFrame, most: int = 20) -> str:
    """How many chunks have come back and what they hold, and the first of those that are missing or can't be used."""
    t = validated.agg(F.count("*").alias("all"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")).first()
    lines = [f"Chunks: {t['ok']:,} of {t['all']:,}, {t['nodes'] or 0:,} nodes, {t['edges'] or 0:,} edges"]
    for status in ("missing", "invalid"):
        lost = [r["chunk"] for r in validated.where(F.col("status") == status).orderBy("chunk").limit(most + 1).collect()]
        if lost:
            lines.append(f"{status}: {', '.join(map(str, lost[:most]))}" + (" ..." if len(lost) > most else ""))
    return "\n".join(lines) + "\n"


def audit_report(audited: DataFrame, chunk: str) -> str:
    """A stale mapping in one line, or the names that share nothing with their community."""
    found = audited.collect()
    lost = sorted((r["community"], r["name"], r["note"] or "nothing in common") for r in found if not r["matched"])
    if found and found[0]["stale"]:
        return f"{chunk}: the numbers are stale, {len(lost)} of {len(found)} names don't fit; synchronise first\n"
    return "\n".join([f"{chunk}: {len(found) - len(lost)} of {len(found)} names fit", *(f"- {number}: {name} ({why})" for number, name, why in lost)]) + "\n"


def bench_report(ratios: DataFrame, totals: DataFrame, suite: str) -> str:
    """The cost in tokens of each question, and of all."""
    t = totals.first()
    lines = ["# Tokens of an answer from the graph and of its sources", "", f"{t['questions']} questions, suite {suite[:12]}", "", "| question | answer | files | in files | ratio |", "|---|--:|--:|--:|--:|"]
    lines += [f"| {r['qid']} | {r['graph_tokens']:,} | {r['source_files']} | {r['source_tokens']:,} | {r['ratio']}x |" for r in ratios.orderBy("qid").collect()]
    return "\n".join([*lines, f"| **total** | **{t['graph_tokens']:,}** | | **{t['source_tokens']:,}** | **{t['ratio']}x** |", "", f"Median {t['median_ratio']}x a question.", ""])
