"""Schemas of the graph tables. Property values are tagged text, so that equality is typed: s:, i:, f:, b:."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, ntype string, summary string, props map<string,string>, content binary, context_sentence string, created_at bigint, updated_at bigint"
EDGES = "id string, etype string, src string, dst string, props map<string,string>"
ADJACENCY = "src string, dst string, weight double, provenance string"
EMBEDDINGS = "node_id string, model string, dim int, vector array<float>"
SPARSE = "node_id string, vocab_id string, indices array<int>, values array<float>"
TOMBSTONES = "node_id string, reason string, tombstoned_at bigint"
COMMITS = "cid string, parents array<string>, author string, time bigint, message string"
OPERATIONS = "cid string, parents array<string>, view string, author string, agent_id string, task_id string, time bigint, description string"
REFS = "name string, kind string, target string, adds array<string>, removes array<string>"

#: The reserved system node, hidden unless asked for.
ANCHOR = "00000000-0000-0000-0000-000000000001"


def tagged(value) -> str | Column:
    """A property value with its type: a Python value, or a column by its declared type (see `tag`)."""
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"f:{value!r}"
    return f"s:{value}"


def tag(column: str, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def untagged(column: Column) -> Column:
    return F.substring(column, 3, 2_000_000_000)
