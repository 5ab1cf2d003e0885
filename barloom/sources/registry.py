"""The registry of captures: a JSON list of datasets, each pinned by the hash of its file."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from barloom.sources.captures import HEADERS

# Fixed value: the one partition policy.
POLICY = "first_calendar_year_only"


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    dataset_version: str
    filename: str
    source_sha256: str
    first_timestamp: str
    last_timestamp: str
    partition_policy: str = POLICY
    source_schema: str | None = None


def load(text: str) -> list[Dataset]:
    """Datasets of a registry, sorted by id. ValueError for a repeated id, a hash that is not 64 lower-case hex digits, an unknown schema or policy, or a missing field."""
    found: dict[str, Dataset] = {}
    entries = json.loads(text)
    if not isinstance(entries, list):
        raise ValueError("a registry is a list")
    for e in entries:
        try:
            d = Dataset(**{k: v for k, v in e.items() if k in Dataset.__dataclass_fields__})
        except TypeError as x:
            raise ValueError(f"incomplete entry: {x}") from None
        if d.dataset_id in found:
            raise ValueError(f"{d.dataset_id} is registered twice")
        if not re.fullmatch(r"[0-9a-f]{64}", d.source_sha256):
            raise ValueError(f"{d.dataset_id}: source_sha256 must be 64 lower-case hex digits")
        if d.source_schema is not None and d.source_schema not in HEADERS:
            raise ValueError(f"{d.dataset_id}: unknown schema {d.source_schema}")
        if d.partition_policy != POLICY:
            raise ValueError(f"{d.dataset_id}: unknown policy {d.partition_policy}")
        found[d.dataset_id] = d
    return [found[k] for k in sorted(found)]


def find(datasets: list[Dataset], dataset_id: str) -> Dataset:
    for d in datasets:
        if d.dataset_id == dataset_id:
            return d
    raise KeyError(f"no dataset {dataset_id}; known: {', '.join(d.dataset_id for d in datasets)}")
