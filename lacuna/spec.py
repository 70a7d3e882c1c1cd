"""Column roles and parameter records (S-04, S-05, P-20)."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger("lacuna")


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of a modelling table.  The user vector is sparse ++ dense, in
    that order; ``row_id`` is the explicit row identity (never positional)."""

    item: str = "product_item"
    sparse: tuple[str, ...] = ()
    dense: tuple[str, ...] = ()
    row_id: str = "row_id"

    @property
    def features(self) -> list[str]:
        return list(self.sparse) + list(self.dense)

    def with_(self, **kw) -> "FeatureSpec":
        d = dict(item=self.item, sparse=self.sparse, dense=self.dense, row_id=self.row_id)
        d.update(kw)
        return FeatureSpec(**d)


def spec_from_metadata(meta: dict | str | Path, item: str = "product_item",
                       row_id: str = "row_id") -> FeatureSpec:
    """S-04: ``tables.table.columns.<c>.sdtype`` -> roles.  The target is
    skipped, categorical -> sparse, numerical -> dense, any other sdtype is
    ignored; metadata order is kept."""
    if not isinstance(meta, dict):
        meta = json.loads(Path(meta).read_text())
    declared = meta["tables"]["table"]["columns"]
    role = {"categorical": "sparse", "numerical": "dense"}
    found: dict[str, list[str]] = {"sparse": [], "dense": []}
    for column in (c for c in declared if c != item):
        part = role.get(declared[column].get("sdtype"))
        if part is not None:
            found[part].append(column)
    return FeatureSpec(item=item, row_id=row_id, **{k: tuple(v) for k, v in found.items()})


def metadata_schema(meta: dict, item: str = "product_item"):
    """Declared semantic schema -> StructType (categorical -> long,
    numerical -> double, ``Int64`` representation -> long)."""
    from pyspark.sql import types as T

    fields = []
    for name, info in meta["tables"]["table"]["columns"].items():
        if info.get("sdtype") == "categorical" or name == item:
            t = T.LongType()
        elif info.get("computer_representation") == "Int64":
            t = T.LongType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(name, t, True))
    return T.StructType(fields)


def load_params(path: str | Path) -> dict:
    """S-05: a flat JSON parameter (or seed) record; a missing file is ``{}``."""
    p = Path(path)
    if not p.exists():
        return {}
    return json.loads(p.read_text())


def pick_params(defaults: dict, overrides: dict, allowed: list[str]) -> dict:
    """Merge overrides over defaults, keep the whitelisted keys, log the rest
    (parameter files may carry keys a model ignores)."""
    merged = dict(defaults)
    merged.update(overrides or {})
    ignored = sorted(set(merged) - set(allowed))
    if ignored:
        log.info("ignoring parameters %s", ignored)
    return {k: merged[k] for k in allowed if k in merged}


def check_ratios(train_ratio: float, val_ratio: float) -> None:
    """P-20: the two split fractions must leave room for a test split."""
    left = 1 - train_ratio - val_ratio
    if left <= 0 or left >= 1:
        raise ValueError(f"train {train_ratio} and valid {val_ratio} leave {left:g} for the test split")


def check_choice(kind: str, name: str, allowed) -> None:
    if name not in allowed:
        raise ValueError(f"unknown {kind} {name!r}; expected one of {sorted(allowed)}")
