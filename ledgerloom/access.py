"""Roles, the layers they may read, and the policies of the mart.

Cooperative, not a security boundary: whoever holds the session can read its files.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import mask_abn

LAYERS = ("bronze", "silver", "gold", "mart")


class Role(Enum):
    ENGINEER = "engineer"
    CI = "ci"
    ANALYST = "analyst"


READABLE = {Role.ENGINEER: set(LAYERS), Role.CI: {"bronze"}, Role.ANALYST: {"mart"}}


def masked(rows: DataFrame, roles: set[Role], column: str = "supplier_abn") -> DataFrame:
    """The number in full for an engineer, whichever of the roles is active; its last three digits for all others."""
    return rows if Role.ENGINEER in roles else rows.withColumn(column, mask_abn(F.col(column)))


def attributable_only(rows: DataFrame, roles: set[Role]) -> DataFrame:
    """The row policy, defined but attached to nothing unless asked for."""
    return rows if Role.ENGINEER in roles else rows.where("is_attributable")


class Facade:
    """Resolves tables for a set of roles; mart views are built with the engine's own rights."""

    def __init__(self, models, roles: set[Role]):
        self.models, self.roles = models, roles

    def table(self, name: str) -> DataFrame:
        layer = self.models.layer(name)
        if not any(layer in READABLE[r] for r in self.roles):
            raise PermissionError(f"{', '.join(sorted(r.value for r in self.roles))} may not read {layer}")
        rows = self.models.build(name)
        return masked(rows, self.roles) if layer == "mart" and "supplier_abn" in rows.columns else rows
