"""Name-based ids: the same names give the same id wherever they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str | Column, name: Column) -> Column:
    """RFC 4122 version 5 of a name in a namespace given as UUID text."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(space, "-", "")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def tenant_namespace(tenant: str, root: str) -> str:
    """The namespace of a tenant below a root name."""
    return str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_DNS, root), tenant))
