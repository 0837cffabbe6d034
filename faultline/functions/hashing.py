"""Hashes over ordered values, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import NUL, _col

CACHE_VERSION = "v1"


def text_hash(value: Column | str) -> Column:
    return F.sha2(_col(value), 256)


def joined_hash(values: Column | str) -> Column:
    """Hash of an array's values in its order, NUL between."""
    return F.sha2(F.array_join(_col(values), NUL), 256)


def sorted_hash(value: Column | str) -> Column:
    """Aggregate: hash of a group's values, sorted, NUL between."""
    return joined_hash(F.array_sort(F.collect_list(_col(value))))


def constant_hash(type_name: Column | str, value: Column | str) -> Column:
    return F.sha2(F.concat(_col(type_name), F.lit(NUL), _col(value)), 256)


def type_shell_hash(name: Column | str, kind: Column | str, alias: Column | str, parameters: Column | str) -> Column:
    """Hash of a type without its members."""
    kind = F.when(_col(alias), F.concat(_col(kind), F.lit("="))).otherwise(_col(kind))
    return F.sha2(F.concat_ws(NUL, _col(name), kind, _col(parameters)), 256)


def with_metadata(node_hash: Column | str, metadata: Column | str) -> Column:
    """A declaration's hash, mixed with its build metadata if it has any."""
    m = F.coalesce(_col(metadata), F.lit(""))
    return F.when(m != "", F.sha2(F.concat(_col(node_hash), F.lit(NUL), m), 256)).otherwise(_col(node_hash))


def pairs(key: Column | str, value: Column | str) -> Column:
    return F.concat(_col(key), F.lit(NUL), _col(value), F.lit(NUL))


def cache_key(*parts: str) -> str:
    """Key of a cache entry."""
    return hashlib.sha256(NUL.join((CACHE_VERSION, *parts)).encode()).hexdigest()


def cache_key_column(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(NUL, F.lit(CACHE_VERSION), *[_col(p) for p in parts]), 256)
