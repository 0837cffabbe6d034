"""Row types of the engine's relations."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REVISION = _struct(role=S, repository=S, root=S, subdir=S, commit=S, tree=S)
PACKAGE = _struct(path=S, name=S, relative_path=S, hash=S, imports=T.ArrayType(S))
SYMBOL = _struct(id=S, package_path=S, hash=S, dependencies=T.ArrayType(S))
#: One snapshot as a JSON document.
SNAPSHOT = _struct(tree=S, module_path=S, module_hash=S, packages=T.MapType(S, PACKAGE), symbols=T.MapType(S, SYMBOL))
#: Normalised relations; ``rev`` is ``old`` or ``new``.
PACKAGES = T.StructType([T.StructField("rev", S), *PACKAGE.fields])
SYMBOLS = _struct(rev=S, id=S, package_path=S, hash=S)
DEPS = _struct(rev=S, sym=S, dep=S)
PACKAGE_MODULES = _struct(rev=S, package_path=S, modules=T.ArrayType(S), sum_keys=T.ArrayType(S))
SUMS = _struct(rev=S, key=S, value=S)
MODULE_CONFIG = _struct(rev=S, global_hash=S)
EDGES = _struct(src=S, dst=S)
