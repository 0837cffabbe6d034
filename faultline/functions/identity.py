"""Identities of symbols and packages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"
#: Kinds of synthetic dispatch symbols (fixed values of the id format).
DISPATCH_KINDS = ("interface-trace", "interface-selection", "interface-field", "dependency-interface")
CONTENT, PACKAGE_INIT = "package::$content", "package-init::$init"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def object_id(package: Column | str, kind: Column | str, name: Column | str) -> Column:
    return F.concat_ws("::", _col(package), _col(kind), _col(name))


def receiver_name(receiver: Column | str) -> Column:
    """A method's receiver without one leading pointer mark."""
    return F.regexp_replace(_col(receiver), r"^\*", "")


def function_id(package: Column | str, name: Column | str, receiver: Column | str, file: Column | str, init_index: Column | str) -> Column:
    """Id of a function, method or init declaration."""
    package, name, receiver = _col(package), _col(name), _col(receiver)
    return (
        F.when((name == "init") & receiver.isNull(), F.concat_ws("::", package, F.lit("init"), _col(file), _col(init_index).cast("string")))
        .when(receiver.isNotNull(), object_id(package, F.lit("method"), F.concat(receiver_name(receiver), F.lit("."), name)))
        .otherwise(object_id(package, F.lit("func"), name))
    )


def blank_prefix(package: Column | str) -> Column:
    return F.concat(_col(package), F.lit("::blank-initializer::"))


def blank_id(package: Column | str, file: Column | str, index: Column | str) -> Column:
    return F.concat(blank_prefix(package), F.concat_ws("::", _col(file), _col(index).cast("string")))


def package_init_id(package: Column | str) -> Column:
    return F.concat(_col(package), F.lit(f"::{PACKAGE_INIT}"))


def content_id(package: Column | str) -> Column:
    return F.concat(_col(package), F.lit(f"::{CONTENT}"))


def embed_file_id(package: Column | str, relative: Column | str) -> Column:
    return object_id(package, F.lit("embed-file"), relative)


def member_id(package: Column | str, kind: Column | str, owner: Column | str, name: Column | str, position: Column | str) -> Column:
    """Id of a struct field or interface method; unnamed ones by position."""
    named = F.coalesce(_col(name), F.concat(F.lit("$embed"), _col(position).cast("string")))
    return object_id(package, kind, F.concat(_col(owner), F.lit("."), named))


def dispatch_id(declaration: Column | str, kind: Column | str, index: Column | str, package: Column | str, dependencies: Column | str) -> Column:
    """Ends in a hash of the package and the sorted dependencies."""
    body = F.concat(_col(package), F.when(F.size(_col(dependencies)) > 0, F.concat(F.lit(NUL), F.array_join(_col(dependencies), NUL))).otherwise(F.lit("")))
    return F.concat_ws("::", _col(declaration), _col(kind), _col(index).cast("string"), F.sha2(body, 256))


def is_dispatch(symbol: Column | str) -> Column:
    return _col(symbol).rlike("::(" + "|".join(DISPATCH_KINDS) + ")::")


def relative_path(module: Column | str, package: Column | str) -> Column:
    """A package path below its module; the module itself by its last part."""
    module, package = _col(module), _col(package)
    return (
        F.when(package == module, F.element_at(F.split(module, "/"), -1))
        .when(F.startswith(package, F.concat(module, F.lit("/"))), F.substr(package, F.length(module) + 2))
        .otherwise(package)
    )


def display_name(relative: Column | str, name: Column | str) -> Column:
    return F.concat(_col(relative), F.lit("."), _col(name))


def module_identity(path: Column | str, version: Column | str, replaced_path: Column | str, replaced_version: Column | str) -> Column:
    """path@version, with the replacement after an arrow if there is one."""
    base = F.concat(_col(path), F.lit("@"), F.coalesce(_col(version), F.lit("")))
    other = F.concat(F.lit("=>"), _col(replaced_path), F.lit("@"), F.coalesce(_col(replaced_version), F.lit("")))
    return F.when(_col(replaced_path).isNotNull(), F.concat(base, other)).otherwise(base)


def sum_keys(path: Column | str, version: Column | str) -> Column:
    """The two checksum keys of a module version; none if either is empty."""
    key = F.concat(_col(path), F.lit("@"), _col(version))
    whole = (F.coalesce(_col(path), F.lit("")) != "") & (F.coalesce(_col(version), F.lit("")) != "")
    return F.when(whole, F.array(key, F.concat(key, F.lit("/go.mod")))).otherwise(F.array().cast("array<string>"))
