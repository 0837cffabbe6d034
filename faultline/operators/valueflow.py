"""Which types and functions an expression may hold, as relational rules.

Facts come as relations (see README).  Rules that pass a value through
(parentheses, indexing, receiving, literals' elements, append, conversions) are
edges from the inner to the outer expression; candidates are carried over them
by a labelled closure.  Weaker rules apply only where stronger ones gave
nothing, as anti joins after the stronger ones have settled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..runtime import materialize
from .closure import labelled_closure

#: Kinds of expressions through which candidates pass (fixed values).
PASS_THROUGH = ("paren", "index", "index_list", "recv", "append", "literal", "convert", "address")

#: Nodes that ask alike and share a task, targets that are made distinct at once, and those that go through a node's rows together.
BLOCK_NODES, PART_TARGETS, RUN_TARGETS = 32768, 4096, 256

#: Rows of the result and nodes that a task gets at most, more or less; beyond so many tasks it gets more.
TASK_ROWS, TASK_NODES, MOST_TASKS = 2**27, 2**19, 4096


def carried(expr: DataFrame, base: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(node, label): base candidates at their node and at all that pass it on.

    ``expr(node, parent, parent_kind)``, ``base(node, label)``; ``results(src,
    dst)`` are further ways, those of ``result_edges``.
    """
    edges = expr.where(F.col("parent_kind").isin(*PASS_THROUGH)).select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    if results is not None:
        edges = edges.unionByName(results.select("src", "dst"))
    return labelled_closure(edges, base)


def result_edges(calls: DataFrame, targets: DataFrame, returns: DataFrame) -> DataFrame:
    """(src, dst): from each returned expression to the calls that may yield it.

    ``calls(call, callee, result)``: the call expression, what is called, and
    which result is taken; ``targets(node, label)``: functions the callee may
    denote; ``returns(function, result, node)``: the function's own returns, a
    bare one with the names of its results.
    """
    called = calls.join(targets.select(F.col("node").alias("callee"), F.col("label").alias("function")), "callee")
    return called.join(returns, ["function", "result"]).select(F.col("node").alias("src"), F.col("call").alias("dst")).distinct()


def fallback(*layers: DataFrame) -> DataFrame:
    """(node, label) of the first layer that has the node; no layer has a row twice."""

    def add(have: DataFrame, weaker: DataFrame) -> DataFrame:
        return have.unionByName(weaker.join(have.select("node").distinct(), "node", "left_anti"))

    return reduce(add, layers)


def expression_types(nodes: DataFrame, expr: DataFrame, bindings: DataFrame, types: DataFrame, assertions: DataFrame, assignable: DataFrame, results: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """(node, label): candidate types.

    ``nodes(node, object, static_type)``; identifiers take their object's
    ``bindings(obj, type)``; ``assertions(node, inner, type)`` keep the asserted
    type if concrete, else the inner candidates assignable to it; where nothing
    is known the static type counts unless it is an interface.  ``results`` are
    the ways of call results; ``given(node, label)`` are types known by other
    rules, as those of fields that are read.
    """
    named = nodes.join(bindings.select(F.col("obj").alias("object"), F.col("type").alias("label")), "object").select("node", "label")
    if given is not None:
        named = named.unionByName(given.select("node", "label"))
    concrete = types.where("not is_interface").select(F.col("type_id").alias("type"))
    asserted = assertions.join(concrete, "type", "left_semi").select("node", F.col("type").alias("label"))
    if results is not None:
        results = materialize(results)
    strong = carried(expr, named.unionByName(asserted), results)
    loose = materialize(assertions.join(concrete, "type", "left_anti"))
    if not loose.isEmpty():
        filtered = loose.join(strong.withColumnRenamed("node", "inner"), "inner")
        filtered = filtered.join(assignable.select(F.col("from_type").alias("label"), F.col("to_type").alias("type")), ["label", "type"]).select("node", "label")
        strong = strong.unionByName(carried(expr, filtered, results)).distinct()
    static = nodes.join(concrete.withColumnRenamed("type", "static_type"), "static_type", "left_semi").select("node", F.col("static_type").alias("label"))
    return fallback(strong, static.distinct())


def two_pass_bindings(stores: DataFrame, base: DataFrame) -> DataFrame:
    """(obj, type): bindings after exactly two passes over the stores.

    ``stores(obj, from_obj)`` copies another object's candidates, ``base(obj,
    type)`` are candidates known by themselves; chains of more than two copies
    stay open, as in the rules that this models.
    """
    known = base.select("obj", "type").distinct()
    for _ in range(2):
        moved = stores.join(known.withColumnRenamed("obj", "from_obj"), "from_obj").select("obj", "type")
        known = materialize(known.unionByName(moved).distinct())
    return known


def accepted(bindings: DataFrame, targets: DataFrame, types: DataFrame, assignable: DataFrame) -> DataFrame:
    """(obj, type): bindings whose type fits the interface (or element) that
    ``targets(obj, type_id)`` declares."""
    own = F.when(F.col("kind").isin("slice", "array", "map", "chan"), F.col("elem_type_id")).otherwise(F.col("type_id"))
    slots = targets.join(types.select("type_id", "kind", "elem_type_id"), "type_id").select("obj", own.alias("to_type"))
    interfaces = types.where("is_interface").select(F.col("type_id").alias("to_type"))
    slots = slots.join(interfaces, "to_type", "left_semi")
    fits = assignable.select(F.col("from_type").alias("type"), "to_type")
    return bindings.join(slots, "obj").join(fits, ["type", "to_type"], "left_semi").select("obj", "type").distinct()


def field_bindings(stores: DataFrame, reads: DataFrame, nodes: DataFrame, expr: DataFrame, bindings: DataFrame, types: DataFrame, assertions: DataFrame, assignable: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(field, type): candidate types of struct fields after exactly two passes.

    ``stores(field, type_id, node)`` are values put into a field of that type by
    a literal or an assignment, ``reads(node, field)`` expressions that read
    one.  The second pass knows what the first found, for all stores alike: an
    order of declarations within a pass, which may close longer chains, is not
    modelled.  Only types that fit the field (``accepted``) count.
    """
    slots = stores.select(F.col("field").alias("obj"), "type_id").distinct()
    known = None
    for _ in range(2):
        given = None if known is None else reads.join(known, "field").select("node", F.col("type").alias("label"))
        found = expression_types(nodes, expr, bindings, types, assertions, assignable, results, given)
        put = stores.join(found, "node").select(F.col("field").alias("obj"), F.col("label").alias("type")).distinct()
        fit = accepted(put, slots, types, assignable).select(F.col("obj").alias("field"), "type")
        known = materialize(fit if known is None else known.unionByName(fit).distinct())
    return known


def holds_functions(types: DataFrame, elements: DataFrame) -> DataFrame:
    """(type_id) that can hold a function: signatures, containers of such, and
    structs one level deep.  ``elements(type_id, elem_type_id, via)``."""
    edges = elements.where("via <> 'field'").select(F.col("elem_type_id").alias("src"), F.col("type_id").alias("dst"))
    base = types.where("kind = 'signature'").select(F.col("type_id").alias("node"), F.lit("f").alias("label"))
    deep = labelled_closure(edges, base).select(F.col("node").alias("type_id"))
    fields = elements.where("via = 'field'").join(deep.withColumnRenamed("type_id", "elem_type_id"), "elem_type_id", "left_semi").select("type_id")
    return deep.unionByName(fields).distinct()


def indexed_targets(queries: DataFrame, stores: DataFrame) -> DataFrame:
    """(node, target): functions stored in an indexed container; keys are
    compared only where both are constants.

    ``queries(node, obj, key)``, ``stores(obj, key, target)``.  The result may
    have nodes times targets of rows, so it is made in the last join and goes
    through no shuffle: all that a node asks for is one value, targets are made
    distinct for each such value, and nodes that ask alike share them.  Few
    targets at a time go through all nodes of a block, so that what repeats in
    the result lies close together and a columnar file of it stays small.
    """
    spark = queries.sparkSession
    queries = queries.where("obj is not null")
    stores = stores.select("obj", F.col("key").alias("s"), "target").distinct()
    held_at = stores.groupBy("obj").agg(F.count("*").alias("held"))
    asked_at = queries.groupBy("obj").agg(F.count("*").cast("double").alias("asked"))
    tasks = F.greatest(F.sum(F.col("asked") * F.col("held")) / TASK_ROWS, F.sum("asked") / TASK_NODES)
    tasks = asked_at.join(held_at, "obj").agg(tasks).first()[0] or 0
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(MOST_TASKS, int(tasks)))
    # both uses of the nodes are in one plan and so share one shuffle
    nodes = queries.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("obj", F.col("key").alias("q")))).alias("asks"))
    sizes = nodes.groupBy("asks").agg(F.ceil(F.count("*") / F.lit(BLOCK_NODES)).cast("int").alias("blocks"))
    found = sizes.select("asks", "blocks", F.explode(F.array_distinct("asks.obj")).alias("obj")).join(held_at, "obj")
    parts = found.groupBy("asks", "blocks").agg(F.ceil(F.sum("held") / F.lit(PART_TARGETS)).cast("int").alias("parts"))
    asked = parts.select("asks", "blocks", "parts", F.explode("asks").alias("ask")).select("asks", "blocks", "parts", "ask.obj", "ask.q")
    hit = asked.join(stores, "obj").where("q is null or s is null or q = s")
    part = F.pmod(F.xxhash64("target"), F.col("parts")).alias("part")
    held = hit.groupBy("asks", "blocks", part).agg(F.sort_array(F.collect_set(F.struct("target"))).alias("targets")).select("asks", "blocks", F.col("targets.target").alias("targets"))
    starts = F.sequence(F.lit(1), F.size("targets"), F.lit(RUN_TARGETS))
    runs = held.select("asks", "blocks", F.explode(F.transform(starts, lambda at: F.slice("targets", at, RUN_TARGETS))).alias("run"))
    runs = runs.select("asks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "run")
    large = F.broadcast(sizes.where("blocks > 1"))
    block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
    nodes = nodes.join(large, "asks", "left").select("node", "asks", block)
    lists = nodes.repartition(width, "asks", "block").groupBy("asks", "block").agg(F.collect_list(F.struct("node")).alias("nodes"))
    found = runs.repartition(width, "asks", "block").hint("merge").join(lists, ["asks", "block"])
    # transform isn't compiled, so it ends the join's compiled loop, which would hold all rows that come of one run
    found = found.select("run", F.explode(F.transform("nodes", lambda n: n["node"])).alias("node"))
    return found.select("node", F.explode("run").alias("target"))


def function_targets(nodes: DataFrame, expr: DataFrame, literals: DataFrame, named: DataFrame, stores: DataFrame, calls: DataFrame | None = None, returns: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(node, label): functions an expression may denote: a literal itself, a
    named function or method value, what is stored in a variable, and with
    ``calls`` and ``returns`` (see ``result_edges``) what a call returns.

    Functions found may be called in turn, so each round adds the ways of the
    calls that the last one resolved, and carries on from their sources only.
    It ends at the least fixpoint; recursive functions add what they return.
    """
    direct = literals.select("node", "label").unionByName(nodes.join(named.select(F.col("obj").alias("object"), F.col("function").alias("label")), "object").select("node", "label"))
    held = nodes.join(stores.select(F.col("obj").alias("object"), F.col("target").alias("label")), "object").select("node", "label")
    found = carried(expr, direct.unionByName(held).distinct())
    if calls is None or returns is None:
        return found
    ways, fresh = None, found
    for _ in range(max_rounds):
        new = result_edges(calls, fresh, returns)
        new = materialize(new if ways is None else new.join(ways, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return found
        ways = new if ways is None else ways.unionByName(new)
        moved = new.join(found.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label").distinct()
        carried_on = carried(expr, moved.join(found, ["node", "label"], "left_anti"), ways)
        fresh = materialize(carried_on.join(found, ["node", "label"], "left_anti"))
        found = found.unionByName(fresh)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def call_bindings(args: DataFrame, params: DataFrame) -> DataFrame:
    """(call, param, node): arguments with their parameters, the last parameter
    of a variadic function taking all that follow.

    ``args(call, function, pos, node, shift)`` (``shift`` is 1 for a method
    expression, whose first argument is the receiver), ``params(function, pos,
    param, n, variadic)``.
    """
    shape = params.groupBy("function").agg(F.max("n").alias("n"), F.bool_or("variadic").alias("variadic"))
    at = F.col("pos") - F.col("shift")
    slot = F.when(F.col("variadic"), F.least(at, F.col("n") - 1)).otherwise(at)
    rows = args.join(shape, "function").withColumn("pos", slot).where("pos >= 0")
    return rows.join(params.select("function", "pos", "param"), ["function", "pos"]).select("call", "param", "node")


def concrete_methods(candidates: DataFrame, interface_methods: DataFrame, type_methods: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds ``dep``: the local symbol of each method an interface asks of a
    candidate type.  ``candidates(.., label, interface)``."""
    asked = interface_methods.select(F.col("type_id").alias("interface"), "name", "pkg_scope")
    have = type_methods.select(F.col("type_id").alias("label"), "name", "pkg_scope", F.col("method_obj").alias("obj"))
    local = objects.where("symbol_id is not null").select("obj", F.col("symbol_id").alias("dep"))
    return candidates.join(asked, "interface").join(have, ["label", "name", "pkg_scope"]).join(local, "obj").drop("obj", "pkg_scope")


def dispatch_symbols(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Dispatch symbols and dependencies of ``rows(rev, decl_id, idx, pkg, dep)``:
    declaration to dispatch to each method, one dispatch symbol per package."""
    grouped = rows.groupBy("rev", "decl_id", "idx", "pkg").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    made = grouped.withColumn("id", identity.dispatch_id("decl_id", F.lit(kind), "idx", "pkg", "deps"))
    symbols = made.select("rev", "id", F.col("pkg").alias("package_path"), F.sha2("id", 256).alias("hash"))
    deps = made.select("rev", F.col("decl_id").alias("sym"), F.col("id").alias("dep")).unionByName(made.select("rev", F.col("id").alias("sym"), F.explode("deps").alias("dep")))
    return symbols, deps


def field_dispatch(stored: DataFrame, field_uses: DataFrame, type_methods: DataFrame, objects: DataFrame) -> DataFrame:
    """(rev, decl_id, idx, pkg, dep): for types stored in an interface field, the
    methods used through it, under the package that uses them.

    ``stored(rev, decl_id, idx, field, label)``, ``field_uses(field, name, pkg)``.
    """
    have = type_methods.select(F.col("type_id").alias("label"), "name", F.col("method_obj").alias("obj"))
    local = objects.where("symbol_id is not null").select("obj", F.col("symbol_id").alias("dep"))
    return stored.join(field_uses, "field").join(have, ["label", "name"]).join(local, "obj").select("rev", "decl_id", "idx", "pkg", "dep").distinct()


def dependency_fallback(calls: DataFrame, traced: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, label, dep): all interface methods of types passed to functions
    outside the module, unless the trace covers any of them.

    ``calls(call, label)``, ``traced(call, dep)``, ``methods(label, dep)``.
    """
    asked = calls.join(methods, "label")
    covered = asked.join(traced, ["call", "dep"], "left_semi").select("call", "label").distinct()
    return asked.join(covered, ["call", "label"], "left_anti").select("call", "label", "dep").distinct()


def trace_calls(roots: DataFrame, body_calls: DataFrame, methods: DataFrame, packages: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(root, pkg, method): concrete methods reached from a traced call, under
    their own package and every package on the way.  Only calls of interface
    methods are followed, with the receiver's type and no other argument.

    A work list of (root, function, receiver type, packages on the way): each
    round joins the newest states with ``body_calls(function, name, keeps)`` of
    their functions, resolves the method by ``methods(type, name, method)`` and
    pushes its package (``packages(method, pkg)``); a call that ``keeps`` passes
    its receiver on.  States met before are anti-joined away.  A function met
    on two ways counts for the packages of both.
    """
    state = ["root", "function", "type", "pkg"]
    step = frontier = materialize(roots.select("root", "function", "type", F.lit("").alias("pkg")).distinct())
    found = None
    for _ in range(max_rounds):
        hit = frontier.join(body_calls, "function").join(methods, ["type", "name"]).join(packages.withColumnRenamed("pkg", "own"), "method")
        marks = hit.select("root", F.explode(F.array("own", "pkg")).alias("pkg"), "method").where("pkg <> ''").distinct()
        found = marks if found is None else found.unionByName(marks)
        onward = hit.where("keeps").select("root", F.col("method").alias("function"), "type", F.explode(F.array("own", "pkg")).alias("pkg"))
        new = onward.distinct().join(step, state, "left_anti")
        frontier = materialize(new.select(*state))
        if frontier.isEmpty():
            return found.distinct()
        step = step.unionByName(frontier)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
