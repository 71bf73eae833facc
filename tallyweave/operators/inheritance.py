"""Top-down inheritance of mappings through an account tree.

Nodes are (node, parent, level, name, code, ...). State flows from parents to children, one
join per level; trees are a handful of levels deep. Each level is materialised through
``keep``, which by default is ``checkpoint()``, so that later levels do not recompute it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import names as N
from tallyweave.functions import vocabulary as V

MAX_LEVELS = 20


def node_role(name: Column, is_summary: Column, participates: Column, strong: Column, child_categories: Column) -> Column:
    """structural_summary, account_anchor_candidate or ordinary_detail, by the first rule that holds."""
    text = F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when((text == "") | text.isin(*V.STRUCTURAL_NAMES), "structural_summary")
        .when(F.coalesce(strong, F.lit(False)), "account_anchor_candidate")
        .when(N.contains_any(text, V.ACCOUNT_ANCHORS), "account_anchor_candidate")
        .when(is_summary & (child_categories >= 2), "structural_summary")
        .when(is_summary & ~participates, "structural_summary")
        .otherwise("ordinary_detail")
    )


def child_categories(nodes: DataFrame) -> DataFrame:
    """(node, n_categories): how many account categories a node's children belong to."""
    return nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count_distinct(N.category_of_name(F.col("name"))).alias("n_categories"))


def node_type(code: Column, name: Column, is_summary: Column) -> Column:
    bare = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(bare(code) & (bare(name) | is_summary), "summary").when(bare(code), "auxiliary").otherwise("account")


def boundary(name: Column, own_target: Column, own_kind: Column, own_name: Column, own_category: Column, target: Column, target_name: Column, target_category: Column) -> Column:
    """Why a node does not inherit ``target``, or null if it does.

    ``own_kind`` says where the node's own signal comes from: history, code, name or group.
    """
    differs = own_target.isNotNull() & (own_target != target)
    shares = F.size(F.array_intersect(F.split(F.coalesce(name, F.lit("")), ""), F.split(F.coalesce(own_name, F.lit("")), ""))) > 0
    capital, expense = F.lit("资本化"), F.lit("费用化")
    research = (F.contains(name, capital) & ~F.contains(target_name, capital)) | (F.contains(name, expense) & ~F.contains(target_name, expense))
    neutral = F.trim(name).isin(*V.NEUTRAL_NAMES)
    return (
        F.when(target.isNull(), None)
        .when(differs & (own_kind == "history"), "user_history_override")
        .when(differs & (own_kind == "code") & shares, "exact_code_different_target")
        .when(differs & (own_kind == "name"), "exact_name_different_target")
        .when(differs & (own_kind == "group"), "semantic_group_different_target")
        .when(N.contains_any(name, V.RESERVE_TOKENS) & ~N.contains_any(target_name, V.RESERVE_TOKENS), "reserve_token_boundary")
        .when(F.coalesce(research, F.lit(False)), "rd_capitalization_boundary")
        .when(N.opposite(name, target_name, V.DIRECTION_OPPOSITES) & ~neutral, "direction_boundary")
        .when(N.opposite(name, target_name, V.PROFIT_LOSS_OPPOSITES), "profit_loss_boundary")
        .when(own_kind.isin("code", "name") & (own_category != target_category), "account_category_boundary")
    )


def mapping_plan(nodes: DataFrame, reason: Callable[[str], Column] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Roles, modes and targets of all nodes: (node, role, mode, target, reason).

    ``nodes``: node, parent, level (1 for roots), ignored, structural, override (a target or
    null), own (the node's own target or null), confirmed (whether ``own`` was confirmed by a
    person). In order: ignored rows take no part and pass their parent's target on; an override
    starts anew; structural rows reset; a node with an own target is an anchor below none, or a
    breakpoint where ``reason`` (from the alias of the inherited target) says so; others
    inherit. Without anything to inherit a node is unresolved.
    """
    keep = keep or (lambda df: df.checkpoint())
    reason = reason or (lambda inherited: F.when(F.col("own").isNotNull() & (F.col("own") != F.col(inherited)), "own_target"))
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    if deepest > MAX_LEVELS:
        raise ValueError(f"the tree is deeper than {MAX_LEVELS} levels")
    above, out = None, None
    for level in range(1, deepest + 1):
        here = nodes.filter(F.col("level") == level)
        if above is None:
            here = here.withColumn("inherited", F.lit(None).cast("string"))
        else:
            here = here.join(above.select(F.col("node").alias("parent"), F.col("passes").alias("inherited")), "parent", "left")
        here = here.withColumn("reason", reason("inherited"))
        breaks = F.col("inherited").isNotNull() & F.col("reason").isNotNull()
        role = (
            F.when(F.col("ignored"), "ignored")
            .when(F.col("override").isNotNull(), "explicit_override")
            .when(F.col("structural"), "structural_summary")
            .when(breaks, "breakpoint")
            .when(F.col("inherited").isNotNull(), "inherited")
            .when(F.col("own").isNotNull(), "anchor")
            .otherwise("unresolved")
        )
        target = (
            F.when(F.col("ignored") | (F.col("role") == "structural_summary"), None)
            .when(F.col("role") == "explicit_override", F.col("override"))
            .when(F.col("role").isin("breakpoint", "anchor"), F.col("own"))
            .when(F.col("role") == "inherited", F.col("inherited"))
        )
        direct = F.when(F.col("confirmed"), "direct_confirmed").otherwise("direct_auto")
        mode = (
            F.when(F.col("role") == "explicit_override", "override_confirmed")
            .when(F.col("role") == "inherited", "inherited_ancestor")
            .when(F.col("role").isin("anchor", "breakpoint") & F.col("target").isNotNull(), direct)
            .otherwise("none")
        )
        passes = F.when(F.col("ignored"), F.col("inherited")).otherwise(F.col("target"))
        done = here.withColumn("role", role).withColumn("target", target).withColumns({"mode": mode, "passes": passes})
        above = keep(done.select("node", "level", "role", "mode", "target", "passes", "reason"))
        out = above if out is None else out.union(above)
    if out is None:
        return nodes.selectExpr("node", "cast(null as string) role", "cast(null as string) mode", "cast(null as string) target", "cast(null as string) reason")
    return out.withColumn("reason", F.when(F.col("role") == "breakpoint", F.col("reason"))).select("node", "role", "mode", "target", "reason")


def propagate_confirmed(confirmed: DataFrame, up: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, target, source_node): the nearest confirmed ancestor's target, where no stop lies on or above the node first.

    ``up`` is a closure (node, ancestor, distance); ``stops`` has nodes that keep their own mapping.
    """
    marks = confirmed.select(F.col("node").alias("ancestor"), "target", F.lit(False).alias("stop"))
    marks = marks.union(stops.select(F.col("node").alias("ancestor"), F.lit(None).cast("string"), F.lit(True)))
    hits = up.join(marks, "ancestor")
    near = hits.groupBy("node").agg(F.min_by(F.struct("ancestor", "target", "stop", "distance"), F.struct("distance", ~F.col("stop"))).alias("near"))
    return near.filter("not near.stop and near.distance > 0").select("node", "near.target", F.col("near.ancestor").alias("source_node"))


def discover_anchors(nodes: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, found) by signals alone: ignored, structural, anchor, breakpoint or inherited.

    ``nodes``: node, parent, level (1 for roots), name, ignored, role (as ``node_role``) and
    signal (the target that code, name or history points at, or null). Below nothing, or below
    a structural row, a node is an anchor and passes its signal on. Under a target, another
    signal breaks, and so does a name that is the opposite of the name of the first node with
    that target, below which anchors start anew. An ignored row ends the walk; what lies below
    it is an anchor by its role only.
    """
    keep = keep or (lambda df: df.checkpoint())
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    if deepest > MAX_LEVELS:
        raise ValueError(f"the tree is deeper than {MAX_LEVELS} levels")
    named = nodes.filter("signal is not null").groupBy(F.col("signal").alias("above")).agg(F.min_by("name", "node").alias("target_name"))
    state, out = None, None
    for level in range(1, deepest + 1):
        here = nodes.filter(F.col("level") == level)
        if state is None:
            here = here.withColumns({"reached": F.lit(True), "above": F.lit(None).cast("string")})
        else:
            here = here.join(state.select(F.col("node").alias("parent"), "reached", F.col("passes").alias("above")), "parent", "left")
        here = here.join(named, "above", "left").withColumn("reached", F.coalesce("reached", F.lit(True)) & ~F.col("ignored"))
        free = F.col("reached") & (F.col("role") != "structural_summary")
        # an empty text stands for an anchor above that has no signal of its own
        under = free & F.coalesce(F.col("above") != "", F.lit(False))
        first = free & F.col("above").isNull()
        turned = under & F.coalesce(F.col("signal") != F.col("above"), F.lit(False))
        opposed = under & F.col("signal").isNull() & N.opposite(F.col("name"), F.col("target_name"), V.DIRECTION_OPPOSITES)
        passes = F.when(~free | opposed, None).when(first | turned, F.coalesce("signal", F.lit(""))).otherwise(F.col("above"))
        found = (
            F.when(F.col("ignored"), "ignored")
            .when(F.col("role") == "structural_summary", "structural")
            .when(turned | opposed, "breakpoint")
            .when(first | (F.col("role") == "account_anchor_candidate"), "anchor")
            .otherwise("inherited")
        )
        state = keep(here.select("node", "reached", passes.alias("passes"), found.alias("found")))
        out = state if out is None else out.union(state)
    return nodes.selectExpr("node", "cast(null as string) found") if out is None else out.select("node", "found")


def plan_leaves(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, target, resolved) of the leaves that take part in the entry; a row without a target holds the import back.

    ``plan`` as from ``mapping_plan``; ``nodes`` have node, ignored, is_summary and participates.
    Ignored rows, summaries and structural rows are no such leaves.
    """
    leaves = nodes.filter("not ignored and not is_summary and participates").select("node")
    met = leaves.join(plan, "node").filter("role <> 'structural_summary'")
    usable = F.col("role").isin("anchor", "breakpoint", "inherited", "explicit_override") & F.col("target").isNotNull()
    return met.select("node", F.when(usable, F.col("target")).alias("target"), usable.alias("resolved"))
