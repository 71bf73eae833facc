"""The mapping plan of a whole account tree: signals, roles, then one walk from the roots down.

Nodes are (node, parent, level, code, name, is_summary, participates, ignored): ``node`` is the row, its
order the order of the sheet, and level 1 are the roots. The chart is (code, name, active, category);
an account's code is the target of a mapping. State flows from parents to children, one join per level.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import names as N
from tallyweave.functions import vocabulary as V
from tallyweave.operators.inheritance import MAX_LEVELS, child_categories, discover_anchors, node_role, plan_leaves

ANCHORING = ("anchor", "breakpoint", "explicit_override")


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _signal_group(name: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(name, F.lit(word)), group) for word, group in V.SIGNAL_WORDS.items()))


def signal_index(chart: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(kind, key, target, tier): what points at an account, from active accounts and mappings kept for the company."""
    live = chart.filter("active and code is not null")
    groups = F.array(*(F.struct(F.lit(g).alias("key"), F.lit(c).alias("of")) for g, codes in V.SIGNAL_CODES.items() for c in codes))
    shown = lambda df, kind, key, target, tier=0: df.select(F.lit(kind).alias("kind"), key.alias("key"), F.col(target).alias("target"), F.lit(tier).alias("tier"))
    found = shown(live, "code", F.trim("code"), "code").union(shown(live, "name", _text("name"), "code"))
    grouped = live.withColumn("group", F.explode(F.filter(groups, lambda g: g["of"] == F.col("code"))))
    found = found.union(shown(grouped, "group", F.col("group.key"), "code"))
    if history is not None:
        kept = history.filter("active and target is not null")
        found = found.union(shown(kept, "history", F.concat(F.lit("code:"), _text("code")), "target"))
        found = found.union(shown(kept, "history", F.concat(F.lit("name:"), _text("name")), "target", 1))
    return found.filter(~F.col("key").isin("", "code:", "name:")).distinct()


def strong_signals(nodes: DataFrame, chart: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``by_history``, ``by_name`` and ``by_group`` (targets in order) and ``by_code`` (one or null).

    Each node gives its keys of all kinds, and all kinds meet in one shuffle. History is in order of
    hits by code, then by name; otherwise targets are in order of code. Ignored nodes have no signals.
    """
    code, name = _text("code"), _text("name")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    keys = F.array(key("code", code), key("name", name), key("group", _signal_group(name)), key("history", F.concat(F.lit("code:"), code)), key("history", F.concat(F.lit("name:"), name)))
    asked = nodes.filter(~F.col("ignored")).select("node", F.inline(keys)).filter(F.col("key").isNotNull() & ~F.col("key").isin("", "code:", "name:"))
    hits = asked.join(signal_index(chart, history), ["kind", "key"])
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct("tier", "target"))))
    met = hits.groupBy("node").agg(*(of(k).alias(k) for k in ("history", "code", "name", "group")))
    empty = F.array().cast("array<string>")
    once = lambda k: F.coalesce(F.array_distinct(F.col(f"{k}.target")), empty)
    shown = met.select("node", once("history").alias("by_history"), F.get(once("code"), F.lit(0)).alias("by_code"), once("name").alias("by_name"), once("group").alias("by_group"))
    filled = {k: F.coalesce(F.col(k), empty) for k in ("by_history", "by_name", "by_group")}
    return nodes.join(shown, "node", "left").withColumns(filled)


def with_roles(signalled: DataFrame) -> DataFrame:
    """Nodes with signals, plus ``semantic`` (what the node is by itself) and ``signal`` (the one target that its signals point at)."""
    strong = (F.size("by_history") > 0) | F.col("by_code").isNotNull() | (F.size("by_name") > 0)
    counted = signalled.join(child_categories(signalled), "node", "left").withColumn("n_categories", F.coalesce("n_categories", F.lit(0)))
    role = node_role(F.col("name"), F.col("is_summary"), F.col("participates"), strong, F.col("n_categories"))
    signal = F.coalesce("by_code", F.get("by_name", F.lit(0)), F.get("by_history", F.lit(0)))
    return counted.withColumns({"semantic": F.when(~F.col("ignored"), role), "signal": signal}).drop("n_categories")


def break_reason() -> Column:
    """Why a node with signals does not inherit (target, target_name, target_category), or null; in order of precedence."""
    name, target_name = _text("name"), F.coalesce("target_name", F.lit(""))
    other = lambda targets: F.exists(targets, lambda t: t != F.col("inherited"))
    shares = F.size(F.array_intersect(F.split(name, ""), F.split(F.coalesce("code_name", F.lit("")), ""))) > 0
    research = [F.contains(name, F.lit(w)) & ~F.contains(target_name, F.lit(w)) for w in ("资本化", "费用化")]
    found = (
        F.when(F.col("inherited").isNull(), None)
        .when(other("by_history"), "user_history_override")
        .when((F.col("by_code") != F.col("inherited")) & (name != "") & shares, "exact_code_different_target")
        .when(other("by_name"), "exact_name_different_target")
        .when(other("by_group"), "semantic_group_different_target")
        .when(N.contains_any(name, V.RESERVE_TOKENS) & ~N.contains_any(target_name, V.RESERVE_TOKENS), "reserve_token_boundary")
        .when((target_name != "") & (research[0] | research[1]), "rd_capitalization_boundary")
        .when(N.opposite(name, target_name, V.DIRECTION_OPPOSITES) & ~name.isin(*V.NEUTRAL_NAMES), "direction_boundary")
        .when(N.opposite(name, target_name, V.PROFIT_LOSS_OPPOSITES), "profit_loss_boundary")
        .when(F.col("own_category") != F.col("target_category"), "account_category_boundary")
    )
    return found


def resolve(nodes: DataFrame, chart: DataFrame, confirmed: DataFrame, recommended: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, role, mode, target, anchor, reason, requires_confirmation) of all nodes, which come from ``with_roles``.

    ``confirmed``: (node, target, override), a person's choices, an override or else an answer where an
    anchor is needed; ``recommended``: (node, target, safe). Going down, in order: an ignored node ends
    its branch; a structural one starts it anew; an override passes its target on, and ends the branch if
    the chart has no such account. Below nothing, a node with an account of its own is an anchor. Below a
    target, ``break_reason`` over the facts of that target decides between inheriting it and a
    breakpoint. A node that needs an account and has none is unresolved, and so are the nodes of an ended
    branch, which need no confirmation. ``anchor`` of an inheriting node is the first row that brings its target.
    """
    keep = keep or (lambda df: df.checkpoint())
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    if deepest > MAX_LEVELS:
        raise ValueError(f"the tree is deeper than {MAX_LEVELS} levels")
    accounts = chart.select(F.col("code").alias("account"), F.col("name").alias("account_name"), F.col("category").alias("account_category"))
    first_name = F.get("by_name", F.lit(0))
    facts = nodes.withColumn("own_account", F.coalesce("by_code", first_name)).join(accounts.withColumnsRenamed({"account": "own_account", "account_name": "code_name", "account_category": "own_category"}), "own_account", "left")
    facts = facts.withColumn("code_name", F.when(F.col("by_code").isNotNull(), F.col("code_name")))
    known = accounts.select("account", F.lit(True).alias("known"))
    said = confirmed.filter("target is not null").select("node", F.col("target").alias("account"), "override").join(known, "account", "left")
    said = said.select("node", F.col("account").alias("said"), "override", F.coalesce("known", F.lit(False)).alias("said_known"))
    offered = recommended.filter("target is not null").join(known.withColumnRenamed("account", "target"), "target").select("node", F.col("target").alias("offered"), "safe")
    facts = keep(facts.join(said, "node", "left").join(offered, "node", "left"))
    own = F.when(F.col("said").isNotNull(), F.when(F.col("said_known"), F.col("said"))).otherwise(F.col("offered"))
    direct = F.when(F.col("said").isNull() & F.col("safe"), "direct_auto").otherwise("direct_confirmed")
    overridden = F.coalesce("override", F.lit(False)) & F.col("said").isNotNull()
    state, out = None, None
    for level in range(1, deepest + 1):
        here = facts.filter(F.col("level") == level).withColumns({"own": own, "overridden": overridden})
        if state is None:
            here = here.withColumns({"open": F.lit(True), "inherited": F.lit(None).cast("string")})
        else:
            here = here.join(state.select(F.col("node").alias("parent"), F.col("opens").alias("open"), F.col("passes").alias("inherited")), "parent", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        here = here.join(accounts.withColumnsRenamed({"account": "inherited", "account_name": "target_name", "account_category": "target_category"}), "inherited", "left")
        here = here.withColumn("reason", break_reason())
        bare, taken = F.col("inherited").isNull(), F.col("own").isNotNull()
        role = (
            F.when(F.col("ignored"), "ignored")
            .when(~F.col("open"), "unresolved")
            .when(F.col("semantic") == "structural_summary", "structural_summary")
            .when(F.col("overridden"), F.when(F.col("said_known"), "explicit_override").otherwise("unresolved"))
            .when(bare, F.when(taken, "anchor").otherwise("unresolved"))
            .when(F.col("reason").isNull(), "inherited")
            .otherwise(F.when(taken, "breakpoint").otherwise("unresolved"))
        )
        here = here.withColumn("role", role)
        target = F.when(F.col("role").isin(*ANCHORING), F.col("own")).when(F.col("role") == "inherited", F.col("inherited"))
        mode = F.when(F.col("role") == "explicit_override", "override_confirmed").when(F.col("role") == "inherited", "inherited_ancestor").when(F.col("role").isin("anchor", "breakpoint"), direct).otherwise("none")
        lost = F.col("overridden") & (F.col("role") == "unresolved")
        asks = F.when(F.col("role") == "unresolved", F.col("open")).otherwise(F.col("role").isin("anchor", "breakpoint") & (F.col("mode") == "direct_confirmed"))
        broke = F.when(~bare & ~F.col("overridden") & F.col("role").isin("breakpoint", "unresolved"), F.col("reason"))
        here = here.withColumns({"target": target, "mode": mode, "passes": target, "opens": F.col("open") & ~F.col("ignored") & ~lost})
        state = keep(here.select("node", "role", "mode", "target", broke.alias("reason"), asks.alias("requires_confirmation"), "opens", "passes"))
        out = state if out is None else out.unionByName(state)
    if out is None:
        return nodes.selectExpr("node", *(f"cast(null as {t}) {c}" for c, t in (("role", "string"), ("mode", "string"), ("target", "string"))), "node as anchor", "cast(null as string) reason", "true as requires_confirmation")
    brought = out.filter(F.col("role").isin(*ANCHORING)).groupBy("target").agg(F.min("node").alias("anchor")).withColumn("role", F.lit("inherited"))
    return out.join(brought, ["role", "target"], "left").select("node", "role", "mode", "target", "anchor", "reason", "requires_confirmation")


class Plan(NamedTuple):
    """``nodes``: with signals, semantic roles and what discovery ``found``; ``plan``: as from ``resolve``; ``leaves``: (node, target, resolved)."""

    nodes: DataFrame
    plan: DataFrame
    leaves: DataFrame

    def summary(self) -> DataFrame:
        """One row of counts: nodes by role, questions, leaves, and how many nodes need a full recommendation."""
        nodes, plan, leaves = self.nodes, self.plan, self.leaves
        roles = ("structural_summary", "anchor", "inherited", "breakpoint", "explicit_override", "unresolved")
        by_role = plan.agg(F.count("*").alias("total_nodes"), *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles), F.count_if("requires_confirmation").alias("n_questions"))
        of_leaves = leaves.agg(F.count("*").alias("n_leaves"), F.count_if("resolved").alias("n_resolved_leaves"))
        of_nodes = nodes.agg(F.count_if(F.col("found").isin("anchor", "breakpoint")).alias("n_recommended"), F.count_if(~F.col("ignored") & (F.col("semantic") == "structural_summary")).alias("n_headings"))
        return by_role.join(of_leaves, F.lit(True)).join(of_nodes, F.lit(True))


def unified_plan(
    nodes: DataFrame, chart: DataFrame, history: DataFrame | None, confirmed: DataFrame, recommend: Callable[[DataFrame], DataFrame], ignored: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None
) -> Plan:
    """Signals, roles, discovery, plan and leaves in one call, for analysis and for execution alike.

    ``ignored`` (node) are rows that a person leaves out; they take no part in entries. ``recommend`` gives (node, target,
    safe) for nodes with a code or name; only nodes that need an account of their own use it.
    """
    keep = keep or (lambda df: df.checkpoint())
    if ignored is not None:
        out = F.coalesce("_out", F.lit(False))
        marked = nodes.join(ignored.select("node", F.lit(True).alias("_out")).distinct(), "node", "left")
        nodes = marked.withColumns({"ignored": F.col("ignored") | out, "participates": F.col("participates") & ~out}).drop("_out")
    ready = keep(with_roles(strong_signals(nodes, chart, history)))
    found = discover_anchors(ready.select("node", "parent", "level", "name", "ignored", F.col("semantic").alias("role"), "signal"), keep=keep)
    ready = keep(ready.join(found, "node"))
    offered = recommend(ready.filter(~F.col("ignored") & (F.col("semantic") != "structural_summary")).select("node", "code", "name"))
    plan = resolve(ready, chart, confirmed, offered, keep)
    return Plan(ready, plan, plan_leaves(plan, ready))
