"""The tree of a stored batch: accounts, the client's own groups below them, and entries, as flat nodes.

A group stands for a client row above entries of one account; where an entry's row has none, groups come
from the parts of its name. Sums are made once per (account, row) and then carried to every row above, so
that what is joined is no longer than the rows that have entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import hierarchy, views

MAX_DEPTH = 30
TOTAL = "decimal(30,2)"


def last_part(name: Column) -> Column:
    """The last part of a name that is not blank, between _ - / \\ and wide dashes."""
    parts = F.filter(F.split(name, r"[_\-－—/\\]"), lambda s: F.trim(s) != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), name)


def _ids(kind: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *columns)


def _summed(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(m).cast(TOTAL).alias(m) for m in measures), F.sum("entry_count").alias("entry_count"))


def group_tree(accounts: DataFrame, entries: DataFrame, rows: DataFrame, measures: list[str], only_with_amounts: bool = False) -> DataFrame:
    """Nodes of three types: node_id, node_type, parent_id, account, code, name, the measures and entry_count.

    ``accounts``: account, parent, code, name; ``entries``: entry, account, row, code, name and the
    measures; ``rows``: row, parent_row, code, name. Entries of accounts that are not listed are left
    out. An account sums all entries on and below it; a group sums those of its account on
    and below its row. A group is one node in an account however many entries lie below it. Rows that
    lie above themselves end the chain: their groups hang under the account. With ``only_with_amounts``,
    accounts without entries are left out, and so are groups that have none by definition.
    """
    known = entries.join(accounts.select("account", F.col("code").alias("account_code"), F.col("name").alias("account_name")), "account").withColumn("entry_count", F.lit(1).cast("long"))
    up = hierarchy.closure(rows, "row", "parent_row", MAX_DEPTH)
    above = up.filter("distance > 0")
    looped = above.select(F.col("node").alias("parent_row"), F.col("ancestor").alias("row"), F.lit(True).alias("loops"))
    links = rows.select("row", "parent_row", F.col("code").alias("row_code"), F.col("name").alias("row_name"))
    links = links.join(rows.select(F.col("row").alias("parent_row"), F.lit(True).alias("there")), "parent_row", "left").join(looped, ["row", "parent_row"], "left")
    there = F.coalesce("there", F.lit(False)) & (F.col("parent_row") != F.col("row"))
    links = links.select("row", F.when(there, F.col("parent_row")).alias("above"), F.when(there & F.col("loops").isNull(), F.col("parent_row")).alias("link"), "row_code", "row_name")

    placed = known.join(links.select("row", "above"), "row", "left").withColumn("chained", F.col("above").isNotNull())
    placed = placed.withColumn("path", F.when(~F.col("chained"), views.synthetic_path(F.col("code"), F.col("name"), F.col("account_name"), F.col("account_code"))))

    own = _summed(placed.filter("row is not null"), ["account", "row"], measures)
    chains = own.join(placed.filter("chained").select("account", "row").distinct(), ["account", "row"]).join(above.withColumnRenamed("node", "row"), "row")
    groups = chains.select("account", F.col("ancestor").alias("row")).distinct()
    # a row that has entries of its own and stands above others holds both
    carried = own.join(up.withColumnRenamed("node", "row"), "row").withColumnRenamed("ancestor", "group_row")
    sums = _summed(carried.join(groups.withColumnRenamed("row", "group_row"), ["account", "group_row"]), ["account", "group_row"], measures).withColumnRenamed("group_row", "row")
    met = sums.join(links, "row")
    group_id = lambda row: F.when(F.col(row).isNotNull(), _ids("client_group", "account", row))
    root = _ids("account", "account")
    shown = lambda df, node, kind, parent, code, name: df.select(node.alias("node_id"), F.lit(kind).alias("node_type"), parent.alias("parent_id"), F.col("account").cast("string").alias("account"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(name, F.lit("")).alias("name"), *(F.col(m).cast(TOTAL).alias(m) for m in measures), "entry_count")
    client = shown(met, group_id("row"), "client_group", F.coalesce(group_id("link"), root), F.col("row_code"), F.col("row_name"))

    steps = placed.filter("size(path) > 0").select("account", *measures, "entry_count", "path", F.posexplode("path").alias("place", "step"))
    steps = steps.select("account", *measures, "entry_count", F.col("step.group_code").alias("group_code"), F.col("step.group_name").alias("group_name"), F.when(F.col("place") > 0, F.get("path", F.col("place") - 1)["group_code"]).alias("outer"))
    first = F.min(F.struct(F.col("outer").isNotNull().alias("inner"), "group_name", "outer")).alias("first")
    made = steps.groupBy("account", "group_code").agg(*(F.sum(m).cast(TOTAL).alias(m) for m in measures), F.sum("entry_count").alias("entry_count"), first)
    made = made.withColumns({"group_name": F.col("first.group_name"), "outer": F.col("first.outer")})
    # codes too short to be cut differently make one group of several parts
    outer = F.when(F.col("outer") != F.col("group_code"), _ids("synth", "account", "outer"))
    synthetic = shown(made, _ids("synth", "account", "group_code"), "client_group", F.coalesce(outer, root), F.col("group_code"), F.col("group_name"))

    inner = F.try_element_at("path", F.lit(-1))["group_code"]
    grouped = F.col("chained") | (F.size("path") > 0)
    leaves = placed.withColumn("inner", inner)
    hangs = F.when(F.col("chained"), F.coalesce(group_id("above"), root)).when(F.col("inner").isNotNull(), _ids("synth", "account", "inner")).otherwise(root)
    entry = shown(leaves, _ids("entry", "entry"), "entry", hangs, F.coalesce(F.nullif("code", F.lit("")), "account_code"), F.when(grouped, last_part(F.col("name"))).otherwise(F.coalesce(F.nullif("name", F.lit("")), "account_name")))

    chart_up = hierarchy.closure(accounts, "account", "parent", MAX_DEPTH)
    per_account = _summed(known, ["account"], measures).withColumnRenamed("account", "node")
    rolled = _summed(per_account.join(chart_up, "node"), ["ancestor"], measures).withColumnRenamed("ancestor", "account")
    chart = accounts.join(rolled, "account", "left").withColumns({m: F.coalesce(m, F.lit(0).cast(TOTAL)) for m in measures} | {"entry_count": F.coalesce("entry_count", F.lit(0))})
    if only_with_amounts:
        chart = chart.filter("entry_count > 0")
    top = shown(chart, root, "account", F.when(F.col("parent").isNotNull(), _ids("account", "parent")), F.col("code"), F.col("name"))
    return top.unionByName(client).unionByName(synthetic).unionByName(entry)
