"""The state space of every document: all graphs that its rules lead to, up to isomorphism, and all of its normal forms.

Documents whose graphs are isomorphic and whose contexts let the same rules act have the same space, so it is explored once for each
such class. The frontier is a table of (root, state); a round expands every state by all of its steps, brings the results into
canonical form, and keeps those that aren't known: an anti join with the table of visited (root, key). A root whose space grows
over the budget leaves the frontier as inconclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule
from .delta import _after, _open, _start
from .isomorphism import canonical_key, written
from .rewrite import kept


def _cell(rules: list[Rule]):
    """Which rules act in the row's context."""
    return F.concat(*[F.when(r.guard.column(), "1").otherwise("0") for r in rules])


def explore(rules: list[Rule], rows: DataFrame, key: str = "doc_id", most: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots (key, root): the class that each row's space is explored for, named by its smallest key; visited (root, state, depth); and
    forms (root, state, trace), the states without a step, with one derivation each. rows: of graph_rows, with keys that don't
    repeat, age and jurisdiction. A root with more than most states is missing from forms where its space ends unexplored."""
    # Rows that are written alike are brought into canonical form once.
    drawn = kept(rows.select(F.col(key).alias("k"), written().alias("graph"), _cell(rules).alias("cell")), "drawn")
    alike = drawn.select("graph").distinct().withColumn("state", canonical_key(F.col("graph")))
    classes = kept(drawn.join(alike, "graph").select("k", "state", "cell"), "classes")
    roots = classes.join(classes.groupBy("state", "cell").agg(F.min("k").alias("root")), ["state", "cell"])
    roots = kept(roots.select(F.col("k").alias(key), "root", "state"), "roots")
    first = roots.filter(F.col(key) == F.col("root")).select("root", F.col("state").alias("name"))
    frontier = rows.join(first, rows[key] == F.col("root")).select("root", "name", "age", "jurisdiction", _start(rules, False).alias("state"))
    frontier = kept(frontier, "frontier")
    # Columns are built once: their expressions are large.
    next_state, next_name = _after(rules, F.col("state"), F.col("m"), False), canonical_key(written("state.nodes", "state.edges"))
    visited, forms, depth = [frontier.select("root", F.col("name").alias("state"), F.lit(0).alias("depth"))], [], 0
    while True:
        forms.append(frontier.filter(~_open(F.col("state"))).select("root", F.col("name").alias("state"), F.col("state.trace").alias("trace")))
        open_ = frontier.filter(_open(F.col("state")))
        steps = open_.select("root", "age", "jurisdiction", "state", F.explode(F.flatten("state.found")).alias("m"))
        after = steps.select("root", "age", "jurisdiction", next_state.alias("state")).withColumn("name", next_name)
        known = reduce(DataFrame.unionByName, visited)
        over = known.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        fresh = after.dropDuplicates(["root", "name"]).join(known.select("root", F.col("state").alias("name")), ["root", "name"], "left_anti").join(over.select("root"), "root", "left_anti")
        frontier = kept(fresh.select("root", "name", "age", "jurisdiction", "state"), "frontier")
        if frontier.isEmpty():
            return roots.select(key, "root"), known, reduce(DataFrame.unionByName, forms)
        depth += 1
        visited.append(frontier.select("root", F.col("name").alias("state"), F.lit(depth).alias("depth")))


def state_spaces(rules: list[Rule], rows: DataFrame, key: str = "doc_id", most: int = 5000) -> DataFrame:
    """(key, states, normal_forms, status): how many graphs each row's rules lead to, itself included, and how many of them have no
    step; status is complete, or inconclusive where there are more than most."""
    roots, visited, forms = explore(rules, rows, key, most)
    sizes = visited.groupBy("root").agg(F.count("*").alias("states"))
    ends = forms.groupBy("root").agg(F.count("*").alias("normal_forms"))
    status = F.when(F.col("states") > most, "inconclusive").otherwise("complete")
    return roots.join(sizes, "root").join(ends, "root", "left").select(key, "states", F.coalesce("normal_forms", F.lit(0)).cast("long").alias("normal_forms"), status.alias("status"))
