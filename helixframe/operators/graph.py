"""Connected components of a link table, and their text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.checkpoints import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 30)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links; component is the smallest node that can be reached.

    Alternating large and small stars, until a round changes no link: O(log^2 n) rounds at most. Each is two
    aggregations (combined before the shuffle) and two joins on the node, whose hot keys Spark splits; links of a round
    are written to the shared checkpoint folder. Null ends are ignored; a node linked only to itself is a component.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    given = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("hi"), lo.alias("lo")).distinct()
    given = cut(given)
    now = given.where("hi <> lo")
    state = _state(now)
    while state[0]:
        # Large star: every greater neighbour of a node is linked to the smallest of the node and its neighbours.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(smallest, "hi")
        small = pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct()
        then = cut(small)
        after = _state(then)
        now, ended, state = then, after == state, after
        if ended:
            break
    linked = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")))
    alone = given.where("hi = lo").select(F.col("lo").alias("node")).join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone).distinct()


def component_sizes(links: DataFrame, min_members: int = 1) -> DataFrame:
    """(component, n_nodes) of components of min_members nodes or more."""
    return components(links).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= min_members)


def _text(edges: list[tuple[str, str, str]], show_edges: bool, comments: bool, dot: bool) -> str:
    near: dict[str, set[str]] = {}
    note: dict[tuple[str, str], str] = {}
    for a, b, desc in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        if desc:
            note[a, b] = desc
    order, todo, seen = [], [min(near)], set()
    while todo:  # depth first, neighbours in ascending order
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            order.append(v)
            todo += sorted(near[v] - seen, reverse=True)
    name = (lambda v: f'"{v}"') if dot else (lambda v: v)
    lines = [(" ; " if dot else " ").join(map(name, order)) + (";" if dot else "")]
    if show_edges or dot:
        done = set()
        for a in order:
            for b in sorted(near[a]):
                if (a, b) in done or (b, a) in done:
                    continue
                x, y = (b, a) if (comments or dot) and (a, b) not in note and (b, a) in note else (a, b)
                tail = f"  # {note[x, y]}" if (comments or dot) and (x, y) in note else ""
                lines.append(f"   {name(x)}{' -- ' if dot else ' '}{name(y)}{';' if dot else ''}{tail}")
                done.add((x, y))
    return "\n".join(["graph {", *lines, "}"] if dot else lines)


def subgraphs(links: DataFrame, min_members: int = 1, edges: bool = False, comments: bool = False, dot: bool = False) -> DataFrame:
    """(component, n_nodes, text): the nodes of each component on one line, depth first from the smallest; edges adds a line
    for each link, comments what follows it in the file, dot the graph language. A component is one text, so its links
    come to one task."""
    named = links.select("a", "b", F.coalesce("desc", F.lit("")).alias("desc")) if "desc" in links.columns else links.select("a", "b", F.lit("").alias("desc"))
    found = components(named)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= min_members)
    tied = named.join(found.withColumnRenamed("node", "a"), "a").join(sizes, "component")

    def text(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group[["a", "b", "desc"]].itertuples(index=False, name=None))
        return pd.DataFrame({"component": [group["component"].iloc[0]], "n_nodes": [group["n_nodes"].iloc[0]], "text": [_text(rows, edges, comments, dot)]})

    return tied.groupBy("component").applyInPandas(text, "component string, n_nodes long, text string")
