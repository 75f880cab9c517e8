"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors of one label are one class, found by a sum before anything else moves.
2. The classes of a label are dealt into shards of about ``SHARD`` vectors, so a frequent label has many shards of one size.
3. A graph is built per shard and written: nodes are inserted in growing batches, each node linked to the nearest nodes the graph finds
   that are not nearer to each other, on all levels up to its own.
4. Every vector queries every shard of its label, a block of queries and a graph per task: down the levels to an entry, then a beam on the
   lowest level. A beam that is still full of links is widened for its query. Audited queries of the block are compared with all
   vectors of the shard, and while too few of their links were found all beams of the block are widened. Beams are widened once to
   ``WIDER`` times their width and then to the whole shard.
5. Pairs found are verified by cosine in double precision. A task passes on one row per linked vector, not the pairs: how many it is
   linked to, and a vector its links lead to, which are then united into components.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm import graph
from weakloom.llm.store import stored
from weakloom.operators.skew import salted_join

#: Vectors in a shard on average, and queries in a block at most.
SHARD, BLOCK = 2048, 1024
#: Links of a node on the upper levels (twice as many on the lowest), beam while building.
LINKS, BUILD_BEAM = 12, 48
#: First beam of a query, audited queries per block, and the share of their links that must be found.
BEAM, AUDITED, RECALL = 48, 128, 0.99
#: How many times wider the second beam is; after it, vectors are compared with the whole shard.
WIDER = 4
#: Search is done in single precision; pairs this far below the threshold are verified too.
SLACK = 1e-4


# --- one graph ----------------------------------------------------------------------------------

class Graph(NamedTuple):
    """Unit vectors of a shard, the level of each, and per level the links of each node (-1 where there are fewer)."""

    units: np.ndarray
    levels: np.ndarray
    links: list[np.ndarray]
    entry: int


def _units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _beam(g: Graph, level: int, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each query by best-first search from its entry; all queries take a step at a time.

    Returns nodes (-1 where there are fewer) and similarities, nearest first.
    """
    n, m = len(queries), g.links[level].shape[1]
    links = g.links[level]
    nodes = np.full((n, width), -1, np.int32)
    near = np.full((n, width), -np.inf, np.float32)
    done = np.zeros((n, width), bool)
    seen = np.zeros((n, len(g.units)), bool)
    everyone = np.arange(n)
    nodes[:, 0], near[:, 0] = entries, np.einsum("qd,qd->q", queries, g.units[entries])
    seen[everyone, entries] = True
    active = everyone
    while len(active):
        waiting = (nodes[active] >= 0) & ~done[active]
        open_ = waiting.any(axis=1)
        active, waiting = active[open_], waiting[open_]
        if not len(active):
            break
        first = waiting.argmax(axis=1)
        done[active, first] = True
        beside = links[nodes[active, first]]
        fresh = (beside >= 0) & ~seen[active[:, None], np.maximum(beside, 0)]
        rows, columns = np.nonzero(fresh)
        targets = beside[rows, columns]
        seen[active[rows], targets] = True
        sims = np.full((len(active), m), -np.inf, np.float32)
        sims[rows, columns] = np.einsum("qd,qd->q", queries[active[rows]], g.units[targets])
        better = (sims > near[active, -1:]).any(axis=1)
        if not better.any():
            continue
        at = active[better]
        both = np.concatenate([near[at], sims[better]], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :width]
        near[at] = np.take_along_axis(both, order, axis=1)
        held = np.concatenate([nodes[at], np.where(fresh[better], beside[better], -1)], axis=1)
        nodes[at] = np.take_along_axis(held, order, axis=1)
        was = np.concatenate([done[at], np.zeros((len(at), m), bool)], axis=1)
        done[at] = np.take_along_axis(was, order, axis=1)
    return nodes, near


def _entries(g: Graph, queries: np.ndarray, down_to: int) -> np.ndarray:
    """The node where each query arrives on a level, going greedily down from the top."""
    at = np.full(len(queries), g.entry, np.int32)
    for level in range(len(g.links) - 1, down_to, -1):
        at = _beam(g, level, queries, at, 1)[0][:, 0]
    return at


def _spread(units: np.ndarray, node: int, candidates: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
    """Candidates, nearest first, that are nearer to the node than to any taken before; places left go to the nearest others."""
    among = units[candidates] @ units[candidates].T
    taken: list[int] = []
    for i in range(len(candidates)):
        if len(taken) == most:
            break
        if not taken or among[i, taken].max() < sims[i]:
            taken.append(i)
    rest = [i for i in range(len(candidates)) if i not in set(taken)][:most - len(taken)]
    return [int(candidates[i]) for i in taken + rest]


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 0) -> Graph:
    """The graph over the rows of ``vectors``, none of which is zero. The same rows in the same order give the same graph."""
    units, n = _units(vectors), len(vectors)
    levels = np.minimum((-np.log1p(-np.random.default_rng(seed).random(n)) / np.log(links)).astype(np.int32), 12)
    # The highest node comes first: it is the entry from the start.
    order = np.argsort(-levels, kind="stable")
    first = order[0]
    order = np.concatenate([[first], np.setdiff1d(np.arange(n), [first])])
    tables = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range(levels.max() + 1)]
    g = Graph(units, levels, tables, int(first))
    at = 1
    while at < n:
        batch = order[at:at + max(1, at // 4)]
        # All levels are searched before any is linked: nodes of this batch are no way to each other yet.
        searched = []
        for level in range(len(tables)):
            own = batch[levels[batch] >= level]
            if len(own):
                searched.append((level, own, *_beam(g, level, units[own], _entries(g, units[own], level), beam)))
        for level, own, found, near in searched:
            _link(g, level, own, found, near, beam)
        at += len(batch)
    return g


def _link(g: Graph, level: int, own: np.ndarray, found: np.ndarray, near: np.ndarray, beam: int) -> None:
    """Link the nodes ``own`` on a level with each other and with those ``found`` there."""
    table = g.links[level]
    among = g.units[own] @ g.units[own].T
    np.fill_diagonal(among, -np.inf)
    added: dict[int, list[int]] = {}
    for i, node in enumerate(own):
        nodes, sims = found[i][found[i] >= 0], near[i][found[i] >= 0]
        few = np.argsort(-among[i], kind="stable")[:beam]
        few = few[np.isfinite(among[i][few])]
        nodes, sims = np.concatenate([nodes, own[few]]), np.concatenate([sims, among[i][few]])
        best = np.argsort(-sims, kind="stable")[:beam]
        taken = _spread(g.units, node, nodes[best], sims[best], table.shape[1] // 2 if level == 0 else table.shape[1])
        table[node, :len(taken)] = taken
        for other in taken:
            added.setdefault(other, []).append(int(node))
    for other, news in added.items():
        held = table[other][table[other] >= 0]
        news = [x for x in dict.fromkeys(news) if x not in set(held.tolist())]
        every = np.concatenate([held, np.array(news, np.int32)])
        if len(every) > table.shape[1]:
            sims = g.units[every] @ g.units[other]
            best = np.argsort(-sims, kind="stable")
            every = np.array(_spread(g.units, other, every[best], sims[best], table.shape[1]), np.int32)
        table[other, :] = -1
        table[other, :len(every)] = every


def search(g: Graph, queries: np.ndarray, threshold: float, beam: int = BEAM, audited: int = AUDITED,
           recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """``(query, node, audit)``: pairs with a similarity of about ``threshold`` or more, and the audit's links, links found, and last beam.

    Every ``len(queries) / audited``-th query is audited.
    """
    units, size = _units(queries), len(g.units)
    lowest = np.float32(threshold - SLACK)
    some = np.unique(np.linspace(0, len(units) - 1, min(audited, len(units))).astype(int))
    true = units[some] @ g.units.T >= lowest
    entries = _entries(g, units, 0)
    beam = min(beam, size)
    left, width = np.arange(len(units)), beam
    pairs: dict[int, np.ndarray] = {}
    hit = 0
    while len(left):
        if width == size:
            # The whole shard: nothing is left to the links between nodes.
            near = units[left] @ g.units.T
            pairs.update({int(i): np.flatnonzero(row >= lowest) for i, row in zip(left, near)})
            left = left[:0]
        else:
            nodes, near = _beam(g, 0, units[left], entries[left], width)
            pairs.update({int(i): row[(row >= 0) & (sims >= lowest)] for i, row, sims in zip(left, nodes, near)})
            left = left[near[:, -1] >= lowest]
        hit = sum(int(true[k][pairs[int(i)]].sum()) for k, i in enumerate(some))
        if width < size:
            if hit < recall * true.sum():
                left = np.arange(len(units))
            if len(left):
                # A far wider beam costs more than comparing with every vector.
                width = min(size, WIDER * beam) if width == beam else size
    query = np.repeat(np.arange(len(units)), [len(pairs[i]) for i in range(len(units))])
    node = np.concatenate([pairs[i] for i in range(len(units))]) if len(units) else np.zeros(0, np.int32)
    return query, node, (int(true.sum()), hit, width)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision."""
    return np.einsum("qd,qd->q", a, b) / (np.sqrt(np.einsum("qd,qd->q", a, a)) * np.sqrt(np.einsum("qd,qd->q", b, b)))


# --- shards and links -----------------------------------------------------------------------------

def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _built(table: pa.Table) -> pa.Table:
    """The graph of one shard as bytes. Rows are put in the order of their nodes, so any task builds the same graph."""
    table = table.sort_by("node").combine_chunks()
    width = table["width"][0].as_py()
    vectors = pc.list_flatten(table["vector"]).to_numpy().reshape(-1, width)
    if (vectors.astype(np.float32) == vectors).all():
        vectors = vectors.astype(np.float32)
    g = build(vectors.astype(np.float64))
    packed = _pack(nodes=table["node"].to_numpy(), sizes=table["size"].to_numpy(), vectors=vectors, levels=g.levels, entry=np.array([g.entry]),
                   **{f"links{i}": x for i, x in enumerate(g.links)})
    return pa.table({"label": table["label"][:1], "width": table["width"][:1], "shard": table["shard"][:1],
                     "graph": pa.array([packed], pa.binary())})


class Shard(NamedTuple):
    graph: Graph
    vectors: np.ndarray
    nodes: np.ndarray
    sizes: np.ndarray


def _unpacked(data: bytes) -> Shard:
    with np.load(io.BytesIO(data)) as held:
        links = [held[f"links{i}"] for i in range(sum(name.startswith("links") for name in held.files))]
        vectors = held["vectors"].astype(np.float64)
        return Shard(Graph(_units(vectors), held["levels"], links, int(held["entry"][0])), vectors, held["nodes"], held["sizes"])


def _queried(held: Shard, asking: Shard, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Pairs of rows of ``asking`` and ``held`` verified in double precision, and the audits of the blocks."""
    rows, found, audits = [], [], []
    for start in range(0, len(asking.vectors), BLOCK):
        block = asking.vectors[start:start + BLOCK]
        i, j, audit = search(held.graph, block, threshold, beam)
        near = cosines(block[i], held.vectors[j]) >= threshold
        rows.append(start + i[near])
        found.append(j[near])
        audits.append(audit)
    return np.concatenate(rows), np.concatenate(found), audits


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one reached over the links ``a, b``."""
    out = np.arange(n)
    while True:
        new = out.copy()
        np.minimum.at(new, a, out[b])
        np.minimum.at(new, b, out[a])
        new = new[new]
        if (new == out).all():
            return out
        out = new


_ANSWER = "node bigint, root bigint, others bigint, expected bigint, found bigint, beam bigint"


def _met(threshold: float, beam: int):
    """Both shards of a pair query each other's graph. Each vector with links is returned once, with the sizes of what it is linked to and
    the first vector its links reach here, however many links a group of near vectors has; then a row of audit figures per block."""
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, same = _unpacked(left["graph"][0].as_py()), left["shard"][0] == left["other"][0]
        y = x if same else _unpacked(right["graph_"][0].as_py())
        j, i, audits = _queried(x, y, threshold, beam)
        if same:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            i, j = i[i != j], j[i != j]
        else:
            more, others, second = _queried(y, x, threshold, beam)
            i, j, audits = np.concatenate([i, more]), np.concatenate([j, others]), audits + second
        pair = np.unique(i.astype(np.int64) * len(y.nodes) + j)
        i, j = np.divmod(pair, len(y.nodes))
        nodes = x.nodes if same else np.concatenate([x.nodes, y.nodes])
        shift, weight = 0 if same else len(x.nodes), np.zeros(len(nodes), np.int64)
        np.add.at(weight, i, y.sizes[j])
        if not same:
            np.add.at(weight, j + shift, x.sizes[i])
        linked = np.flatnonzero(weight)
        root = _smallest_reached(len(nodes), i, j + shift)
        n, none = len(linked), [None] * len(audits)
        figures = [pa.array([None] * n + [audit[k] for audit in audits], pa.int64()) for k in range(3)]
        return pa.table([pa.array([*nodes[linked].tolist(), *none], pa.int64()), pa.array([*nodes[root[linked]].tolist(), *none], pa.int64()),
                         pa.array([*weight[linked].tolist(), *none], pa.int64()), *figures],
                        ["node", "root", "others", "expected", "found", "beam"])

    return meet


def links_of(classes: DataFrame, threshold: float, beam: int = BEAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(reached, audits)`` over ``classes (node, label, vector, size)``.

    ``reached (node, root, others)`` has a row per node and pair of shards in which it has links: the sizes it is linked to there and a node its
    links lead to. A task holds the graphs of two shards, whatever the label's size; each graph is sent once per shard of its label.
    """
    sized = classes.withColumn("width", F.size("vector"))
    space = F.xxhash64("label", "width").alias("space")
    counts = sized.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")).select(space, "shards")
    # A label with most of the rows is dealt over salted copies of its one count.
    dealt = salted_join(sized.select("*", space), counts, "space", ["node"]).select(
        "node", "label", "width", "vector", "size", F.pmod(F.xxhash64("node"), "shards").alias("shard"))
    kind = sized.schema["label"].dataType.simpleString()
    graphs = stored(dealt.groupBy("label", "width", "shard").applyInArrow(_built, f"label {kind}, width int, shard bigint, graph binary"), "graphs")
    names = graphs.select("label", "width", F.col("shard").alias("_shard"))
    left = graphs.join(names, ["label", "width"]).where("shard <= _shard").withColumnRenamed("_shard", "other")
    right = graphs.withColumnRenamed("shard", "other").join(names, ["label", "width"]).where("_shard <= other").withColumnRenamed("_shard", "shard")
    by = ["label", "width", "shard", "other"]
    right = right.select(*[F.col(c).alias(f"{c}_") for c in [*by, "graph"]])
    met = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInArrow(_met(threshold, beam), _ANSWER)
    answers = stored(met, "links")
    return answers.where("expected is null").select("node", "root", "others"), answers.where("expected is not null").select("expected", "found", "beam")


def audited_links(classes: DataFrame, threshold: float, beam: int = BEAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``links_of`` with beams wide enough for the audits of all tasks together."""
    while True:
        reached, audits = links_of(classes, threshold, beam, shard)
        total = audits.agg(F.sum("expected").alias("expected"), F.sum("found").alias("found")).first()
        if not total.expected or total.found >= RECALL * total.expected or beam >= shard:
            return reached, audits
        beam *= 2


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
                    beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """One row per row of ``df``: the number of other vectors linked to it, the smallest key in reach of its links, and whether that is its own.

    Vectors are compared if their labels are equal and not null and their lengths are equal. Vectors that are null, empty or zero, or hold
    null or non-finite entries, link with nothing and are kept. Repeated rows are vectors of their own. A row without a key gets the
    smallest key in reach, or none; it is kept only if there is none.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))

    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(F.forall("vector", fine), F.lit(False))
              & F.coalesce(F.exists("vector", lambda c: c != 0), F.lit(False)))
    rows = rows.withColumn("usable", usable)
    # Zero has two signs that compare equal.
    whole = F.transform("vector", lambda c: F.when(c == 0, F.lit(0)).otherwise(c).cast("double"))
    marks = [F.xxhash64("label", whole), F.xxhash64(whole, F.lit("second"), "label")]
    marked = rows.where("usable").select("key", "label", whole.alias("vector"), marks[0].alias("mark"), marks[1].alias("check"))
    folded = marked.groupBy("mark", "check").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"),
                                                 F.min("key").alias("least"))
    classes = stored(folded.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    reached, _ = audited_links(classes.select("node", "label", "vector", "size"), threshold, beam, shard)
    sizes = classes.select("node", "size", "least")
    beside = reached.groupBy("node").agg(F.sum("others").alias("others"))
    united = stored(graph.components(reached.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
    placed = sizes.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = placed.join(least, "component").join(beside, "node", "left").select(
        "node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    by_mark = stored(classes.select("node", "mark", "check").join(judged, "node").drop("node"), "vector-verdicts")
    linked = salted_join(marked.select("key", F.struct("mark", "check").alias("of"), F.monotonically_increasing_id().alias("row")),
                         by_mark.select(F.struct("mark", "check").alias("of"), "n_links", "component_id"), "of", ["row"])
    alone = rows.where("not usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.select("key", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))

