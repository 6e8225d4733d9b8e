"""Near-duplicate embeddings by robust-pruned flat graphs over overlapping cluster shards.

Vectors are compared within a label only. Equal vectors become one node with a number of copies. The nodes of a label are split into cells by
k-means, again and again until a cell holds ``cell_size`` nodes at most; a node whose second-nearest centre is nearly as near goes to both cells,
so shards overlap. In each shard every node gets pruned neighbours (a neighbour is dropped when one already taken is nearer to it by the factor
``alpha``), and the adjacency lists of all shards are united per node. A search shard is a cell with the nodes its lists lead to. The members whose first
cell it is are the queries: all go from the medoids greedily to their own place, then the range expands through every node above a margin
below the threshold. A part of the graph that no medoid leads to hangs on its nearest reached node. Links are verified by the cosine in double precision. Links within a shard are counted and their components found there; links
that leave it are given as pairs, from either side, and counted once.

Centres closer than twice the distance of two linked vectors make one cell. Cells that k-means can't split (a dense family) are cut into blocks, and each pair of blocks is a shard of its own, compared through
its own graph from either side, so no task holds more than two blocks and no pair of blocks is left out. A block against itself holds its overlap
members too. A link to a node whose first cell is another one is given as a pair, so that it is counted once whichever side finds it.

k-means is fitted on at most ``SAMPLE`` nodes of a cell; every node is indexed. ``recall`` compares at most ``AUDIT`` queries with all vectors.

Vectors that are null, empty, zero or hold a null or non-finite component, rows without a label and rows without an id link with nothing and
have themselves as component (null without an id). Vectors of different lengths are not compared. Repeated rows count as other vectors. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cargoline.llm.batches import ship
from cargoline.llm.graph import components
from cargoline.session import materialize

THRESHOLD = 0.98
CELL_SIZE = 1024
#: Nodes of a cell that k-means is fitted on, and centres it makes at most.
SAMPLE, CENTRES = 4096, 16
#: Nodes that one task assigns to centres at a time.
PART = 8192
#: A second cell is taken where its centre is this much farther at most: the distance of two vectors at the threshold.
SLACK = 0.2
DEGREE, BEAM, ALPHA = 24, 24, 1.2
#: How far below the threshold the range search goes on through the graph.
MARGIN = 0.06
ROUNDS = 12
#: Medoids that a search starts from, at most.
MEDOIDS = 32
#: Open nodes that one step expands.
_STEP = 8
AUDIT = 1024


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(embedding: Column, label: Column, id_col: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & id_col.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame, id_col: str, embedding: str, label: str) -> DataFrame:
    """(id, embedding, label). Single-precision vectors stay as they are, since doubling them loses nothing; all other numbers become doubles."""
    kind = "array<float>" if rows.schema[embedding].dataType == T.ArrayType(T.FloatType(), rows.schema[embedding].dataType.containsNull) else "array<double>"
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{embedding}`").cast(kind).alias("embedding"), F.col(f"`{label}`").cast("string").alias("label"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors, from seeds far apart. Centres of length one keep the cells even where vectors point everywhere."""
    centres, far = [x[0]], 1 - x @ x[0]
    for _ in range(k - 1):
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, 1 - x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            total = x[near == j].sum(axis=0)
            if (length := np.sqrt(total @ total)) > 1e-9:
                c[j] = total / length
    return c


def _split(cells: DataFrame, big: DataFrame, cell_size: int) -> DataFrame:
    """Members of the ``big`` cells in their new cells."""
    order = W.partitionBy("cell").orderBy(F.xxhash64("node"))
    fit = cells.where("first").join(big, "cell").withColumn("row", F.row_number().over(order)).where(F.col("row") <= SAMPLE)

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        c = kmeans(_unit(pdf["embedding"]), min(CENTRES, 2 * int(np.ceil(pdf["members"].iloc[0] / cell_size)), len(pdf)))
        # centres that near vectors could lie between make one cell: a family of near-duplicates is not cut
        group = np.arange(len(c))
        for k in range(len(c)):
            near = np.sqrt(((c - c[k]) ** 2).sum(axis=1)) < 2 * SLACK
            group[np.isin(group, group[near])] = group[near].min()
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "members": pdf["members"].iloc[0], "group": group, "vector": list(c)})

    centres = materialize(fit.select("cell", "members", "node", "embedding").groupBy("cell").applyInPandas(
        centre, "cell string, members bigint, group int, vector array<double>"), "centres")
    parts = F.ceil(F.col("members") / PART)
    placed = cells.join(big, "cell").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    spread = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cell": [], "node": [], "copies": [], "embedding": [], "first": []})
        x, c, group = _unit(left["embedding"]), np.array(right["vector"].tolist()), right["group"].to_numpy()
        own = np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))
        groups = np.unique(group)
        distance = np.stack([own[:, group == g].min(axis=1) for g in groups], axis=1)
        order = np.argsort(distance, axis=1)
        rows = np.arange(len(x))
        names = left["cell"].to_numpy() + "/"
        out = [pd.DataFrame({"cell": names + groups[order[:, 0]].astype(str), "node": left["node"], "copies": left["copies"], "embedding": left["embedding"], "first": left["first"]})]
        if len(groups) > 1:
            also = distance[rows, order[:, 1]] <= distance[rows, order[:, 0]] + SLACK
            also &= left["first"].to_numpy()  # a node is in two cells at most for each split of its first cell
            if also.any():
                out.append(pd.DataFrame({"cell": (names + groups[order[:, 1]].astype(str))[also], "node": left["node"][also], "copies": left["copies"][also],
                                         "embedding": left["embedding"][also], "first": False}))
        return pd.concat(out)

    return placed.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(
        assign, f"cell string, node bigint, copies bigint, embedding {cells.schema['embedding'].dataType.simpleString()}, first boolean")


def _cells(points: DataFrame, cell_size: int) -> tuple[DataFrame, DataFrame]:
    """(members of cells that are small enough, members of cells that can't be split)."""
    done, dense = None, None
    cells = materialize(points.select(F.concat_ws(":", "label", F.size("embedding")).alias("cell"), "node", "copies", "embedding", F.lit(True).alias("first")), "cells")
    before: dict | None = None
    for _ in range(ROUNDS):
        sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("members")), "cell-sizes")
        big = sizes.where(F.col("members") > cell_size)
        small = cells.join(sizes.where(F.col("members") <= cell_size).select("cell"), "cell")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            return materialize(done, "small-cells"), dense if dense is None else materialize(dense, "dense-cells")
        parent = F.regexp_replace("cell", "/[0-9]+$", "")
        if before is not None:  # a cell nearly as large as the one it came from is not split again
            kept = big.withColumn("parent", parent).join(before, "parent")
            stuck = kept.where(F.col("members") > 0.9 * F.col("was")).select("cell")
            stuck_members = cells.join(stuck, "cell")
            dense = stuck_members if dense is None else dense.unionByName(stuck_members)
            big = big.join(stuck, "cell", "left_anti")
        before = sizes.select(F.col("cell").alias("parent"), F.col("members").alias("was"))
        cells = materialize(_split(cells, big, cell_size), "cells")
    dense = cells if dense is None else dense.unionByName(cells)
    return materialize(done, "small-cells"), materialize(dense, "dense-cells")


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each unit vector among the others."""
    n = len(x)
    if n == 1:
        return [np.array([], dtype=np.int64)]
    lists = []
    width = min(3 * degree, n - 1)
    for first in range(0, n, 2048):
        sims = x[first : first + 2048] @ x.T
        sims[np.arange(len(sims)), first + np.arange(len(sims))] = -2
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        for row in range(len(sims)):
            cand = near[row][np.argsort(-sims[row, near[row]], kind="stable")]
            own = np.sqrt(np.maximum(2 - 2 * sims[row, cand], 0))
            between = np.sqrt(np.maximum(2 - 2 * (x[cand] @ x[cand].T), 0))
            alive, taken = np.ones(len(cand), dtype=bool), []
            for k in range(len(cand)):
                if alive[k]:
                    taken.append(cand[k])
                    if len(taken) == degree:
                        break
                    alive &= alpha * between[k] > own
            lists.append(np.array(taken))
    return lists


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "near": [nodes[n] for n in robust_prune(_unit(pdf["embedding"]))]})


def medoids(x: np.ndarray) -> np.ndarray:
    """Nodes nearest to the centres of about sqrt(n) groups, and to the mean of all."""
    centres = [x.mean(axis=0), *kmeans(x, min(len(x), MEDOIDS, int(np.ceil(np.sqrt(len(x))))), 2)]
    return np.unique((np.array(centres) @ x.T).argmax(axis=1))


def connected(x: np.ndarray, lists: list[list[int]], starts: np.ndarray) -> np.ndarray:
    """The adjacency lists as a padded matrix in which every node can be reached: what the starts don't lead to hangs on the nearest node they do."""
    reached = np.zeros(len(x), dtype=bool)
    best, holder = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
    new = [int(n) for n in starts]
    while True:
        found = []
        for n in new:
            reached[n] = True
        while new:
            found += new
            near = {m for n in new for m in lists[n] if not reached[m]}
            new = sorted(near)
            reached[new] = True
        if reached.all():
            break
        rest = np.flatnonzero(~reached)
        sims = x[rest] @ x[found].T
        top = sims.argmax(axis=1)
        value = sims[np.arange(len(rest)), top]
        better = value > best[rest]
        best[rest[better]], holder[rest[better]] = value[better], np.array(found)[top[better]]
        node = int(rest[best[rest].argmax()])
        lists[int(holder[node])].append(node)
        new = [node]
    padded = np.full((len(x), max(1, max(map(len, lists)))), -1, dtype=np.int64)
    for k, found in enumerate(lists):
        padded[k, : len(found)] = found
    return padded


def range_search(x: np.ndarray, near: np.ndarray, queries: np.ndarray, starts: np.ndarray, threshold: float, beam: int = BEAM, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``queries``, node) of what each query finds at ``threshold`` or above, itself left out.

    ``near`` holds the neighbours of each node, -1 where there is none. All queries go on together; a step expands each one's best open nodes
    that are among the ``beam`` best seen, or within ``margin`` of the threshold.
    """
    q, n = len(queries), len(x)
    wide, few = min(_STEP, n), min(beam, n)
    sims = np.full((q, n), -np.inf)  # of what a query has seen
    waiting = np.full((q, n), -np.inf)  # of what it has seen and not expanded
    sims[:, starts] = waiting[:, starts] = x[queries] @ x[starts].T
    active = np.arange(q)
    while len(active):
        open_sims = waiting[active]
        best = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
        top = np.take_along_axis(open_sims, best, axis=1)
        bound = -np.partition(-sims[active], few - 1, axis=1)[:, few - 1 : few]
        go = np.isfinite(top) & ((top >= bound) | (top >= threshold - margin))
        rows, cols = np.nonzero(go)
        nodes = best[rows, cols]
        rows = active[rows]
        active = active[go.any(axis=1)]
        waiting[rows, nodes] = -np.inf
        around = near[nodes]
        r, c = np.nonzero(around >= 0)
        pairs = np.unique(rows[r] * np.int64(n) + around[r, c])
        rows, to = pairs // n, pairs % n
        fresh = ~np.isfinite(sims[rows, to])
        rows, to = rows[fresh], to[fresh]
        sims[rows, to] = waiting[rows, to] = np.einsum("ij,ij->i", x[queries[rows]], x[to])
    rows, found = np.nonzero(sims >= threshold)
    other = found != queries[rows]
    return rows[other], found[other]


_QUERIES = 256


def _linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one shard: (0, node, smallest of its component here, copies linked here) per query and (1, node, node, -) per link that leaves it.

    In a shard of two blocks the targets are the other block, and links between nodes at home in the cell are counted from either side in shards of
    their own. Links to other nodes leave it.
    """
    pdf = pdf.sort_values(["node", "query"], ascending=[True, False]).drop_duplicates("node")
    nodes, x, copies = pdf["node"].to_numpy(), _unit(pdf["embedding"]), pdf["copies"].to_numpy()
    query, target, tiled = pdf["query"].to_numpy(), pdf["target"].to_numpy(), bool(pdf["tiled"].iloc[0])
    home = pdf["home"].to_numpy()
    place = {v: k for k, v in enumerate(nodes.tolist())}
    lists = [[place[v] for v in found if v in place] for found in pdf["near"]]
    starts = medoids(x)
    near = connected(x, lists, starts)
    asked = np.flatnonzero(query)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(asked), _QUERIES):
        part = asked[first : first + _QUERIES]
        rows, found = range_search(x, near, part, starts, threshold)
        ends.append((part[rows], found))
    a = np.concatenate([e[0] for e in ends]) if ends else np.array([], dtype=np.int64)
    b = np.concatenate([e[1] for e in ends]) if ends else np.array([], dtype=np.int64)
    if tiled:
        keep = target[b]
        a, b = a[keep], b[keep]
    inner = home[b]
    leave = np.stack([a[~inner], b[~inner]])
    if tiled:
        a, b = a[inner], b[inner]
    else:
        pairs = np.unique(np.stack([np.minimum(a[inner], b[inner]), np.maximum(a[inner], b[inner])]), axis=1)  # found from either side
        a, b = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    count = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(count, a, copies[b])
    least = np.arange(len(nodes))
    while True:  # the smallest index spreads along links; pointers are shortened as it goes
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            break
        least = new
    shown = np.flatnonzero(query | (least != np.arange(len(nodes))))
    out = pd.DataFrame({"kind": 0, "a": nodes[shown], "b": nodes[least[shown]], "n": np.where(query[shown], count[shown], 0), "m": 0})
    if leave.shape[1]:
        low, high = leave.min(axis=0), leave.max(axis=0)
        out = pd.concat([out, pd.DataFrame({"kind": 1, "a": nodes[low], "b": nodes[high], "n": copies[high], "m": copies[low]})])
    return out


def links(points: DataFrame, threshold: float = THRESHOLD, cell_size: int = CELL_SIZE) -> DataFrame:
    """Search all ``points`` (label, node, copies, embedding); rows (kind, a, b, n, m) as ``_linked`` gives them, written to the shared folder."""
    ship(points.sparkSession)
    small, dense = _cells(points, cell_size)
    members = small.withColumn("tiled", F.lit(False)).withColumn("target", F.lit(True)).withColumn("home", F.col("first")).withColumnRenamed("first", "query")
    if dense is not None:
        sizes = dense.groupBy("cell").agg(F.ceil(F.count("*") / (cell_size / 2)).cast("int").alias("blocks"))
        blocks = dense.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        ask = blocks.where("first").withColumn("other", F.explode(every)).select(
            F.concat_ws("#", "cell", "block", "other").alias("cell"), "node", "copies", "embedding", F.lit(True).alias("query"), (F.col("other") == F.col("block")).alias("target"), F.lit(True).alias("home"))
        tell = blocks.withColumn("other", F.explode(every)).where("other <> block OR NOT first").select(
            F.concat_ws("#", "cell", "other", "block").alias("cell"), "node", "copies", "embedding", F.lit(False).alias("query"), F.lit(True).alias("target"), F.col("first").alias("home"))
        members = members.unionByName(ask.unionByName(tell).withColumn("tiled", F.lit(True)))
    members = materialize(members.select("cell", "node", "copies", "embedding", "query", "target", "home", "tiled"), "shards")
    lists = members.groupBy("cell").applyInPandas(lambda pdf: _graph(pdf), "node bigint, near array<bigint>")
    united = materialize(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    inside = members.join(united, "node")
    reach = members.where("query AND NOT tiled").select("cell", "node").join(united, "node").select("cell", F.explode("near").alias("node")).distinct()
    halo = reach.join(members.select("cell", "node"), ["cell", "node"], "left_anti").join(points.select("node", "copies", "embedding"), "node").join(united, "node").select(
        "cell", "node", "copies", "embedding", F.lit(False).alias("query"), F.lit(True).alias("target"), F.lit(False).alias("home"), F.lit(False).alias("tiled"), "near")
    return materialize(inside.unionByName(halo).groupBy("cell").applyInPandas(
        lambda pdf: _linked(pdf, threshold), "kind int, a bigint, b bigint, n bigint, m bigint"), "links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                    cell_size: int = CELL_SIZE) -> DataFrame:
    """One row per row of ``rows``: id, ``n_links``, ``component_id`` and ``kept`` (whether the row's id names its component)."""
    data = _vectors(rows, id_col, embedding, label)
    good = data.where(usable(F.col("embedding"), F.col("label"), F.col("id")))
    points = materialize(good.groupBy("label", "embedding").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "points")
    found = links(points, threshold, cell_size)
    crossing = found.where("kind = 1").select("a", "b", "n", "m").distinct()
    counts = found.where("kind = 0").select(F.col("a").alias("node"), "n").unionByName(crossing.select(F.col("a").alias("node"), "n")).unionByName(
        crossing.select(F.col("b").alias("node"), F.col("m").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    named = components(found.select("a", "b"))
    stats = points.join(counts, "node", "left").join(named, "node", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    ok = usable(data["embedding"], data["label"], data["id"])
    joined = data.join(stats, ok & (data["label"] == stats["l"]) & (data["embedding"] == stats["e"]), "left")
    component = F.coalesce(F.col("c"), F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def recall(rows: DataFrame, result: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
           queries: int = AUDIT) -> tuple[float, int]:
    """Mean share of a vector's links to different vectors that ``result`` counts, and over how many vectors the mean goes.

    At most ``queries`` different vectors (the first by a hash of their smallest id) are compared with all rows; those that this links with a
    different vector are judged, each once, however many copies it has. Links between copies come from a grouping, not from the graph, and are
    left out. Without a judged vector the share is 1 and the number 0.
    """
    ship(rows.sparkSession)
    data = _vectors(rows, id_col, embedding, label)
    data = data.where(usable(F.col("embedding"), F.col("label"), F.col("id")))
    unique = data.groupBy("label", F.xxhash64("embedding").alias("hash")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    drawn = unique.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "copies")  # ``queries`` rows at most
    asked = data.join(F.broadcast(drawn), "id").dropDuplicates(["id"]).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast([(l, len(e), i, e) for i, e, l in asked[["id", "embedding", "label"]].itertuples(index=False)])

    def compare(batches):
        kinds: dict = {}
        for l, d, i, e in shared.value:
            kinds.setdefault((l, d), []).append((i, e))
        kinds = {k: (np.array([i for i, _ in v]), _unit([e for _, e in v])) for k, v in kinds.items()}
        for pdf in batches:
            sums: dict = {}
            for key, part in pdf.groupby(["label", pdf["embedding"].map(len)]):
                if key in kinds:
                    ids, x = kinds[key]
                    for i, n in zip(ids.tolist(), (x @ _unit(part["embedding"]).T >= threshold).sum(axis=1).tolist()):
                        sums[i] = sums.get(i, 0) + n
            yield pd.DataFrame({"id": list(sums), "n": list(sums.values())}, columns=["id", "n"])

    counted = data.mapInPandas(compare, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    copies = rows.sparkSession.createDataFrame(asked[["id", "copies"]].astype("int64"), "id bigint, copies bigint")
    got = result.groupBy(F.col(id_col).alias("id")).agg(F.max("n_links").alias("n_links"))
    both = counted.join(F.broadcast(copies), "id").where("n > copies").join(got, "id").select(
        (F.col("n") - F.col("copies")).alias("exact"), (F.col("n_links") - F.col("copies") + 1).alias("found"))
    share, judged = both.agg(F.avg(F.least("exact", "found") / F.col("exact")), F.count("*")).first()
    return (1.0, 0) if not judged else (share, judged)
