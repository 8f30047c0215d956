"""CL2: Ward's hierarchy by rounds of reciprocal nearest neighbours, and its cuts into 1, 2, ... clusters.

The cost of joining two clusters is n m / (n + m) times the squared distance of their centroids. Two clusters that are
each other's cheapest partner are joined by the sequential method too, sooner or later, whatever else is joined (the
cost is reducible), so all such pairs join in one round, with centroids weighed by their sizes. Partners are found
exactly, by blocks, each two of which meet once for both sides: products of matrices in single precision leave few pairs to
compute. A cluster keeps some of its cheapest partners; from the second round on only new clusters and those that have lost
all of theirs are compared with all others. Equal vectors join first. Once no more than SMALL clusters, a block, are left, one task of that bounded size joins the rest.

Ties are broken by ids alike on both sides. A cluster is named by its least id: each id but the last one is absorbed once, so
a join is (id, into, cost, round). A cut into k clusters takes back the k - 1 dearest joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.graph import stored
from textloom.operators.vectors import BLOCK, MOST, by_blocks, id_type, in_blocks

#: Clusters that one task may join to the end: a block's. The last FEW of them are joined in the order of their costs.
SMALL, FEW = MOST, 1024
#: Blocks, at least, that more than BLOCK rows a block leave.
BLOCKS = 8
#: Rows that are looked at together, columns of a product, and pairs of a row that may be left to exact arithmetic.
TILE, COLUMNS, MANY = 32, 256, 16
#: Blocks that a task keeps at hand in order.
HELD = 6
#: Partners that a cluster keeps, for when the first of them are joined to others.
KEPT = 16


def costs(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The costs of joining clusters; the same number from both sides."""
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d += (a[:, k, None] - b[None, :, k]) ** 2
    return d * (n[:, None] * m[None, :] / (n[:, None] + m[None, :]))


def exact_costs(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The costs of pairs of rows; the same numbers as costs()."""
    d = np.zeros(len(a))
    for k in range(a.shape[1]):
        d += (a[:, k] - b[:, k]) ** 2
    return d * (n * m / (n + m))


def looked_at(d: np.ndarray, slack: np.ndarray, m: np.ndarray, n: np.ndarray, limit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, least cost possible) of the rough squared distances d that may be one of a column's `count` cheapest, none
    dearer than the column's limit, which is lowered; m and n are the sizes of the rows and of the columns, m in order.

    TILE rows are looked at by their least distance first, with the sizes of the first and the last of them."""
    least = d.reshape(-1, TILE, d.shape[1]).min(axis=1).astype(float)
    low, high = m[::TILE, None], m[TILE - 1 :: TILE, None]
    most = (least + slack) * (high * n / (high + n))
    for _ in range(count - 1):
        most[most.argmin(axis=0), np.arange(len(n))] = np.inf
    np.minimum(limit, most.min(axis=0), out=limit)
    t, c = np.nonzero(np.maximum(least - slack, 0.0) * (low * n / (low + n)) <= limit)
    r = t[:, None] * TILE + np.arange(TILE)
    near, weight = d[r, c[:, None]].astype(float), m[r] * n[c, None] / (m[r] + n[c, None])
    cost = np.maximum(near - slack[c, None], 0.0) * weight
    k, e = np.nonzero((cost <= limit[c, None]) & np.isfinite(cost))
    return r[k, e], c[k], cost[k, e]


def left_side(rows: np.ndarray, squares: np.ndarray, kind: type) -> np.ndarray:
    """(-2 row, 1, square): times (other row, its square, 1) the squared distance; rows that fill up the last tile are endless."""
    out = np.zeros((len(squares), rows.shape[1] + 2), kind)
    with np.errstate(over="ignore"):
        out[: len(rows), :-2] = rows
        out[: len(rows), :-2] *= -2
        out[:, -2], out[:, -1] = 1, squares
    return out


def in_sizes(b: np.ndarray, m: np.ndarray) -> dict:
    """The rows in the order of their sizes, filled up to whole tiles, and from their middle."""
    order, full = np.argsort(m, kind="stable"), -(-len(b) // TILE) * TILE
    sizes, squares = np.full(full, m[order[-1]]), np.full(full, np.inf)
    sizes[: len(b)], middle = m[order], b.mean(axis=0)
    rows = b[order]
    rows -= middle
    squares[: len(b)] = np.einsum("ij,ij->i", rows, rows)
    return {"middle": middle, "order": order, "sizes": sizes, "squares": squares, "lefts": {np.float32: left_side(rows, squares, np.float32)}}


def cheapest(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most_a: np.ndarray, most_b: np.ndarray, own: np.ndarray | None = None, count: int = 1, ready: dict | None = None) -> list[tuple]:
    """[(places in a, places in b, costs, last), (places in b, places in a, costs, last)]: for each row of a its cheapest row of
    b, of equal ones the first, and for each row of b its cheapest of a, or its two cheapest if `count` is 2; none above the
    rows' limits most_a and most_b. `last` marks the one of number `count`, which no row that is left out undercuts. `own` are
    the places of the rows of a in b, which they don't meet. `ready` keeps what is made of b alone for other calls with it.

    One product of matrices gives the rough distances for both sides, in single precision; those that its rounding may part
    are computed exactly. Where these are many (distances much smaller than the vectors), the product is made again in double."""
    if not len(a) or not len(b):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))] * 2
    ready = {} if ready is None else ready
    if not ready:
        ready.update(in_sizes(b, m))
    middle, order, size_b, sb, lefts = (ready[c] for c in ("middle", "order", "sizes", "squares", "lefts"))
    width, full, largest = a.shape[1], len(size_b), sb[: len(b)].max()
    # Of the rows of b: what their cheapest one costs at most, and the one of number `count`.
    first_b, limit_b = np.full(len(b), np.inf), most_b[order].astype(float)
    both = bool((limit_b >= 0).any())
    place = np.argsort(order) if own is not None else None
    by_size = np.argsort(n, kind="stable")
    spaces = {kind: np.empty(full * min(COLUMNS, len(a)), kind) for kind in (np.float32, np.float64)}
    of_a, of_b = [], []
    for s in range(0, len(a), COLUMNS):
        part = by_size[s : s + COLUMNS]
        right = np.ones((len(part), width + 2))
        right[:, :width] = a[part] - middle
        sa = right[:, width] = (right[:, :width] ** 2).sum(axis=1)
        for kind in (np.float32, np.float64):
            # Each product has two roundings, each sum one; the terms' sizes add up to 2 (sa + sb) at most.
            eps = (width + 8) * 2.0 * np.finfo(kind).eps
            if kind is np.float32 and largest + sa.max() > 1e30:
                continue
            if kind not in lefts:
                lefts[kind] = left_side(b[order] - middle, sb, kind)
            d = np.matmul(lefts[kind], right.astype(kind).T, out=spaces[kind][: full * len(part)].reshape(full, -1))
            if own is not None:
                d[place[own[part]], np.arange(len(part))] = np.inf
            limit = most_a[part].astype(float)
            near = looked_at(d, eps * (sa + largest), size_b, n[part], limit, count)
            if both:
                slack = eps * (sb[: len(b)] + sa.max())
                size, half = size_b[: len(b)], -(-len(part) // count)
                low, high = size * n[part[0]] / (size + n[part[0]]), size * n[part[-1]] / (size + n[part[-1]])
                least = [d[: len(b), k : k + half].min(axis=1, initial=np.inf) for k in range(0, half * count, half)]
                most = [(x + slack) * high for x in least]
                least, first = np.minimum(least[0], least[-1]), np.minimum(most[0], most[-1])
                # The second of the two known and the two new ones.
                lowered = np.minimum(limit_b, first if count == 1 else np.minimum(np.maximum(first_b, first), np.maximum(*most)))
                reach = lowered / low + slack
                rows = np.flatnonzero(least <= reach)
                k, e = np.nonzero(d[rows] <= reach[rows, None].astype(kind) * kind(1 + 1e-6))
                j = rows[k]
                weight = size[j] * n[part[e]] / (size[j] + n[part[e]])
                near_b = d[j, e].astype(float)
                cost = np.maximum(near_b - slack[j], 0.0) * weight
                keep = (cost <= lowered[j]) & np.isfinite(cost)
                back = (j[keep], e[keep], cost[keep])
            if kind is np.float64 or len(near[0]) + (len(back[0]) if both else 0) <= MANY * (len(part) + len(b)):
                break
        keep = near[2] <= limit[near[1]]
        of_a.append((part[near[1][keep]], order[near[0][keep]]))
        if both:
            limit_b, first_b = lowered, np.minimum(first_b, first)
            of_b.append((back[0], part[back[1]], back[2]))
    found = []
    if both:
        j, i, cost = (np.concatenate(x) for x in zip(*of_b, strict=True))
        keep = cost <= limit_b[j]
        of_b = [(order[j[keep]], i[keep])]
    for sides, x, y, p, q, most in ((of_a, a, b, n, m, most_a), (of_b, b, a, m, n, most_b)):
        i, j = (np.concatenate(x) for x in zip(*sides, strict=True)) if sides else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cost = np.concatenate([exact_costs(x[i[s : s + 65536]], p[i[s : s + 65536]], y[j[s : s + 65536]], q[j[s : s + 65536]]) for s in range(0, max(1, len(i)), 65536)])
        keep = cost <= most[i]
        i, j, cost = i[keep], j[keep], cost[keep]
        by = np.lexsort((j, cost, i))
        i, j, cost = i[by], j[by], cost[by]
        number = np.arange(len(i)) - np.searchsorted(i, i)
        kept = number < count
        found.append((i[kept], j[kept], cost[kept], number[kept] == count - 1))
    return found


def partners(clusters: DataFrame, size: int, total: int | None = None) -> DataFrame:
    """(id, near, floor) of clusters (id, n, v, fresh, near, floor): `near` holds the cheapest partners (cost, partner) of each, in order,
    KEPT at most, the first one always; any cluster that it doesn't hold costs `floor` or more.

    Clusters without partners (`near` is null) are compared with all; those that have some, which hold for all that are not
    fresh, only with the fresh ones, up to their floor. Each two blocks meet once, for both sides."""
    kind = id_type(clusters)
    rows = clusters.select("id", "n", "v", F.when(F.col("fresh"), F.lit(-2.0)).when(F.col("near").isNull(), F.lit(-1.0)).otherwise(F.col("floor")).alias("have"))
    total = rows.count() if total is None else total
    blocks = in_blocks(rows, "v", ["n", "have"], max(size, min(MOST, total // BLOCKS)) if size == BLOCK else size, total)
    floors, lately = {}, {}  # by block and kind, and by block: each task has its own

    def in_kinds(x):
        """The fresh rows, others without partners, and those with some, by their ids: (ids, vectors, sizes, floors, ready)."""
        if x["block"] in lately:
            return lately[x["block"]]
        if len(lately) == HELD:
            lately.clear()
        order, out = np.asarray(pc.sort_indices(x["ids"])), []
        kinds = np.clip(x["have"][order], -2, 0)
        for k in (-2, -1, 0):
            at = order[kinds == k]
            if (x["block"], k) not in floors:
                floors[x["block"], k] = np.where(x["have"][at] < 0, np.inf, x["have"][at])
            out.append((x["ids"].take(pa.array(at)), x["data"][at], x["n"][at], floors[x["block"], k], {}))
        lately[x["block"]] = out
        return out

    def work(a, b):
        same, left, right = a["block"] == b["block"], in_kinds(a), in_kinds(b)
        for k, l in ((k, l) for k in range(3) for l in range(k if same else 0, 3) if min(k, l) < 2):
            p, q = (left[k], right[l]) if k <= l else (right[l], left[k])
            own = np.arange(len(p[0])) if same and k == l else None
            # Rows that meet themselves have all on one side of the product; partners that are not fresh are known.
            most = np.full(len(q[3]), -np.inf) if own is not None or {k, l} == {1, 2} else q[3]
            for (x, y), (i, j, cost, last) in zip(((p, q), (q, p)), cheapest(p[1], p[2], q[1], q[2], p[3], most, own, 2, q[4]), strict=True):
                x[3][i[last]] = cost[last]
                if len(i):
                    columns = [x[0].take(pa.array(i)), y[0].take(pa.array(j)), pa.array(cost), pa.array(np.where(last, cost, np.inf))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "partner", "cost", "floor"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("partner", kind), T.StructField("cost", T.DoubleType()), T.StructField("floor", T.DoubleType())])
    found = by_blocks(blocks, blocks, work, schema, twice=False)
    found = found.groupBy("id").agg(F.collect_list(F.struct("cost", "partner")).alias("new"), F.min("floor").alias("low"))
    known = clusters.select("id", "near", "floor").join(found.hint("merge"), "id", "left")
    near = F.sort_array(F.concat(*[F.coalesce(c, F.array().cast(near_type(kind))) for c in ("near", "new")]))
    every = known.select("id", near.alias("near"), F.least("floor", "low").alias("floor"))
    every = every.select("id", "near", F.least("floor", F.get("near", F.lit(KEPT))["cost"]).alias("floor"))
    return every.select("id", F.filter(F.slice("near", 1, KEPT), lambda x, k: (k == 0) | (x["cost"] < F.col("floor"))).alias("near"), "floor")


def near_type(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("partner", kind)]))


def rounds_of_block(n: np.ndarray, v: np.ndarray, least: int) -> tuple[list[tuple], np.ndarray]:
    """The same rounds for clusters of one block, in the order of their ids, until `least` are left: (absorbed, other, cost, round
    from 0) by places, and the places left; n and v are changed."""
    out, turn, left = [], 0, np.arange(len(n))
    partner, cost = np.full(len(n), -1), np.full(len(n), np.inf)
    while len(left) > max(1, least):
        asks = partner[left] < 0
        q, rest = left[asks], left[~asks]
        sides = [cheapest(v[q], n[q], v[q], n[q], cost[q], np.full(len(q), -np.inf), np.arange(len(q)))[0]]
        sides = [(q[i], q[j], c) for i, j, c, _ in sides]
        there, back = cheapest(v[q], n[q], v[rest], n[rest], cost[q], cost[rest])
        sides += [(q[there[0]], rest[there[1]], there[2]), (rest[back[0]], q[back[1]], back[2])]
        for i, j, c in sides:
            better = (c < cost[i]) | ((c == cost[i]) & ((partner[i] < 0) | (j < partner[i])))
            partner[i[better]], cost[i[better]] = j[better], c[better]
        i = left[(partner[partner[left]] == left) & (left < partner[left])]
        j = partner[i]
        out.extend(zip(j.tolist(), i.tolist(), cost[i].tolist(), [turn] * len(i), strict=True))
        v[i] = (n[i][:, None] * v[i] + n[j][:, None] * v[j]) / (n[i] + n[j])[:, None]
        n[i] += n[j]
        gone = np.zeros(len(n), bool)
        gone[i] = gone[j] = True
        alive = np.ones(len(n), bool)
        alive[j] = False
        left = left[alive[left]]
        lost = left[gone[left] | gone[partner[left]]]
        partner[lost], cost[lost] = -1, np.inf
        turn += 1
    return out, left


def last_joins(ids: np.ndarray, n: np.ndarray, v: np.ndarray) -> list[tuple]:
    """Joins of a block's clusters to the end: (position of the absorbed id, position of the other, cost, round from 0); once few
    are left, in the order of their costs."""
    order = np.argsort(ids, kind="stable")
    n, v = n[order].astype(float), v[order].astype(float)
    out, left = rounds_of_block(n, v, FEW)
    order_left, n, v = order[left], n[left], v[left]
    turn = out[-1][3] + 1 if out else 0
    out = [(order[j], order[i], c, k) for j, i, c, k in out]
    cost = costs(v, n, v, n)
    np.fill_diagonal(cost, np.inf)
    for k in range(len(left) - 1):
        i, j = sorted(divmod(int(cost.argmin()), len(left)))
        out.append((order_left[j], order_left[i], cost[i, j], turn + k))
        v[i] = (n[i] * v[i] + n[j] * v[j]) / (n[i] + n[j])
        n[i] += n[j]
        cost[j, :] = cost[:, j] = np.inf
        alive = np.isfinite(cost[i]) | (np.arange(len(left)) == i)
        new = costs(v[i : i + 1], n[i : i + 1], v, n)[0]
        cost[i, :] = cost[:, i] = np.where(alive & (np.arange(len(left)) != i), new, np.inf)
    return out


def joins(rows: DataFrame, small: int = SMALL, size: int = BLOCK) -> DataFrame:
    """(id, into, cost, round) of rows (id, vector): one row for each id but the least."""
    kind = id_type(rows)
    points = stored(rows.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("v")))
    none = [F.lit(True).alias("fresh"), F.lit(None).cast(near_type(kind)).alias("near"), F.lit(None).cast("double").alias("floor")]
    clusters = stored(points.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")).select("id", "n", "v", *none))
    heads = clusters.select("v", F.col("id").alias("into"))
    done, turn = [stored(points.join(heads.hint("merge"), "v").filter("id <> into").select("id", "into", F.lit(0.0).alias("cost"), F.lit(0).alias("round")))], 1
    left = clusters.count()
    while left > small:
        near = stored(partners(clusters, size, left))
        first = near.select("id", F.col("near")[0]["partner"].alias("partner"), F.col("near")[0]["cost"].alias("cost"))
        other = first.select(F.col("id").alias("partner"), F.col("partner").alias("back"))
        met = stored(first.join(other.hint("merge"), "partner").filter("back = id AND id < partner").select(F.col("partner").alias("id"), F.col("id").alias("into"), "cost", F.lit(turn).alias("round")))
        done.append(met)
        into = clusters.join(met.select("id", "into").hint("merge"), "id", "left").select(F.coalesce("into", "id").alias("id"), "n", "v")
        # One or two rows a cluster, in the order of their sizes and vectors.
        pairs = into.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("p"))
        a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
        joined = F.zip_with(a["v"], b["v"], lambda x, y: (a["n"] * x + b["n"] * y) / (a["n"] + b["n"]))
        moved = pairs.select("id", F.when(b.isNull(), a["n"]).otherwise(a["n"] + b["n"]).alias("n"), F.when(b.isNull(), a["v"]).otherwise(joined).alias("v"), b.isNotNull().alias("fresh"))
        # A join is never cheaper than both of its parts were: partners that are left as they were stay the cheapest old ones,
        # and the floor holds for all others.
        gone = met.select(F.explode(F.array("id", "into")).alias("partner"))
        kept = near.select("id", "floor", F.explode("near").alias("x")).select("id", "floor", "x.cost", "x.partner").join(gone.hint("merge"), "partner", "left_anti")
        kept = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("cost", "partner"))).alias("near"), F.min("floor").alias("floor"))
        still = [F.when(~F.col("fresh"), F.col(c)).alias(c) for c in ("near", "floor")]
        clusters = stored(moved.join(kept.hint("merge"), "id", "left").select("id", "n", "v", "fresh", *still))
        left -= met.count()
        turn += 1
    schema = T.StructType([T.StructField("id", kind), T.StructField("into", kind), T.StructField("cost", T.DoubleType()), T.StructField("round", T.IntegerType())])

    def finish(batch: pd.DataFrame) -> pd.DataFrame:
        ids = batch["id"].to_numpy()
        found = last_joins(ids, batch["n"].to_numpy(), np.stack(batch["v"].to_list()))
        return pd.DataFrame([(ids[j], ids[i], c, turn + k) for j, i, c, k in found], columns=["id", "into", "cost", "round"])

    out = clusters.groupBy(F.lit("all")).applyInPandas(finish, schema)  # SMALL rows at most
    for met in done:
        out = out.unionByName(met)
    return stored(out)


def levels(rows: DataFrame, most: int = 18, small: int = SMALL, size: int = BLOCK) -> DataFrame:
    """(id, c1, ..., c<most>) of rows (id, vector): the cluster of each id, named by its least id, when the hierarchy is cut into
    1, 2, ... clusters; beyond the number of rows each is alone."""
    made = joins(rows, small, size)
    # The dearest joins are `most` rows at most; a join is dearer than those below it, or equal and later.
    top = made.orderBy(F.desc("cost"), F.desc("round"), "id").limit(most - 1).collect()
    rank = {r["id"]: k + 1 for k, r in enumerate(top)}
    into = {r["id"]: r["into"] for r in top}
    special = list(rank)

    # Each id climbs to the first one that a cut may part from what absorbed it, or to the last of all.
    up = made.select("id", F.when(F.col("id").isin(special), F.col("id")).otherwise(F.col("into")).alias("to")) if special else made.select("id", F.col("into").alias("to"))
    up = stored(up)
    while True:
        further = up.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = stored(up.join(further.hint("merge"), "to", "left").select("id", F.coalesce("next", "to").alias("new"), F.col("to").alias("old")))
        up = moved.select("id", F.col("new").alias("to"))
        if moved.filter("new <> old").isEmpty():
            break
    climbed = rows.filter("id IS NOT NULL AND vector IS NOT NULL").select("id").join(up, "id", "left").select("id", F.coalesce("to", "id").alias("to"))
    tops = {r["to"] for r in up.select("to").distinct().limit(most + 1).collect()} | set(special)
    # What absorbed a special id may itself have been absorbed by an ordinary join: its head is looked up.
    lookup = {r["id"]: r["to"] for r in climbed.filter(F.col("id").isin(list(into.values()))).collect()} if into else {}
    table = []
    for x in tops:
        row = [x]
        for k in range(1, most + 1):
            at = x
            while at in rank and rank[at] > k - 1:
                at = lookup[into[at]]
            row.append(at)
        table.append(tuple(row))
    names = [f"c{k}" for k in range(1, most + 1)]
    if not table:
        return climbed.select("id", *[F.col("to").alias(c) for c in names])
    schema = T.StructType([T.StructField("to", id_type(rows))] + [T.StructField(c, id_type(rows)) for c in names])
    found = climbed.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "to", "left")
    return found.select("id", *[F.coalesce(c, "to").alias(c) for c in names])
