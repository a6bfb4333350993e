"""Near-duplicate vectors by product quantisation.

Equal vectors form one class. Classes are filed in inverted lists of coarse centroids
with product codes of their residuals. A vector x of list i has to probe list j for
partners within r only if it lies within r of the half space of j, one comparison
per list. The step from x to a partner points anywhere, and its part across that
border is about r / sqrt(dim); ``certainty`` such parts are allowed for, so that a
pair is missed with the chance of a normal value above it; sqrt(dim) makes it exact.
Of two lists the lower one probes the higher, and links count on both sides. In a
list, table lookups give the distance to every coded vector; with the stored coding
error they bound the true distance from below, and what stays is compared exactly by
cosine. Lists and queries are cut into blocks, so a crowded list is many tasks. A
block returns link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import components, durable, id_type

_SUB = 8  # width of a subspace
_CODES = 256
_BLOCK = 512
_ASKED = 2048


def _stack(blobs: pd.Series, kind: str) -> np.ndarray:
    """Stored vectors as rows of doubles, each scaled by a power of two so that its largest component is near one."""
    x = np.stack([np.frombuffer(v, kind) for v in blobs]).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means on a bounded sample."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norm = (centers**2).sum(1)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norm - 2 * x[a : a + 4096] @ centers.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids and the code books of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 6, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centers = _means(sample, lists, rounds, rng)
        residual = sample - self.centers[_nearest(sample, self.centers)]
        dim = sample.shape[1]
        self.cuts = [(a, min(a + _SUB, dim)) for a in range(0, dim, _SUB)]
        self.books = [_means(residual[:, a:b], _CODES, rounds, rng) for a, b in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and coding error."""
        cell = _nearest(x, self.centers)
        residual = x - self.centers[cell]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        rest = np.zeros(len(x))
        for m, (a, b) in enumerate(self.cuts):
            codes[:, m] = _nearest(residual[:, a:b], self.books[m])
            rest += ((residual[:, a:b] - self.books[m][codes[:, m]]) ** 2).sum(1)
        return cell, codes, np.sqrt(rest)

    def probes(self, x: np.ndarray, cell: np.ndarray, margin: float) -> list[np.ndarray]:
        """For each row its own list and the lists above it whose half space is within ``margin``."""
        norm = (self.centers**2).sum(1)
        lists = np.arange(len(self.centers))
        out: list[np.ndarray] = []
        for a in range(0, len(x), 256):
            own = cell[a : a + 256]
            far = norm - 2 * x[a : a + 256] @ self.centers.T
            far -= far[np.arange(len(own)), own][:, None]
            gap = np.sqrt(np.maximum(norm[own][:, None] + norm - 2 * self.centers[own] @ self.centers.T, 0))
            near = (far <= 2 * margin * gap + 1e-9) & (lists >= own[:, None])
            out += [np.flatnonzero(r).astype(np.int32) for r in near]
        return out

    def lower_bounds(self, x: np.ndarray, cell: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Asymmetric table-lookup distances less the coding error: rows of x against coded vectors."""
        residual = x - self.centers[cell]
        total = np.zeros((len(x), len(codes)))
        for m, (a, b) in enumerate(self.cuts):
            book = self.books[m]
            table = (residual[:, a:b] ** 2).sum(1)[:, None] - 2 * residual[:, a:b] @ book.T + (book**2).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0)) - error


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least label of every row and column in its component of a bipartite link matrix."""
    rows, cols = linked.shape
    big = rows + cols
    left, right = np.arange(rows), rows + np.arange(cols)
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], big).min(0, initial=big))
        new_left = np.minimum(left, np.where(linked, new_right[None], big).min(1, initial=big))
        if (new_left == left).all() and (new_right == right).all():
            return np.concatenate([left, right])
        left, right = new_left, new_right


def _linked_pairs(x: np.ndarray, y: np.ndarray, maybe: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the possible pairs reach the cosine.

    The product of crowded blocks may round otherwise than that of single pairs, so
    pairs near the border are always taken one by one.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    linked = np.zeros(maybe.shape, bool)
    if maybe.mean() > 0.05:
        whole = (x @ y.T) / np.outer(nx, ny)
        linked = maybe & (whole >= cosine)
        maybe = maybe & (np.abs(whole - cosine) < 1e-9)
    i, j = np.nonzero(maybe)
    linked[i, j] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= cosine
    return linked


def _block(group: pd.DataFrame, model: Quantiser, cosine: float, radius: float, kind: str) -> pd.DataFrame:
    q, p = group[group["probe"]], group[~group["probe"]]
    none = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})
    if q.empty or p.empty:
        return none
    x, y = _stack(q["vec"], kind), _stack(p["vec"], kind)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in p["codes"]])
    low = model.lower_bounds(_unit(x), int(group["cell"].iloc[0]), codes, p["error"].to_numpy())
    linked = _linked_pairs(x, y, low <= radius + 1e-7, cosine)
    qn, pn = q["node"].to_numpy(), p["node"].to_numpy()
    linked &= qn[:, None] != pn[None]
    links = linked @ p["members"].to_numpy()
    foreign = (q["home"] != q["cell"]).to_numpy()  # these lists don't probe back
    back = (q["members"].to_numpy() * foreign) @ linked
    label = _forest(linked)
    names = np.concatenate([qn, pn])
    bound = np.flatnonzero(label != np.arange(len(label)))
    some, more = np.flatnonzero(links), np.flatnonzero(back)
    counted = np.concatenate([links[some], back[more]]).astype(np.int64)
    return pd.DataFrame({
        "a": np.concatenate([names[bound], qn[some], pn[more]]),
        "b": np.concatenate([names[label[bound]], np.full(len(counted), None, object)]),
        "links": np.concatenate([np.zeros(len(bound), np.int64), counted]),
    })


def _linked(
    classes: DataFrame, kind: str, cosine: float, certainty: float, sample_rows: int, list_size: int, most_lists: int
) -> DataFrame:
    """Rows (a, b, links) of the classes of one dimension: forest edges, and link counts with null b."""
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    n = classes.count()
    grain = 1 << 30
    share = int(min(1.0, sample_rows / max(n, 1)) * grain)
    drawn = classes.filter(F.pmod(F.xxhash64("node"), F.lit(grain)) < share).select("vec").toPandas()
    if drawn.empty:
        drawn = classes.limit(1).select("vec").toPandas()
    sample = _unit(_stack(drawn["vec"], kind))
    margin = radius * min(1.0, certainty / np.sqrt(sample.shape[1]))
    lists = int(min(most_lists, max(1, n // list_size)))
    model = spark.sparkContext.broadcast(Quantiser(sample, lists))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = _unit(_stack(batch["vec"], kind))
            cell, codes, error = model.value.encode(x)
            yield batch.assign(
                cell=cell, codes=[c.tobytes() for c in codes], error=error, probes=model.value.probes(x, cell, margin)
            )

    schema = "node string, members bigint, vec binary, cell int, codes binary, error double, probes array<int>"
    indexed = durable(classes.select("node", "members", "vec").mapInPandas(index, schema))
    filed = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("p"))
    asked = indexed.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    blocks = F.broadcast(  # one row per list, at most ``most_lists``
        filed.join(asked, "cell").select(
            "cell", F.ceil(F.col("p") / _BLOCK).cast("int").alias("ps"), F.ceil(F.col("q") / _ASKED).cast("int").alias("qs")
        )
    )
    part = F.xxhash64("node", F.lit("block"))
    columns = ["node", "members", "vec", "home", "cell", "codes", "error"]
    asks = (
        indexed.select("node", "members", "vec", F.col("cell").alias("home"), F.explode("probes").alias("cell"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
        .join(blocks, "cell")
        .select(*columns, F.lit(True).alias("probe"), F.pmod(part, F.col("qs")).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("s"))
    )
    posts = (
        indexed.withColumn("home", F.col("cell")).select(*columns)
        .join(blocks, "cell")
        .select(*columns, F.lit(False).alias("probe"), F.pmod(part, F.col("ps")).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("t"))
    )
    both = asks.unionByName(posts)

    def block(group: pd.DataFrame) -> pd.DataFrame:
        return _block(group, model.value, cosine, radius, kind)

    return both.groupBy("cell", "s", "t").applyInPandas(block, "a string, b string, links bigint")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    sample_rows: int = 20_000,
    certainty: float = 3.5,
    list_size: int = 200,
    most_lists: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_links, component_id and kept.

    ``n_links`` counts the other rows with a cosine of at least ``cosine``,
    ``component_id`` is the smallest id reachable by links, ``kept`` marks the rows
    that carry it. Centroids and code books are fitted on about ``sample_rows``
    classes, drawn by hash; every row is filed and every row is a query.

    Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing and are their own component; vectors of different length never
    link. Null ids take part but are never the smallest id; rows that share an id
    are rows of their own. An empty table gives no rows; other columns are not read.
    """
    v = F.col("v")
    fine = (
        v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    single = id_type(df, vector_col) == "array<float>"  # what else there is, is compared in double precision
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    rows = df.select(F.col(id_col).alias("k"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    name = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), v, F.lit("vector"))))
    named = durable(rows.select("k", "v", F.when(F.col("fine"), name).alias("node")))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [np.asarray(x, kind).tobytes() for x in batch["v"]]
            yield pd.DataFrame({"node": batch["node"], "members": batch["members"], "least": batch["least"], "vec": blobs})

    grouped = named.filter("node IS NOT NULL").groupBy("node", "v").agg(F.count(F.lit(1)).alias("members"), F.min("k").alias("least"))
    classes = durable(grouped.mapInPandas(packed, f"node string, members bigint, least {id_type(df, id_col)}, vec binary"))
    sizes = [r["s"] for r in classes.select((F.octet_length("vec") / width).cast("int").alias("s")).distinct().orderBy("s").collect()]
    found = None
    for size in sizes:  # one, as a rule
        part = _linked(classes.filter(F.octet_length("vec") == width * size), kind, cosine, certainty, sample_rows, list_size, most_lists)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return named.select(F.col("k").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(found)
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select("node", "root")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = (
        classes.select("node", "members", "least").join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = placed.join(least, "root").select("node", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.filter("node IS NOT NULL").select("k", "node").join(told, "node").select("k", "n_links", "component_id")
    alone = named.filter("node IS NULL").select("k", F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("component_id"))
    both = out.unionAll(alone)
    return both.select(
        F.col("k").alias(id_col), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept")
    )
