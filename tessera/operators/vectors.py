"""An inverted-file vector index with product codes, stored by cell.

Vectors are brought to unit length and dealt to the nearest of a number of cell centres;
what is left of a vector, its residual, is coded by the nearest of 256 centroids in each of
`parts` slices of its entries. Centres and centroids are fitted by k-means on a bounded
sample (SAMPLE rows, by hash of their ids); every row is indexed.

A search probes the cells nearest to each query: codes are scored by tables of the query's
distances to the centroids, and the best candidates are scored exactly from the stored
vectors. With `exact`, these hits only give a threshold: a cell whose greatest radius, and
then a code whose own error, leaves no way under it is skipped, all else is scored exactly.

A cell of many rows is worked on in pieces of PIECE rows, to each of which its queries are
sent: a vector that a third of the rows share costs no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import cut
from .search import _unit, ranked
from .topk import Best, rounded

#: Distances or scores worked out at once.
SCORES = 4_000_000
SAMPLE = 20_000
PIECE = 50_000
#: Codes of a piece that are scored exactly, times k.
CANDIDATES = 10
#: Files of the index, by cell.
PARTS = 16
SLACK = 1e-4


def _means(rows: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means of rows; starts at distinct rows where there are enough."""
    known = np.unique(rows, axis=0)
    centres = known[draw.permutation(len(known))[:k]]
    for _ in range(rounds):
        near = _nearest(rows, centres)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    step = max(1, SCORES // len(centres))
    for at in range(0, len(rows), step):
        out[at : at + step] = np.argmin((centres * centres).sum(1) - 2 * rows[at : at + step] @ centres.T, 1)
    return out


def fit(vectors: DataFrame, cells: int = 64, parts: int = 8, codes: int = 256, rounds: int = 8, id_col: str = "chunk_id") -> dict | None:
    """The centres of cells and the centroids of each slice, from SAMPLE rows at most;
    None without vectors. The width is that of most vectors."""
    usable = vectors.where("vector is not null and size(vector) > 0")
    width = usable.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if width is None:
        return None
    # Some twice the sample pass by their hash; the first of those are taken.
    drawn = usable.where(F.size("vector") == width["n"]).withColumn("h", F.xxhash64(id_col))
    if width["rows"] > 2 * SAMPLE:
        drawn = drawn.where(F.pmod(F.xxhash64("h"), F.lit(width["rows"])) < 2 * SAMPLE)
    chosen = drawn.select("h", F.col("vector").cast("array<double>").alias("v")).orderBy("h", "v").limit(SAMPLE).select("v")
    rows = _unit(np.array([r["v"] for r in chosen.collect()]))
    draw = np.random.default_rng(7)
    centres = _means(rows, cells, rounds, draw)
    rest = rows - centres[_nearest(rows, centres)]
    slices = np.array_split(np.arange(width["n"]), min(parts, width["n"]))
    return {"centres": centres, "slices": slices, "books": [_means(rest[:, s], codes, rounds, draw) for s in slices]}


def _coded(shared, id_type: pa.DataType, id_col: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            rows = _unit(np.array(batch.column(1).flatten(), float).reshape(batch.num_rows, -1))
            cell = _nearest(rows, model["centres"])
            rest = rows - model["centres"][cell]
            code = np.empty((len(rows), len(model["slices"])), np.uint8)
            for i, (s, book) in enumerate(zip(model["slices"], model["books"], strict=True)):
                code[:, i] = _nearest(rest[:, s], book)
                rest[:, s] -= book[code[:, i]]
            radius = np.sqrt(((rows - model["centres"][cell]) ** 2).sum(1))
            error = np.sqrt((rest * rest).sum(1))
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(rows), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            columns = [batch.column(0).cast(id_type), batch.column(1), pa.array(cell.astype(np.int32)), codes, pa.array(radius), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "vector", "cell", "code", "radius", "error"])

    return run


def build(vectors: DataFrame, path: str, model: dict | None = None, id_col: str = "chunk_id", **options) -> dict | None:
    """Indexes every vector (id_col, vector) of the model's width under `path`: codes and
    vectors apart, in files by cell, and a row for each cell. Null and empty vectors and
    those of another width are left out."""
    model = model or fit(vectors, id_col=id_col, **options)
    if model is None:
        return None
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    shared = spark.sparkContext.broadcast(model)
    rows = vectors.select(id_col, F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == model["centres"].shape[1])
    name = kind.simpleString()
    coded = rows.mapInArrow(_coded(shared, to_arrow_type(kind), id_col), f"{id_col} {name}, vector array<double>, cell int, code binary, radius double, error double")
    piece = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(PARTS)).cast("int")
    # Rows of one cell go to as many tasks as there are parts, and lie in files by cell.
    coded = coded.withColumn("part", F.pmod("cell", F.lit(PARTS))).repartition("part", piece).sortWithinPartitions("part", "cell")
    coded.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).write.mode("overwrite").parquet(f"{path}/cells")
    return model


def _tables(model: dict, queries: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
    """For each slice, squared distances of the queries' residuals to its centroids."""
    out = []
    for s, book in zip(model["slices"], model["books"], strict=True):
        q = queries[:, s] - centre[s]
        out.append(np.maximum((q * q).sum(1)[:, None] + (book * book).sum(1) - 2 * q @ book.T, 0.0))
    return out


def _codes(codes: pa.Table) -> np.ndarray:
    """A row of code numbers for each row; codes are equally long."""
    width = len(codes["code"][0].as_py())
    return np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(codes), width)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(rows, -1)


def _probe(shared, k: int, id_col: str, names: pa.Schema):
    """The candidates of a piece of a cell for each of its queries, by distance of codes."""

    def run(key: tuple[pa.Scalar, ...], codes: pa.Table, asked: pa.Table) -> pa.Table:
        model, cell = shared.value, key[0].as_py()
        if not len(codes) or not len(asked):
            return names.empty_table()
        code = _codes(codes)
        queries = _matrix(asked["q"], len(asked))
        tables, found = _tables(model, queries, model["centres"][cell]), []
        for i in range(len(asked)):
            far = np.sqrt(sum(t[i][code[:, j]] for j, t in enumerate(tables)))
            rows = np.lexsort((np.arange(len(far)), far))[: CANDIDATES * k]
            found.append(pa.Table.from_arrays([asked["query_id"].take(pa.array(np.full(len(rows), i))), codes[id_col].take(pa.array(rows)), pa.array(np.full(len(rows), cell, np.int32)), pa.array(far[rows])], names.names))
        return pa.concat_tables(found).cast(names)

    return run


def _best_of_piece(shared, k: int, id_col: str, names: pa.Schema):
    """The k best rows of a piece of a cell for each of its queries, scored exactly where
    the code's error leaves a way. Queries come in blocks of SCORES pairs with the piece's
    rows, so that what is held doesn't depend on how many rows the codes let through."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        model, cell = shared.value, key[0].as_py()
        if not len(rows) or not len(asked):
            return names.empty_table()
        code, error = _codes(rows), rows["error"].to_numpy()
        ids, unit = rows[id_col].combine_chunks(), _unit(_matrix(rows["vector"], len(rows)))
        step, found = max(1, SCORES // len(rows)), []
        for at in range(0, len(asked), step):
            block = asked.slice(at, step)
            queries, bound = _matrix(block["q"], len(block)), block["far"].to_numpy()
            tables = _tables(model, queries, model["centres"][cell])
            valid = np.empty((len(rows), len(block)), bool)
            for i in range(len(block)):
                far = np.sqrt(sum(t[i][code[:, j]] for j, t in enumerate(tables)))
                valid[:, i] = far - error <= bound[i]
            scored = np.flatnonzero(valid.any(1))
            if len(scored):
                best = Best(len(block), k, ids.type)
                best.add(ids.take(pa.array(scored)), rounded(unit[scored] @ _unit(queries).T), valid[scored])
                found.append(pa.Table.from_batches([best.batch(block["query_id"].combine_chunks(), id_col)]).cast(names))
        return pa.concat_tables(found) if found else names.empty_table()

    return run


def search(spark: SparkSession, path: str, model: dict, queries: DataFrame, k: int = 20, probes: int = 8, exact: bool = False, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id_col, score, rank of queries (query_id, vector), as dense_topk: of the
    `probes` nearest cells, or of all rows with `exact`."""
    centres = model["centres"]
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where(F.size("q") == centres.shape[1])
    shared = spark.sparkContext.broadcast(model)

    def distances(batches):
        for batch in batches:
            q = _unit(np.array(batch.column(1).flatten(), float).reshape(batch.num_rows, -1))
            far = np.sqrt(np.maximum(((q * q).sum(1)[:, None] + (centres * centres).sum(1) - 2 * q @ centres.T), 0.0))
            as_list = lambda rows: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_list(q), as_list(far)], ["query_id", "q", "to"])

    asked = cut(asked.mapInArrow(distances, f"query_id {kind}, q array<double>, to array<double>"))
    # A row for each cell.
    cells = F.broadcast(spark.read.parquet(f"{path}/cells"))
    pairs = asked.select("query_id", "q", F.posexplode("to").alias("cell", "to")).join(cells, "cell")
    near = Window.partitionBy("query_id").orderBy("to", "cell")
    first = pairs.withColumn("i", F.row_number().over(near)).where(F.col("i") <= probes).withColumn("far", F.lit(0.0))
    hits = _score(spark, path, model, shared, first, k, False, id_col)
    if not exact:
        return hits
    # The k-th hit's score bounds the distance; a query with fewer hits has no bound.
    least = hits.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * (F.col("score") - SLACK), F.lit(0.0))).alias("far"))
    bounded = pairs.join(cut(least), "query_id", "left").na.fill(4.0, ["far"])
    reached = bounded.withColumn("far", F.col("far") + 1e-9).where(F.col("to") - F.col("radius") <= F.col("far"))
    return _score(spark, path, model, shared, reached, k, True, id_col)


def _score(spark: SparkSession, path: str, model: dict, shared, pairs: DataFrame, k: int, exact: bool, id_col: str) -> DataFrame:
    pairs = cut(pairs.select("query_id", "q", "cell", "far", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")))
    probed = [r[0] for r in pairs.select(F.pmod("cell", F.lit(PARTS)).alias("p")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(probed))
    pieces = F.broadcast(pairs.select(F.col("cell").alias("c"), F.col("pieces").alias("m")).distinct())  # a row for each cell
    piece = F.pmod(F.xxhash64(id_col), F.col("m")).cast("int").alias("piece")
    held = [id_col, "cell", "code", "error", "vector"] if exact else [id_col, "cell", "code"]
    codes = rows.join(pieces, F.col("cell") == F.col("c")).select(*held, piece)
    sent = pairs.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    q_kind, id_kind = pairs.schema["query_id"].dataType, rows.schema[id_col].dataType
    keys = [("query_id", to_arrow_type(q_kind)), (id_col, to_arrow_type(id_kind))]
    schema = f"query_id {q_kind.simpleString()}, {id_col} {id_kind.simpleString()}"
    met = codes.groupBy("cell", "piece").cogroup(sent.groupBy("cell", "piece"))
    if exact:
        names = pa.schema([*keys, ("score", pa.float64())])
        return ranked(met.applyInArrow(_best_of_piece(shared, k, id_col, names), f"{schema}, score double"), k, id_col)
    names = pa.schema([*keys, ("cell", pa.int32()), ("apart", pa.float64())])
    found = met.applyInArrow(_probe(shared, k, id_col, names), f"{schema}, cell int, apart double")
    order = Window.partitionBy("query_id").orderBy("apart", id_col)
    found = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= CANDIDATES * k)
    found = found.select("query_id", id_col, "cell")
    vectors = rows.select(id_col, "cell", "vector").join(found, ["cell", id_col]).join(pairs.select("query_id", "q").dropDuplicates(["query_id"]), "query_id")

    def products(batches):
        for batch in batches:
            a, b = (np.array(batch.column(i).flatten(), float).reshape(batch.num_rows, -1) for i in (2, 3))
            score = rounded((_unit(a) * _unit(b)).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", id_col, "score"])

    scored = vectors.select("query_id", id_col, "vector", "q").mapInArrow(products, f"query_id {q_kind.simpleString()}, {id_col} {id_kind.simpleString()}, score double")
    return ranked(scored, k, id_col)
