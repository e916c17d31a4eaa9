"""Vector search: exact, filtered, by an inverted-file index, and late interaction.

Queries are a table. They go to the tasks in blocks of bounded size, of which the driver holds one at a time; a task scores its documents
against a block by one matrix product, keeps the best k for each query, and only those are shuffled."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import let
from ..functions.vectors import quantize
from ..sources.scratch import cut
from .ranking import small, top_k

#: Query vectors in a block: with 1,024 dimensions 32 MB.
BLOCK = 4096
DIGITS = 6


def _matrix(column, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of that many numbers, their vectors)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()])
    use = np.nonzero(lengths == dimension)[0]
    flat = lists.take(pa.array(use)).flatten()
    if flat.null_count:
        ok = ~np.array([any(x is None for x in v.as_py()) for v in lists.take(pa.array(use))])
        use = use[ok]
        flat = lists.take(pa.array(use)).flatten()
    return use, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(use), dimension)


def _score(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    product = docs @ queries.T
    if metric == "dot":
        return product
    d, q = (docs * docs).sum(1)[:, None], (queries * queries).sum(1)[None, :]
    if metric == "cosine":
        n = np.sqrt(d) * np.sqrt(q)
        return np.where(n > 0, product / np.where(n > 0, n, 1), 0.0)
    if metric == "int4":  # codes and, last, the scale
        n, scales = docs.shape[1] - 1, docs[:, -1:] * queries[:, -1]
        return docs[:, :-1] @ queries[:, :-1].T * scales / np.maximum(n * scales, 1.0)
    if metric == "euclidean":
        # differences, not the expanded square, which would lose digits for near vectors
        out = np.empty_like(product)
        for j, v in enumerate(queries):
            out[:, j] = 1 / (1 + np.sqrt(((docs - v) ** 2).sum(1)))
        return out
    raise ValueError(f"unknown metric {metric!r}")


def _grouped(rows: list) -> list[tuple[list, np.ndarray]]:
    """(ids, vectors) for each length of vector; vectors with null elements are no queries."""
    out: dict[int, tuple[list, list]] = {}
    for r in rows:
        if None not in r[1]:
            mine = out.setdefault(len(r[1]), ([], []))
            mine[0].append(r[0])
            mine[1].append(r[1])
    return [(ids, np.array(vs, np.float64)) for ids, vs in out.values()]


def _query_blocks(queries: DataFrame, id_: str, vector: str):
    """(groups, whether there are other blocks): the query set in blocks of about BLOCK rows, of which the driver holds one at a time. A set of
    more is written by block, so that each is read alone."""
    rows = queries.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    first = rows.limit(BLOCK + 1).collect()
    if len(first) <= BLOCK:
        yield _grouped(first), False
        return
    blocks = -(-rows.count() // BLOCK) * 2
    dealt = cut(rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), by="block")
    for block in range(blocks):
        held = []
        for r in dealt.filter(F.col("block") == block).select("id", "v").toLocalIterator():
            held.append(r)
            if len(held) == BLOCK:  # copies of a query may all lie in one block
                yield _grouped(held), True
                held = []
        if held:
            yield _grouped(held), True


def _over_blocks(queries: DataFrame, id_: str, vector: str, scan) -> DataFrame | None:
    """The rows of scan(groups as a broadcast) for all blocks of the queries. Those of several blocks are written one after the other, and
    what was sent for a block is dropped before the next."""
    found = None
    for groups, more in _query_blocks(queries, id_, vector):
        if not groups:
            continue
        sent = queries.sparkSession.sparkContext.broadcast(groups)
        part = scan(sent)
        if more:
            part = cut(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


class _Best:
    """The k best documents for each query so far; ties go to the smaller key."""

    def __init__(self, n: int, k: int):
        self.k, self.docs, self.scores = k, [[] for _ in range(n)], [[] for _ in range(n)]

    def add(self, j: int, keys, s: np.ndarray, min_score: float | None) -> None:
        ok = np.ones(len(s), bool) if min_score is None else s >= min_score
        if ok.sum() > self.k:  # ties with the k-th stay in, the key decides
            ok &= s >= np.partition(s[ok], -self.k)[-self.k]
        if (hit := np.nonzero(ok)[0]).size:
            self.docs[j].append(keys.take(pa.array(hit)).to_pylist())
            self.scores[j].append(s[hit])
            if sum(map(len, self.scores[j])) > 4 * self.k + 64:
                self.cut(j)

    def cut(self, j: int) -> tuple[list, np.ndarray]:
        score, docs = np.concatenate(self.scores[j] or [np.zeros(0)]), [x for part in self.docs[j] for x in part]
        order = sorted(range(len(docs)), key=lambda i: (-score[i], docs[i]))[: self.k]
        self.docs[j], self.scores[j] = [[docs[i] for i in order]], [score[order]]
        return self.docs[j][0], self.scores[j][0]


def knn(queries: DataFrame, docs: DataFrame, k: int = 10, metric: str = "cosine", min_score: float | None = None, query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", cells: tuple[str, np.ndarray, int] | None = None) -> DataFrame:
    """query, doc, score (rounded to 6 digits), rank of the k documents nearest to each query; ties go to the smaller doc.

    docs may be filtered beforehand, which is how a metadata filter is applied. Only vectors of a query's own length are
    compared; null vectors, vectors with null elements and null keys match nothing. Repeated keys are repeated results.
    A query key that occurs twice is one query for each vector, ranked together.
    metric: cosine (0 for zero vectors), dot, euclidean (1 / (1 + distance)).
    cells: (column, centres, number of cells a query looks into): a document is scored only for the queries that look into its cell."""
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    q_type, d_type = queries.schema[query].dataType, docs.schema[doc].dataType
    schema, kinds = f"query_id {q_type.simpleString()}, doc_id {d_type.simpleString()}, score double", (to_arrow_type(q_type), to_arrow_type(d_type))
    columns = [F.col(doc).alias("doc_id"), F.col(vector).alias("v")] + ([F.col(cells[0]).alias("cell")] if cells else [])
    slim = docs.filter(F.col(doc).isNotNull()).select(*columns)

    def scan(sent):
        part = slim
        if cells:
            probed = np.zeros(len(cells[1]), bool)
            for _, matrix in sent.value:
                if matrix.shape[1] == cells[1].shape[1]:
                    probed |= _probes(matrix, cells[1], cells[2]).any(0)
            part = slim.filter(F.col("cell").isin([int(c) for c in np.nonzero(probed)[0]]))

        def run(batches):
            groups = [g for g in sent.value if not cells or g[1].shape[1] == cells[1].shape[1]]
            best = [_Best(len(ids), k) for ids, _ in groups]
            looks = [_probes(matrix, cells[1], cells[2]) for _, matrix in groups] if cells else []
            for b in batches:
                for g, (ids, matrix) in enumerate(groups):
                    use, vectors = _matrix(b.column(1), matrix.shape[1])
                    keys = b.column(0).take(pa.array(use))
                    if cells:
                        cell = b.column(2).to_numpy(zero_copy_only=False)[use]
                        parts = [(np.nonzero(cell == c)[0], np.nonzero(looks[g][:, c])[0]) for c in np.unique(cell)]
                    else:
                        parts = [(np.arange(at, min(at + 8192, len(use))), np.arange(len(ids))) for at in range(0, len(use), 8192)]
                    for mine, asking in parts:
                        if not len(asking) or not len(mine):
                            continue
                        scores, names = np.round(_score(vectors[mine], matrix[asking], metric), DIGITS) + 0.0, keys.take(pa.array(mine))
                        for column, j in enumerate(asking):
                            best[g].add(j, names, scores[:, column], min_score)
            for (ids, _), held in zip(groups, best):
                for j, query_id in enumerate(ids):
                    docs_, scores = held.cut(j)
                    if docs_:
                        yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(docs_), kinds[0]), pa.array(docs_, kinds[1]), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

        return part.mapInArrow(run, schema)

    best = _over_blocks(queries, query, vector, scan)
    return top_k(best if best is not None else spark.createDataFrame([], schema), k)


def quantized_knn(queries: DataFrame, docs: DataFrame, k: int = 10, kind: str = "int8", query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """knn in quantized space, queries and documents alike: int8 by the cosine of the codes, int4 by the product of codes and scales (over
    their number, where that is above 1), binary by the share of equal signs. Ties go to the smaller key."""
    if kind == "int4":
        code = lambda v: let(quantize(v, 7), lambda q: F.concat(F.transform(q["codes"], lambda c: c.cast("double")), F.array(q["scale"])))
    elif kind == "int8":
        code = lambda v: F.transform(quantize(v, 127)["codes"], lambda c: c.cast("double"))
    elif kind == "binary":
        code = lambda v: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    coded = lambda df, key: df.select(key, F.when(F.size(vector) > 0, code(F.col(vector))).alias(vector))
    # for signs the cosine c gives the share of equal ones (c + 1) / 2
    least = min_score if kind != "binary" or min_score is None else 2 * min_score - 1
    found = knn(coded(queries, query), coded(docs, doc), k, "int4" if kind == "int4" else "cosine", least, query, doc, vector)
    return found if kind != "binary" else found.withColumn("score", F.round((F.col("score") + 1) / 2, DIGITS))


# inverted-file index -------------------------------------------------------------------------------------------------


def _probes(queries: np.ndarray, centres: np.ndarray, probe: int) -> np.ndarray:
    """Which cells each query looks into: those of its nearest centres."""
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probe]
    out = np.zeros((len(queries), len(centres)), bool)
    np.put_along_axis(out, order, True, axis=1)
    return out


def fit_cells(docs: DataFrame, cells: int = 16, vector: str = "embedding", sample_rows: int = 20_000, key: str = "doc_id", rounds: int = 15) -> np.ndarray:
    """Unit centres of spherical k-means over a bounded sample (at most sample_rows rows, those with the least key hash; of these
    the vectors of the commonest length). None without vectors."""
    rows = docs.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample_rows).select(vector).collect()
    x = [r[0] for r in rows if r[0] and None not in r[0]]
    lengths = [len(v) for v in x]
    most = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    x = np.array([v for v in x if len(v) == most], np.float64)
    x = x.reshape(len(x), most)
    if not len(x):
        return x
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=len(centres)) == 0
        centres = np.where(empty[:, None], centres, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12))
    return centres


def with_cells(docs: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every row of docs and its cell (the nearest centre; -1 without a vector of the centres' length). Written with
    partitionBy("cell"), a search reads only the cells it looks into."""
    sent = docs.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([*docs.schema.fields, StructField("cell", IntegerType())])
    at, names = docs.columns.index(vector), [*docs.columns, "cell"]

    def run(batches):
        for b in batches:
            use, vectors = _matrix(b.column(at), sent.value.shape[1])
            cell = np.full(b.num_rows, -1, np.int32)
            for k in range(0, len(use), 8192):
                cell[use[k : k + 8192]] = (vectors[k : k + 8192] @ sent.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names)

    return docs.mapInArrow(run, schema)


def fit_probe(indexed: DataFrame, centres: np.ndarray, k: int = 10, recall: float = 0.9, margin: float = 0.05, sample_rows: int = 256, doc: str = "doc_id", vector: str = "embedding", metric: str = "cosine") -> int:
    """The least number of cells a query must look into for a mean recall of recall + margin, measured: the k nearest other rows
    of at most sample_rows rows (those with the least salted key hash) are searched exactly, and the cells they lie in looked up.
    All cells if there is nothing to measure with."""
    rows = indexed.filter(F.col(doc).isNotNull() & (F.col("cell") >= 0))
    asked = rows.orderBy(F.xxhash64(doc, F.lit("probe")), doc).limit(sample_rows).select(F.col(doc).alias("query_id"), vector)
    asked = indexed.sparkSession.createDataFrame(asked.collect(), asked.schema)
    found = knn(asked, rows, k + 1, metric, doc=doc, vector=vector).filter("query_id <> doc_id")
    lying = rows.select(F.col(doc).alias("doc_id"), "cell").join(F.broadcast(found), "doc_id").select("query_id", "rank", "cell").collect()
    vectors = {r[0]: r[1] for r in asked.collect() if None not in r[1]}
    near: dict = {}
    for r in sorted(lying, key=lambda r: r["rank"]):
        near.setdefault(r.query_id, []).append(r.cell)
    if not near:
        return len(centres)
    place = np.argsort(np.argsort(-(np.array([vectors[q] for q in near], np.float64) @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.concatenate([place[i, cells[:k]] for i, cells in enumerate(near.values())])
    reached = np.cumsum(np.bincount(needed, minlength=len(centres))) / len(needed)
    return int(np.argmax(reached >= min(1.0, recall + margin) - 1e-12)) + 1


def knn_cells(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int = 10, probe: int | None = None, recall: float = 0.9, **options) -> DataFrame:
    """knn over the cells of each query's `probe` nearest centres (by default as many as fit_probe measures for the recall), scored exactly."""
    probe = probe or fit_probe(indexed, centres, k, recall, **{o: v for o, v in options.items() if o in ("doc", "vector", "metric")})
    return knn(queries, indexed.filter("cell >= 0"), k, cells=("cell", centres, probe), **options)


def cell_statistics(indexed: DataFrame) -> DataFrame:
    """cells, rows, least, most and mean rows of a cell."""
    per = indexed.filter("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("cells"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


class VectorIndex:
    """An inverted-file index kept in a folder all executors reach: rows by cell, the cells' centres, and keys removed since.

    build writes it once; open finds it again, in any session; search reads only the cells the queries look into; add and remove take
    effect at once (removed keys are a table of their own), and optimize writes the rows anew without the removed ones."""

    def __init__(self, spark: SparkSession, folder: str, version: str, centres: np.ndarray, probe: int, key: str, vector: str):
        self.spark, self.folder, self.version, self.centres, self.probe, self.key, self.vector = spark, folder, version, centres, probe, key, vector

    @classmethod
    def build(cls, docs: DataFrame, folder: str, key: str = "doc_id", vector: str = "embedding", cells: int | None = None, k: int = 10, recall: float = 0.9) -> VectorIndex:
        """Of all rows with a non-null key. cells: by default about the root of the number of rows, at most 4,096; a search looks into as
        many as fit_probe measures for the recall."""
        rows = docs.filter(F.col(key).isNotNull()).select(key, vector)
        cells = cells or int(min(4096, max(1, rows.count() ** 0.5)))
        centres = fit_cells(rows, cells, vector, key=key)
        index = cls(docs.sparkSession, folder, uuid.uuid4().hex, centres, len(centres), key, vector)
        if len(centres):
            with_cells(rows, centres, vector).write.partitionBy("cell").parquet(index._path("rows"))
            index.probe = fit_probe(index.rows(), centres, k, recall, doc=key, vector=vector)
        else:
            rows.withColumn("cell", F.lit(-1)).write.parquet(index._path("rows"))
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        """The newest version in the folder."""
        r = spark.read.parquet(f"{folder}/versions").orderBy(F.col("made").desc()).first()
        centres = np.array(r["centres"], np.float64).reshape(len(r["centres"]), -1)
        return cls(spark, folder, r["version"], centres, r["probe"], r["key"], r["vector"])

    def _path(self, what: str) -> str:
        return f"{self.folder}/{self.version}/{what}"

    def _save(self) -> None:
        row = [(self.version, [[float(x) for x in c] for c in self.centres], self.probe, self.key, self.vector)]
        made = self.spark.createDataFrame(row, "version string, centres array<array<double>>, probe int, key string, vector string")
        made.withColumn("made", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/versions")

    def _removed(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path("removed")).distinct()
        except AnalysisException:  # nothing was removed from this version
            return None

    def rows(self) -> DataFrame:
        """key, vector, cell of what is in the index."""
        rows = self.spark.read.parquet(self._path("rows"))
        gone = self._removed()
        return rows if gone is None else rows.join(small(gone), self.key, "left_anti")

    def add(self, docs: DataFrame) -> None:
        """Puts further rows in. A key that was removed before stays removed until optimize."""
        rows = docs.filter(F.col(self.key).isNotNull()).select(self.key, self.vector)
        with_cells(rows, self.centres, self.vector).write.mode("append").partitionBy("cell").parquet(self._path("rows"))

    def remove(self, keys: DataFrame) -> None:
        keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct().write.mode("append").parquet(self._path("removed"))

    def optimize(self) -> VectorIndex:
        """A new version of the rows that are left, with centres and probes fitted to them."""
        return VectorIndex.build(self.rows().drop("cell"), self.folder, self.key, self.vector)

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """knn over the cells that the queries look into, scored exactly."""
        if not len(self.centres):
            return knn(queries, self.rows(), k, doc=self.key, vector=self.vector, **options)
        return knn_cells(queries, self.rows(), self.centres, k, self.probe, doc=self.key, vector=self.vector, **options)

    def statistics(self) -> DataFrame:
        return cell_statistics(self.rows())


# late interaction ----------------------------------------------------------------------------------------------------


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, k: int = 10, min_score: float | None = None, metric: str = "cosine") -> DataFrame:
    """query_id, doc_id, score, rank: for each token of a query (query_id, pos, vec) the best similarity with a token of the
    document (doc_id, pos, vec), summed over the query's tokens. Documents without tokens, and queries without, don't appear
    (their score is 0). A task keeps, of its tokens, the best per document and query token, so a long document is reduced
    where it lies; the rest is an aggregation on (query_id, doc_id, pos)."""
    spark = doc_tokens.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    q_type, d_type = query_tokens.schema["query_id"].dataType, doc_tokens.schema["doc_id"].dataType
    schema, kinds = f"query_id {q_type.simpleString()}, qpos int, doc_id {d_type.simpleString()}, s double", (to_arrow_type(q_type), to_arrow_type(d_type))
    slim = doc_tokens.filter("doc_id is not null").select("doc_id", "vec")

    def scan(sent):
        def run(batches):
            groups = [(pa.array([i[0] for i in ids], kinds[0]), np.array([i[1] for i in ids], np.int32), matrix) for ids, matrix in sent.value]
            for b in batches:
                for ids, pos, matrix in groups:
                    use, vectors = _matrix(b.column(1), matrix.shape[1])
                    if not len(use):
                        continue
                    keys = b.column(0).take(pa.array(use)).dictionary_encode()
                    code, names = keys.indices.to_numpy(), keys.dictionary
                    order = np.argsort(code, kind="stable")
                    start = np.nonzero(np.concatenate([[True], np.diff(code[order]) != 0]))[0]
                    top = np.maximum.reduceat(_score(vectors[order], matrix, metric), start, axis=0)
                    docs_ = names.take(pa.array(code[order][start])).cast(kinds[1])
                    for at in range(0, len(pos), max(1, 200_000 // len(start))):  # query tokens, as many as make a batch
                        q = np.arange(at, min(at + max(1, 200_000 // len(start)), len(pos)))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(q, len(start)))), pa.array(np.repeat(pos[q], len(start))), docs_.take(pa.array(np.tile(np.arange(len(start)), len(q)))), pa.array(top[:, q].T.ravel())], ["query_id", "qpos", "doc_id", "s"])

        return slim.mapInArrow(run, schema)

    keyed = query_tokens.filter("query_id is not null").select(F.struct("query_id", "pos").alias("key"), F.col("vec"))
    best = _over_blocks(keyed, "key", "vec", scan)
    if best is None:
        best = spark.createDataFrame([], schema)
    per_token = best.groupBy("query_id", "doc_id", "qpos").agg(F.max("s").alias("s"))
    scored = per_token.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return top_k(scored, k, min_score=min_score)
