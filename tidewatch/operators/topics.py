"""Topic models, document clusters and word vectors, on Spark's own learners."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cache import materialize

#: Words in one block of a matrix of topics and words; documents for each part that word vectors are trained on.
WIDE, DOCS_A_PART = 1 << 15, 10_000


def count_vectors(tokens: DataFrame, min_df: float = 2, max_df: float = 0.9, size: int = 1 << 30, binary: bool = True) -> tuple[DataFrame, list[str]]:
    """tokens (doc_id, tokens) with `features`, and the words of its columns."""
    model = CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=size, binary=binary).fit(tokens)
    return model.transform(tokens), model.vocabulary


def tfidf_vectors(counted: DataFrame) -> DataFrame:
    return Normalizer(inputCol="raw", outputCol="tfidf").transform(IDF(inputCol="features", outputCol="raw").fit(counted).transform(counted))


def word_vectors(tokens: DataFrame, size: int = 100, window: int = 5, min_count: int = 10, rounds: int = 5, seed: int = 1) -> tuple[DataFrame, object]:
    """word, vec of a skip-gram model, and the model (save it to load it again; findSynonyms gives the nearest words). All documents
    are trained on, in parts beside each other whose vectors are averaged after each round; their number follows the documents'
    and not the cluster, so that the same table gives the same parts anywhere."""
    parts = max(1, -(-tokens.count() // DOCS_A_PART))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, numPartitions=parts, maxIter=rounds, seed=seed, inputCol="tokens", outputCol="vec").fit(tokens)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec")), model


def document_vectors(tokens: DataFrame, model) -> DataFrame:
    """doc_id, vec: the mean of a document's word vectors (in the place of a paragraph-vector model, which Spark lacks)."""
    return model.transform(tokens).select("doc_id", vector_to_array("vec").alias("vec"))


def lda_topics(counted: DataFrame, k: int = 10, rounds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mix of topics), (topic, word numbers and weights)."""
    model = LDA(k=k, maxIter=rounds, seed=seed, featuresCol="features").fit(counted)
    return model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("mix")), model.describeTopics(10)


def lsi_vectors(weighted: DataFrame, k: int = 10, column: str = "tfidf") -> DataFrame:
    """doc_id, vec: documents on the k strongest right singular vectors, scaled to length 1."""
    weighted = materialize(weighted.select("doc_id", column), "lsi")  # the solver passes over the rows again and again
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(weighted.select(column), column)).computeSVD(k)
    v = svd.V.toArray()  # words x k: bounded by the vocabulary's cap
    @F.udf("array<double>")
    def onto(x):
        y = x.values @ v[x.indices] if hasattr(x, "indices") else x.toArray() @ v
        n = np.linalg.norm(y)
        return (y / n if n else y).tolist()

    return weighted.select("doc_id", onto(column).alias("vec"))


def nmf(weighted: DataFrame, k: int = 10, rounds: int = 20, seed: int = 1, column: str = "tfidf") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, mix), topics x words: multiplicative updates. Each round sums two matrices over the documents; a document's own
    mix is solved where it lies. The sums of partitions are added up by blocks of words, so that the driver gets each once."""
    n_words = weighted.select(column).first()[0].size
    h = np.random.default_rng(seed).random((k, n_words)) + 0.1
    own = materialize(weighted.select("doc_id", _indices(column).alias("ix"), _values(column).alias("x")), "nmf")  # read each round
    cuts = list(range(0, n_words, WIDE))

    def mixes(pdf: pd.DataFrame, h: np.ndarray) -> np.ndarray:
        gram = h @ h.T
        w = np.full((len(pdf), len(h)), 1.0 / len(h))
        for i, (ix, x) in enumerate(zip(pdf["ix"], pdf["x"], strict=True)):
            top = h[:, ix] @ x
            for _ in range(10):
                w[i] *= top / np.maximum(gram @ w[i], 1e-12)
        return w

    form = pa.schema([("at", pa.int32()), ("s", pa.binary())])
    for _ in range(rounds):
        now = h

        def sums(batches, now=now):
            a, b = np.zeros(now.shape), np.zeros((len(now), len(now)))
            for batch in batches:
                pdf = batch.to_pandas()
                w = mixes(pdf, now)
                for i, (ix, x) in enumerate(zip(pdf["ix"], pdf["x"], strict=True)):
                    a[:, ix] += np.outer(w[i], x)
                b += w.T @ w
            yield pa.RecordBatch.from_pydict({"at": [-1, *cuts], "s": [b.tobytes(), *(a[:, c : c + WIDE].tobytes() for c in cuts)]}, form)

        def added(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in table["s"])
            return pa.table({"at": table["at"][:1], "s": [total.tobytes()]}, form)

        parts = own.mapInArrow(sums, "at int, s binary").groupBy("at").applyInArrow(added, "at int, s binary")
        a, b = np.zeros(h.shape), np.zeros((k, k))
        for r in materialize(parts, "nmf-sums").toLocalIterator():
            x = np.frombuffer(r.s).reshape(k, -1)
            if r.at < 0:
                b = x
            else:
                a[:, r.at : r.at + WIDE] = x
        h = h * a / np.maximum(b @ h, 1e-12)

    def final(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mix": list(mixes(pdf, h))})

    return own.mapInPandas(final, "doc_id long, mix array<double>"), h


def _indices(column: str):
    @F.udf("array<int>")
    def of(v):
        return [int(i) for i in (v.indices if hasattr(v, "indices") else range(v.size))]

    return of(column)


def _values(column: str):
    @F.udf("array<double>")
    def of(v):
        return [float(x) for x in (v.values if hasattr(v, "indices") else v.toArray())]

    return of(column)


def kmeans(vectors: DataFrame, k: int = 15, cosine: bool = False, seed: int = 1, column: str = "tfidf") -> DataFrame:
    """doc_id, cluster; cosine: spherical k-means, with centres of length 1."""
    model = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(vectors)
    return model.transform(vectors).select("doc_id", "cluster")


def as_ml(vectors: DataFrame, column: str = "vec") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("tfidf", array_to_vector(F.col(column).cast("array<double>")))


def strongest_dimension(vectors: DataFrame) -> DataFrame:
    """id, cluster: the first position of a vector's largest value."""
    return vectors.select("id", (F.array_position("vec", F.array_max("vec")) - 1).cast("int").alias("cluster"))


def most_similar(vectors: DataFrame, to: int, n: int = 10) -> DataFrame:
    """id, sim: the n vectors nearest in cosine to the one with this id (ties by id)."""
    from ..functions import arrays

    one = vectors.where(F.col("id") == to).select(F.col("vec").alias("v0"))
    sim = F.round(arrays.cosine(F.col("vec"), F.col("v0")), 9)
    return vectors.where(F.col("id") != to).crossJoin(F.broadcast(one)).select("id", sim.alias("sim")).orderBy(F.col("sim").desc(), "id").limit(n)


def top_terms(tokens: DataFrame, group: str, n: int = 20) -> DataFrame:
    """group, word, c, rank: each group's commonest words (ties by word)."""
    from pyspark.sql import Window

    count = tokens.select(group, F.explode("tokens").alias("word")).groupBy(group, "word").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("c").desc(), "word"))
    return count.withColumn("rank", rank).where(F.col("rank") <= n)


def linkage(means: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Weighted (WPGMA) merges by cosine distance of few rows: (a, b, distance, size), clusters numbered on."""
    n = len(means)
    u = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
    d = {(i, j): 1 - float(u[i] @ u[j]) for j in range(n) for i in range(j)}
    size, live, out = dict.fromkeys(range(n), 1), set(range(n)), []
    for new in range(n, 2 * n - 1):
        (a, b), far = min(((p, v) for p, v in d.items() if p[0] in live and p[1] in live), key=lambda x: (x[1], x[0]))
        live -= {a, b}
        size[new] = size[a] + size[b]
        out.append((a, b, far, size[new]))
        for o in live:
            d[o, new] = (d[min(a, o), max(a, o)] + d[min(b, o), max(b, o)]) / 2
        live.add(new)
    return out
