"""Ranking of texts: BM25 and a tf-idf kernel on character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.scratch import saved


#: Documents and queries of a cell, and meetings that are added up at once.
DOC_BLOCK, QUERY_BLOCK, MEETINGS = 4_096, 512, 1 << 20


def bm25(docs: DataFrame, queries: DataFrame, terms: Column, query_terms: Column, k1: float = 1.5, b: float = 0.75, top: int = 5, doc_block: int = DOC_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, doc_id, score, place: the ``top`` documents of each query.

    ``docs`` has doc_id, ``queries`` has query_id.  Only postings of the
    queries' terms are shuffled, and they are written once; the statistics are
    one partial aggregation.  Documents and queries are dealt to blocks, and each
    pair of blocks adds up its scores in a table of its own and passes on its best
    rows of a query only.  Ties go to the smaller doc_id.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(query_terms)).alias("term")).distinct()
    wanted = saved(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "query-terms")
    sized = docs.select("doc_id", terms.alias("terms"))
    stats = sized.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total"))
    postings = (
        sized.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        .join(wanted, "term")
        .groupBy("doc_id", "dl", "t")
        .agg(F.count("*").alias("f"))
    )
    postings = saved(postings, "postings")
    df = postings.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a row a term of the queries; as a table it is broadcast if it is small
    weighed = df.crossJoin(F.broadcast(stats)).select("t", idf.alias("idf"), (F.col("total") / F.col("n")).alias("avgdl"))
    weighed = saved(weighed, "term-weights")
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    asked = saved(asked.join(wanted, "term").select("query_id", "t"), "asked")
    blocks = [max(1, -(-n // size)) for n, size in ((docs.count(), doc_block), (asked.select("query_id").distinct().count(), query_block))]
    mine, theirs = (F.pmod(F.xxhash64(c), F.lit(n)).cast("long") for c, n in zip(("doc_id", "query_id"), blocks))
    across = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    kinds = [frame.schema[c].dataType for frame, c in ((docs, "doc_id"), (queries, "query_id"))]
    # sums of whole millionths don't depend on their order
    left = postings.join(weighed, "t").select(F.explode(F.transform(across(blocks[1]), lambda k: mine * blocks[1] + k)).alias("cell"), F.lit(False).alias("asks"), "doc_id", F.lit(None).cast(kinds[1]).alias("query_id"), "t", F.floor(part * 1e6 + 0.5).cast("long").alias("micro"))
    right = asked.select(F.explode(F.transform(across(blocks[0]), lambda k: k.cast("long") * blocks[1] + theirs)).alias("cell"), F.lit(True).alias("asks"), F.lit(None).cast(kinds[0]).alias("doc_id"), "query_id", "t", F.lit(0).cast("long").alias("micro"))

    def best(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        given, wants = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
        doc, query = (part.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for part, c in ((given, "doc_id"), (wants, "query_id")))
        at, who = doc.indices.to_numpy(), query.indices.to_numpy()
        place = np.empty(len(doc.dictionary), np.int64)
        place[pc.sort_indices(doc.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
        t, micro = given.column("t").to_numpy(), given.column("micro").to_numpy()
        order = np.argsort(wants.column("t").to_numpy(), kind="stable")
        t2, who = wants.column("t").to_numpy()[order], who[order]
        start = np.searchsorted(t2, t, "left")
        times = np.searchsorted(t2, t, "right") - start
        ends = np.cumsum(times)
        shape = len(query.dictionary), len(place)
        total, met = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1], bool)
        lo = 0
        while lo < len(t):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + MEETINGS, "right")))
            n = times[lo:hi]
            there = np.repeat(start[lo:hi] - (ends[lo:hi] - n), n) + np.arange(done, ends[hi - 1])
            spot = who[there].astype(np.int64) * shape[1] + np.repeat(place[at[lo:hi]], n)
            np.add.at(total, spot, np.repeat(micro[lo:hi], n))
            met[spot] = True
            lo = hi
        total, met = total.reshape(shape), met.reshape(shape)
        ids = doc.dictionary.take(pc.sort_indices(doc.dictionary, null_placement="at_start"))
        found = []
        for q in range(shape[0]):
            d = np.flatnonzero(met[q])
            found.append(d[np.argsort(-total[q, d], kind="stable")[:top]])
        q, d = np.repeat(np.arange(shape[0]), [len(x) for x in found]), np.concatenate([np.empty(0, np.int64), *found])
        return pa.table({"query_id": query.dictionary.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "micro": total[q, d]})

    scored = left.unionByName(right).groupBy("cell").applyInArrow(best, f"query_id {kinds[1].simpleString()}, doc_id {kinds[0].simpleString()}, micro bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("micro"), "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= top).select("query_id", "doc_id", (F.col("micro") / F.lit(1e6)).alias("score"), "place")


def tfidf_kernel(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, cos_pos, cos_neg, risk of each text against two classes of seeds.

    ``texts``: id, text; ``seeds``: id, text, positive.  idf counts the seeds,
    and for a text's own grams the text too; each class is the mean of its
    seeds' tf-idf vectors.  The seeds' table is small and fixed; texts are read
    once and their grams are aggregated by text, in the task that the text was sent to.
    """
    grams = T.char_ngrams(seeds, "id", F.col("text"))
    totals = grams.groupBy("id").agg(F.sum("c").alias("all"))
    n = seeds.agg(F.count("*").alias("n"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    idf = lambda seen: F.log((F.col("n") + 1 + seen) / (F.col("df") + 1 + seen)) + 1
    class_size = seeds.groupBy("positive").agg(F.count("*").alias("members"))
    centroid = (
        grams.join(totals, "id").join(df, "gram").crossJoin(F.broadcast(n)).join(seeds.select("id", "positive"), "id").join(class_size, "positive")
        .groupBy("gram", "positive")
        .agg(F.sum(F.col("c") / F.col("all") * idf(0) / F.col("members")).alias("v"))
        .groupBy("gram")
        .agg(F.coalesce(F.sum(F.when(F.col("positive"), F.col("v"))), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.when(~F.col("positive"), F.col("v"))), F.lit(0.0)).alias("neg"))
    )
    norms = centroid.agg(F.sqrt(F.sum(F.col("pos") * F.col("pos"))).alias("len_pos"), F.sqrt(F.sum(F.col("neg") * F.col("neg"))).alias("len_neg"))
    # a table of known size is broadcast if it is small, so grams of texts are not shuffled to meet it
    known = saved(df.join(centroid, "gram", "left"), "seed-grams")
    # texts go to their ids' tasks whole, and all that follows stays there: grams are never shuffled or sorted
    sizes = sum((F.greatest(F.length("text") - (n - 1), F.lit(0)) for n in (2, 3)), F.lit(0))
    placed = texts.select("id", "text").repartition("id").withColumn("all", F.sum(sizes).over(Window.partitionBy("id")))
    own = T.char_ngrams(placed, ["id", "all"], F.col("text"))
    weighed = (
        own.join(known, "gram", "left").na.fill(0, ["df"]).na.fill(0.0, ["pos", "neg"]).crossJoin(F.broadcast(n))
        .withColumn("v", F.col("c") / F.col("all") * idf(1))
    )
    dots = weighed.groupBy("id").agg(F.sum(F.col("v") * F.col("pos")).alias("dot_pos"), F.sum(F.col("v") * F.col("neg")).alias("dot_neg"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    cosine = lambda side: F.coalesce(F.try_divide(F.col(f"dot_{side}"), F.col("len") * F.col(f"len_{side}")), F.lit(0.0))
    found = texts.select("id").join(dots, "id", "left").crossJoin(F.broadcast(norms)).select("id", "len", cosine("pos").alias("cos_pos"), cosine("neg").alias("cos_neg"))
    risk = F.when(F.col("len").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + 2 * (F.col("cos_pos") - F.col("cos_neg")))))
    return found.select("id", "cos_pos", "cos_neg", risk.alias("risk"))
