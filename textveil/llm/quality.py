"""Quality classifier: document evidence combined with site and path posteriors by hierarchical empirical Bayes.

Evidence. A document's features are its words and punctuation runs (hashed) and steps of three shares: distinct words, words
equal to the one before, distinct lines. For each of two judgements, low quality and toxic, counts over labelled documents
(grouped sums over all their partitions) give each feature's log-odds; what counts is the lower confidence bound, of
features that are significantly more frequent in documents so judged. Copies and most near copies count once in the fit.

Sites. The mean posterior of a site (host) is shrunk to the global mean, that of a path to its site's, each with a prior strength
that the method of moments takes from the spread between groups: groups of few documents move little. The path's posterior
odds replace the global prior in each document's posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import SMALL_BATCHES, chunks, column, is_hot, positional, rows, text_bytes, written

#: At most about this many labelled documents are fitted on, chosen by a hash of their ids.
FIT_ROWS = 12_000
MIN_Z = 7.0
#: And a feature needs this share of the best feature's: words of a few near copies are no evidence.
BY_BEST = 0.2
#: A judgement needs this posterior.
REJECT = 0.8
HEADS = ("low", "toxic")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all texts; features of a row can repeat."""
    n = len(off) - 1
    h, start, end, row = scan.words(buf, off, scan.MARKED)
    word = scan.MARKED[buf[start]] == 1 if len(start) else np.zeros(0, bool)
    hw, rw = h[word], row[word]
    count = scan.row_counts(rw, n)
    same = np.zeros(len(hw), bool)
    same[1:] = (hw[1:] == hw[:-1]) & (rw[1:] == rw[:-1])
    again = np.bincount(rw, same, n) / np.maximum(count, 1)
    key = np.unique((rw.astype(np.uint64) << np.uint64(40)) | (hw >> np.uint64(24)))
    kinds = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(count, 1)
    line_class = np.ones(256, np.uint8)
    line_class[10] = 0
    hl, _, _, rl = scan.words(buf, off, line_class)
    key = np.unique((rl.astype(np.uint64) << np.uint64(40)) | (hl >> np.uint64(24)))
    lines = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(scan.row_counts(rl, n), 1)
    steps = np.stack((np.floor(10 * again), 20 + np.where(count >= 20, np.floor(10 * kinds), 10), 40 + np.floor(10 * lines)), 1).astype(np.int64).ravel()
    every = np.repeat(np.arange(n), 3)
    steps = scan.mixed((steps * 3 + np.tile(np.arange(3), n)).astype(np.uint64) + np.uint64(1 << 20))
    return np.concatenate((row, every)), np.concatenate((h, steps))


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


@dataclass
class Model:
    """features: hashes in order; weights: log-odds of each for both judgements; prior: log-odds of each judgement."""

    features: np.ndarray
    weights: np.ndarray
    prior: np.ndarray


def _keyed(seen: DataFrame) -> DataFrame:
    """Adds ``key``: the least hash of a text's runs of five words. Copies have equal keys, and most near copies too."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("low", pa.int32()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            buf, off = text_bytes(column(part, "text"))
            h, _, _, row = scan.words(buf, off)
            s, to = scan.shingles(h, row, part.num_rows)
            key = np.zeros(part.num_rows, np.uint64)
            full = to[:-1] < to[1:]
            key[full] = np.minimum.reduceat(s, to[:-1][full]) if full.any() else 0
            yield rows(schema, key=key.view(np.int64), **{c: column(part, c) for c in ("doc_id", "text", "low", "toxic")})

    typed = seen.select(F.col("doc_id").cast("long"), "text", F.col("low").cast("int"), F.col("toxic").cast("int"))
    return typed.mapInArrow(run, "key long, doc_id long, text string, low int, toxic int")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_z: float = MIN_Z) -> Model:
    """Labelled rows with a null id or judgement take no part; with no labelled rows, nothing is evidence."""
    told = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("toxic"))
    n = told.count()
    share = min(1.0, fit_rows / max(1, n))
    told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    seen = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")  # bounded by fit_rows
    schema = pa.schema([("feature", pa.int64()), *[(f"n{k}", pa.int64()) for k in range(4)]])
    one = F.min(F.struct("doc_id", "text", "low", "toxic")).alias("d")
    seen = _keyed(seen).groupBy("key").agg(one).select("d.text", "d.low", "d.toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            judged = 2 * column(part, "low").to_numpy().astype(np.int64) + column(part, "toxic").to_numpy().astype(np.int64)
            row, feature = _distinct(*features(*text_bytes(column(part, "text"))))
            used, which = np.unique(feature, return_inverse=True)
            n = np.bincount(which * 4 + judged[row], minlength=4 * len(used)).reshape(-1, 4)
            n = np.concatenate((np.bincount(judged, minlength=4)[None], n))  # feature 0: all documents
            yield rows(schema, feature=np.append(np.zeros(1, np.int64), used.view(np.int64)), **{f"n{k}": n[:, k] for k in range(4)})

    got = seen.mapInArrow(count, "feature long, n0 long, n1 long, n2 long, n3 long").groupBy("feature").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    got = got.where("feature = 0 OR n0 + n1 + n2 + n3 >= 8").toPandas()  # bounded by fit_rows documents' words
    got["feature"] = got.feature.astype("uint64") if len(got) else got.feature
    got = got.sort_values("feature")
    table = got[["n0", "n1", "n2", "n3"]].to_numpy(float).reshape(-1, 4)
    names = got.feature.to_numpy(np.uint64)
    whole, table, names = (table[0], table[1:], names[1:]) if len(names) else (np.zeros(4), table, names)
    weights, prior = np.zeros((len(names), 2)), np.zeros(2)
    for head, yes in enumerate(([2, 3], [1, 3])):
        no = [k for k in range(4) if k not in yes]
        a, b = table[:, yes].sum(1), table[:, no].sum(1)
        na, nb = whole[yes].sum(), whole[no].sum()
        prior[head] = np.log((na + 1) / (nb + 1))
        if na and nb and len(names):
            p = (a + b) / (na + nb)
            z = (a / na - b / nb) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / na + 1 / nb))
            odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1)) - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            weights[:, head] = np.where(z >= max(min_z, BY_BEST * z.max()), np.maximum(odds, 0), 0)
    live = weights.any(1)
    names, weights = names[live], weights[live]
    return Model(names, weights, prior)


def evidence(model: Model, text: Column) -> Column:
    """struct<low, toxic>: summed log-odds of a text's distinct features. A null text has none."""
    schema = pa.struct([(h, pa.float64()) for h in HEADS])
    maybe = np.zeros(1 << 16, bool)
    maybe[(model.features >> np.uint64(48)).astype(np.int64)] = True

    def run(series: pa.Array) -> pa.Array:
        out = []
        batch = pa.RecordBatch.from_arrays([series.combine_chunks() if isinstance(series, pa.ChunkedArray) else series], names=["text"])
        for part in chunks(iter([batch]), size=1 << 18):
            row, feature = features(*text_bytes(column(part, "text")))
            hit = maybe[(feature >> np.uint64(48)).astype(np.int64)]
            row, feature = _distinct(row[hit], feature[hit])
            at = np.minimum(np.searchsorted(model.features, feature), max(0, len(model.features) - 1))
            weight = model.weights[at] * (model.features[at] == feature)[:, None] if len(feature) else np.zeros((0, 2))
            score = np.stack([np.bincount(row, weight[:, k], part.num_rows) for k in range(2)], 1)
            out.append(score.astype(np.float64))  # bincount of nothing makes integers
        both = np.concatenate(out) if out else np.zeros((0, 2))
        return pa.StructArray.from_arrays([pa.array(both[:, k]) for k in range(2)], fields=list(schema))

    return F.arrow_udf(run, "struct<low:double,toxic:double>")(text)


def strength(groups: DataFrame, head: str, prior: Column) -> float:
    """Prior strength of group means by the method of moments.

    ``groups`` has n and s_<head>, a group's documents and their summed posteriors. The spread of the means around the prior,
    beyond what groups of their sizes show by chance, tells how far to trust them: no such spread, and groups count for nothing.
    """
    noise = prior * (1 - prior)
    got = groups.agg(F.sum(noise).alias("noise"), F.sum(F.col("n") * F.pow(F.col(f"s_{head}") / F.col("n") - prior, 2)).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    if not got.n:
        return 1.0
    beyond = max(0.0, got.spread - got.noise) / got.n
    return min(1e6, max(1.0, got.noise / got.groups / beyond if beyond else 1e6))


def posterior(head: str, prior: Column, weight: float) -> Column:
    return (F.col(f"s_{head}") + weight * prior) / (F.col("n") + weight)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _with_site(told: DataFrame, paths: DataFrame, total: int) -> DataFrame:
    """Adds the path's posteriors. Texts of large paths don't move: they are broadcast."""
    keys = ["__host", "__path"]
    told_of = paths.select(*keys, "n", *[f"path_{h}" for h in HEADS])
    hot, cold = told_of.where(is_hot(F.col("n"), total)).drop("n"), told_of.where(~is_hot(F.col("n"), total)).drop("n")
    out = told.join(F.broadcast(hot), keys)
    return out.unionByName(told.join(cold, keys)) if cold.limit(1).count() else out


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` with __low and __toxic (posteriors), __site_low, __site_toxic (its path's) and __keep.

    Null hosts and paths are groups of their own. Rows that repeat are judged each. A null or empty text has no evidence: its site
    decides. Without labels nothing is evidence and all stay. Input columns may have any names. An empty table gives an empty
    result. Evidence is taken of whole texts, one in memory at a time if it is long, and written once with its document.
    """
    model = fit(docs, labels, fit_rows)
    mine = positional(docs)
    names, at = mine.columns, {c: F.col(f"__c{k}") for k, c in enumerate(docs.columns)}
    group = lambda c: F.coalesce(at[c].cast("string"), F.lit("\0"))
    told = mine.withColumns({"__e": evidence(model, at["text"]), "__host": group(host), "__path": group(path)})
    told = written(told, "evidence", **SMALL_BATCHES)
    own = {h: sigmoid(F.col(f"__e.{h}") + F.lit(float(model.prior[k]))) for k, h in enumerate(HEADS)}
    sums = [F.sum(own[h]).alias(f"s_{h}") for h in HEADS]
    paths = written(told.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), *sums), "sites")
    whole = paths.agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS]).first()
    sites = paths.groupBy("__host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS])
    for h in HEADS:
        start = F.lit(whole[f"s_{h}"] / whole.n if whole.n else 0.5)
        sites = sites.withColumn(f"site_{h}", posterior(h, start, strength(sites, h, start)))
    paths = paths.join(sites.select("__host", *[f"site_{h}" for h in HEADS]), "__host")
    for h in HEADS:
        start = F.col(f"site_{h}")
        paths = paths.withColumn(f"path_{h}", posterior(h, start, strength(paths, h, start)))
    out = _with_site(told, paths, int(whole.n or 0))
    post = {h: sigmoid(F.col(f"__e.{h}") + logit(F.col(f"path_{h}"))) for h in HEADS}
    out = out.select(*names, *[post[h].alias(f"__{h}") for h in HEADS], *[F.col(f"path_{h}").alias(f"__site_{h}") for h in HEADS])
    out = out.withColumn("__keep", (F.col("__low") < REJECT) & (F.col("__toxic") < REJECT))
    return out.toDF(*docs.columns, *out.columns[len(names) :])


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, under their own columns."""
    mine = positional(docs, "doc_id", "text", options.get("host", "source"), options.get("path", "lang"))
    return judge(mine, labels, **options).where("__keep").select(*mine.columns).toDF(*docs.columns)
