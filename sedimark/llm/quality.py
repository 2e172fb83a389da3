"""Quality of documents: a text classifier, and sites by hierarchical empirical Bayes.

A logistic regression on counted text features and hashed words gives each document its own
evidence. Grouped sums of that evidence make posteriors of hosts and of paths below them, always
without the document itself; a path is shrunk to its host and a host to the whole corpus, the
more the fewer documents it has. How strong the pull is comes from how much hosts (and paths)
differ, by the method of moments; what a site weighs against a document's own text is fitted on
the labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_figures, map_rows, materialize
from .substring_dedup import word_hashes

#: Labelled documents that the models are fitted on at most: those with the least hash of their id.
LABELLED = 20_000
COUNTED = ["letters", "capitals", "digits", "spaces", "exclamations", "bars", "symbols", "beyond_ascii", "log_bytes", "word_bytes", "distinct_words", "distinct_lines", "longest_word"]
#: Places that words are hashed to.
HASHED = 256
#: Words of a text that are hashed at a time.
PIECE = 100_000
_LEAST, _MOST = 2.0, 10_000.0

_CLASS = np.full(256, 6, np.int64)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[33] = 4
_CLASS[124] = 5
_CLASS[128:] = 7
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 8


def features(text: str | None) -> np.ndarray:
    """COUNTED figures of the whole text, then the weight of each of HASHED places in its words (length 1); zeros for null and empty."""
    out = np.zeros(len(COUNTED) + HASHED, np.float32)
    data = (text or "").encode()
    n = len(data)
    if not n:
        return out
    share = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 9) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(words))
    out[: len(COUNTED)] = [*share[:8].tolist(), float(np.log1p(n)), n / m, len(set(words)) / m**0.9, len(set(lines)) / max(1, len(lines)), float(np.log1p(max(map(len, words), default=0)))]
    counts = np.zeros(HASHED)
    hashed = word_hashes().__getitem__
    for at in range(0, len(words), PIECE):
        some = words[at : at + PIECE]
        counts += np.bincount((np.fromiter(map(hashed, some), np.uint64, len(some)) % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)
    counts = np.sqrt(counts)
    out[len(COUNTED) :] = counts / max(1e-9, float(np.linalg.norm(counts)))
    return out


class Classifier:
    """Ridge logistic regression by Newton's method on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3e-2, rounds: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._standard(x)
        self.weights = np.zeros(z.shape[1])
        pull = ridge * len(x) * np.eye(z.shape[1]) / 10
        pull[0, 0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + pull, z.T @ (y - p) - pull @ self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._standard(x) @ self.weights, -13, 13)


def site_weight(text: np.ndarray, site: np.ndarray, y: np.ndarray) -> float:
    """Weight of the site's evidence beside that of the text, 0 to 1, by logistic regression with weights for both and a constant.

    text: logits of a classifier that didn't see the document. Without labels of both kinds or evidence that varies: 0.
    """
    if len(set(y.tolist())) < 2 or not site.std():
        return 0.0
    z = np.column_stack([np.ones(len(y)), text, site])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag([1e-6, 1e-3, 1.0]), z.T @ (y - p) - np.array([1e-6, 1e-3, 1.0]) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(np.clip(w[2] / w[1], 0, 1)) if w[1] > 0 else 0.0


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """Documents that the level above is worth: mean * (1 - mean) / variance between groups - 1, noise taken off."""
    rate = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("good").alias("good"),
        F.sum(F.col("n") * (rate - mean) ** 2).alias("between"), F.sum(F.col("within")).alias("within"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return _MOST
    mu = row["good"] / row["n"]
    noise = row["within"] / row["n"] * row["groups"] / row["n"]
    between = max(row["between"] / row["n"] - noise, 1e-9)
    return float(min(_MOST, max(_LEAST, mu * (1 - mu) / between - 1)))


def _labelled(named: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, text of at most LABELLED labelled documents with a text.

    An id with contradicting labels has none; of several texts of an id the one of the least hash counts.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = named.where(F.length(F.trim("text")) > 0).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Quality of documents: doc_id, p_text, p_host, p_path, score, kept (score >= 0.5), one row per input row.

    ``host`` and ``path`` name columns of the site (for web pages, host and first path segment).
    labels: doc_id and ``label`` (0 or 1; null is no label). p_host and p_path are posteriors of
    the site without the document itself, so a site of one document says what its parent says.
    Null, empty and white texts have p_text and score 0, are not kept and count for no site. A null
    host or path is a site of its own. Rows that repeat an id are scored each by its own text
    and count each for their site; an id with contradicting labels has no label. Without labels
    of both kinds the classifier says 1/2 of every text. A score of exactly 1/2 is kept. Texts
    of any length are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([features(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "y", "x"])

    sample = map_rows(_labelled(named, labels, label), {"doc_id": "doc_id", "y": "y", "text": "text"}, count, "doc_id bigint, y double, x binary", "words").toArrow()  # LABELLED rows of 1 KB
    ids = sample.column("doc_id").to_pylist()
    order = np.argsort(ids)
    y = np.array(sample.column("y").to_pylist())[order] if ids else np.zeros(0)
    x = np.array([np.frombuffer(b, np.float32) for b in sample.column("x").to_pylist()])[order] if ids else np.zeros((0, len(COUNTED) + HASHED), np.float32)
    model = Classifier(x, y) if len(set(y.tolist())) > 1 else None

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("text").to_pylist()
        blank = np.array([not (t or "").strip() for t in rows])
        p = 1 / (1 + np.exp(-model.logit(np.array([features(t) for t in rows])))) if model else np.full(len(rows), 0.5)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(blank), pa.array(np.where(blank, 0.0, p))], names=["doc_id", "host", "path", "blank", "p"])

    rated = materialize(map_rows(named, {c: c for c in named.columns}, judge, "doc_id bigint, host string, path string, blank boolean, p double", "words"))
    key = lambda *of: F.to_json(F.struct(*of), {"ignoreNullFields": "false"})  # noqa: E731  a null is a value of its own
    rated = rated.withColumn("at_host", key("host")).withColumn("at_path", key("host", "path"))

    sums = [F.sum("p").alias("good"), F.count("*").cast("double").alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("within")]
    paths = materialize(rated.where("not blank").groupBy("at_host", "at_path").agg(*sums))
    hosts = materialize(paths.groupBy("at_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("within").alias("within")))
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = whole["good"] / whole["n"] if whole["n"] else 0.5
    host_pull = _strength(hosts, F.lit(mean))
    posterior = hosts.select("at_host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), ((F.col("good") + host_pull * mean) / (F.col("n") + host_pull)).alias("p"))
    path_pull = _strength(paths.join(posterior, "at_host"), F.col("p"))

    out = join_figures(rated, hosts.select("at_host", F.col("good").alias("host_good"), F.col("n").alias("host_n")), "at_host", "host_n")
    out = join_figures(out, paths.select("at_path", F.col("good").alias("path_good"), F.col("n").alias("path_n")), "at_path", "path_n")
    own, one = F.when(F.col("blank"), 0.0).otherwise(F.col("p")), F.when(F.col("blank"), 0.0).otherwise(1.0)
    part = lambda c, less: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - less, F.lit(0.0))
    out = out.withColumn("p_host", (part("host_good", own) + host_pull * mean) / (part("host_n", one) + host_pull))
    out = out.withColumn("p_path", (part("path_good", own) + path_pull * F.col("p_host")) / (part("path_n", one) + path_pull))
    out = out.withColumn("site", _logit(F.col("p_path")) - _logit(F.lit(mean)))

    weight = 0.0
    if model:
        half = np.arange(len(y)) % 2 == 0  # each half is judged by a classifier of the other
        text_logit = np.zeros(len(y))
        for own_half in (half, ~half):
            text_logit[own_half] = Classifier(x[~own_half], y[~own_half]).logit(x[own_half]) if len(set(y[~own_half].tolist())) > 1 else 0.0
        wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in np.array(ids)[order]], "doc_id bigint"))
        sites = {r["doc_id"]: r["site"] for r in out.where("not blank").join(wanted, "doc_id").groupBy("doc_id").agg(F.avg("site").alias("site")).collect()}
        weight = site_weight(text_logit, np.array([sites.get(i, 0.0) for i in np.array(ids)[order].tolist()]), y)
    value = F.when(F.col("blank"), 0.0).otherwise(1 / (1 + F.exp(-(_logit(F.col("p")) + weight * F.col("site")))))
    return out.select("doc_id", F.col("p").alias("p_text"), "p_host", "p_path", value.alias("score"), (value >= 0.5).alias("kept"))
