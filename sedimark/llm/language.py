"""Language identification by fusion of evidence.

The log posterior of a language is the sum of

* the likelihood of the text under letter-pair models, a long text counting as ``PAIRS`` pairs,
* the likelihood of the declared (markup) language,
* the log prior of the site: soft counts of the languages of the other documents of the host,
  shrunk to those of its address suffix, and these to the corpus as a whole.

All tables behind these are grouped sums of the text posteriors over all documents. The declared
language is evidence and, unless other labels are given, what the letter-pair models are
fitted on: they learn what texts of a declaration look like as a rule, so one wrong
declaration still meets the evidence of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_figures, map_arrow, materialize, ship

#: Documents of a language that its letter-pair model is fitted on, if it has so many: those with the least hash of their id.
SAMPLE = 5_000
#: A language needs so many labelled documents, of all; more languages than MOST_LANGUAGES are an error.
LEAST_DOCS, MOST_LANGUAGES = 5, 200
#: Steps of the cut between hashes per power of two: a sample exceeds SAMPLE by a tenth or so.
STEPS = 8
PAIRS = 100
#: Documents that the level above counts as.
HOST_PULL, SUFFIX_PULL, VALUE_PULL = 20.0, 50.0, 5.0
PIECE = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(97, 123)]] = range(97, 123)
_FOLD[[*range(65, 91)]] = range(97, 123)
_FOLD[128:] = range(128, 256)
FOLD = _FOLD.tobytes()


def markup_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, in lower case; null without one."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    return F.when(found != "", F.lower(found))


def address_suffix(host: Column) -> Column:
    """Last label of a host with several, in lower case; null for others."""
    found = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def _pairs(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return b[:-1] * 256 + b[1:]


def _folded(text: str | None) -> bytes:
    return b" " + (text or "").encode().translate(FOLD) + b" "


def _place() -> Column:
    """How many STEPS of halving the hash of a row's id (of its text without one) is below the largest."""
    h = F.xxhash64("i", F.when(F.col("i").isNull(), F.col("text")))
    return F.floor(-F.log2((F.shiftrightunsigned(h, 1) + 1.0) / 2.0**63) * STEPS).cast("int")


def _limits(named: DataFrame) -> DataFrame:
    """Labels (k), how many rows have them (docs) and the place from which on rows make the sample (least)."""
    own = Window.partitionBy("k").orderBy(F.desc("z"))
    places = named.select("k", _place().alias("z")).groupBy("k", "z").agg(F.count("*").alias("n"))  # some hundred places a label
    return places.withColumn("before", F.sum("n").over(own) - F.col("n")).groupBy("k").agg(F.sum("n").alias("docs"), F.min(F.when(F.col("before") < SAMPLE, F.col("z"))).alias("least"))


def _sample(named: DataFrame, limits: DataFrame) -> DataFrame:
    """Per label the rows with the least hashes: all of them, or SAMPLE and those of the same place as the last."""
    return named.withColumn("z", _place()).join(F.broadcast(limits.select("k", "least")), "k").where("z >= least").select("k", "text")


def train(docs: DataFrame, text: str, label: str, doc_id: str) -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages, their log probabilities of the second byte of a pair given the first (65536 x languages), and the labels too rare for a model (k, docs)."""
    named = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").cast("string").alias("k"), F.col(f"`{text}`").alias("text")).where("k is not null")
    limits = materialize(_limits(named))
    limits, rare = limits.where(F.col("docs") >= LEAST_DOCS), limits.where(F.col("docs") < LEAST_DOCS).select("k", "docs")
    if limits.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels of {LEAST_DOCS} or more rows")
    sample = _sample(named, limits).repartition(max(8, limits.count()), "k", F.pmod(F.xxhash64("text"), F.lit(8)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _folded(t)
                at = totals.setdefault(k, np.zeros(65536, np.int64))
                for a in range(0, len(data), PIECE):
                    at += np.bincount(_pairs(data[a : a + PIECE + 1]), minlength=65536)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in totals.values()], pa.binary())], names=["k", "counts"])

    counts: dict[str, np.ndarray] = {}
    for r in map_arrow(sample, count, "k string, counts binary").collect():  # 8 rows of bounded size per language at most
        counts[r["k"]] = counts.get(r["k"], 0) + np.frombuffer(pa.decompress(r["counts"], decompressed_size=65536 * 8, codec="zstd", asbytes=True), np.int64)
    names = sorted(counts)
    if not names:
        return [], np.zeros((65536, 0), np.float32), rare
    table = []
    for k in names:
        c = counts[k].reshape(256, 256).astype(np.float64)
        c[32, 32] = 0
        second = (c.sum(0) + 0.5) / (c.sum() + 128)
        p = np.log((c + 20 * second) / (c.sum(1, keepdims=True) + 20))
        p[32, 32] = 0
        table.append(p.ravel())
    return names, np.array(table, np.float32).T.copy(), rare


def _scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods per text and language, and the pairs they are of."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    columns = [np.ascontiguousarray(table[:, k]) for k in range(table.shape[1])]
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        pairs = _pairs(b"".join(held))
        starts = np.cumsum([0, *map(len, held[:-1])])
        real = pairs != 32 * 256 + 32
        np.add.at(n, owners, np.add.reduceat(np.append(real, False).astype(np.int64), starts))
        for k, column in enumerate(columns):
            np.add.at(out[:, k], owners, np.add.reduceat(np.append(column[pairs], 0).astype(np.float64), starts))
        held.clear()
        owners.clear()

    for i, t in enumerate(texts):
        data = _folded(t)
        for a in range(0, len(data), PIECE):
            held.append(data[a : a + PIECE])
            owners.append(i)
            size += len(held[-1])
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return out, n


def identify(docs: DataFrame, declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, label: str | None = None, doc_id: str = "doc_id", text: str = "text", accept: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Languages of documents: doc_id, language, confidence, text_language, declared, kept, mark (xxhash64 of the text); one row per input row.

    declared, host, suffix name columns with the markup language, the host and the address
    suffix; without a suffix column the host's last label is it, and None for the others leaves
    that evidence out. Every ``label`` (by default the declared language) of at least LEAST_DOCS
    rows of the whole table has a letter-pair model, fitted on a sample of its own rows; more than
    MOST_LANGUAGES of them are an error. Rows whose label has fewer get language null, confidence 0 and are rejected, since
    there is nothing to know their language by. Other documents are kept if their text has letters, their language is in
    ``accept`` (by default any of the models') and its confidence at least ``threshold``. Of equally likely
    languages the first in alphabetical order is named. Texts without letters (null, empty) get
    language null, confidence 0 and are rejected; a text of any length is read whole. Null
    evidence says nothing. Rows that repeat an id are judged each by its own values and count
    each in the sums. Other columns are ignored; an empty table gives an empty result; without
    any label of enough rows, or with neither ``label`` nor ``declared``, all are rejected.
    """
    ship(docs.sparkSession)
    tag = label or declared
    names, table, rare = train(docs, text, tag, doc_id) if tag else ([], None, None)
    K = len(names)
    if not K:
        nothing = F.lit(None).cast("string")
        return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), nothing.alias("language"), F.lit(0.0).alias("confidence"), nothing.alias("text_language"), (F.lower(F.col(f"`{declared}`").cast("string")) if declared else nothing).alias("declared"), F.lit(False).alias("kept"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    column = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.lower(F.regexp_extract(column(declared), "^[A-Za-z]+", 0)).alias("declared"), column(host).alias("host"), (F.lower(column(suffix)) if suffix else address_suffix(column(host))).alias("suffix"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), column(tag).alias("tag"))
    rows = rows.withColumn("declared", F.when(F.col("declared") != "", F.col("declared")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ll, n = _scores(batch.column("text").to_pylist(), table)
                ll = ll * (np.minimum(n, PAIRS) / np.maximum(n, 1))[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("declared"), batch.column("host"), batch.column("suffix"), batch.column("mark"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(ll.tolist(), pa.list_(pa.float64()))], names=["doc_id", "declared", "host", "suffix", "mark", "tag", "pairs", "ll"])

    rated = map_arrow(rows, read, "doc_id bigint, declared string, host string, suffix string, mark bigint, tag string, pairs bigint, ll array<double>")
    top = F.array_max("ll")
    weights = F.transform("ll", lambda x: F.exp(x - top))
    rated = materialize(rated.withColumn("w", weights).withColumn("p", F.when(F.col("pairs") > 0, F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))).drop("w"))
    sums = lambda: [F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(K)]
    whole = rated.agg(*sums(), F.lit(1)).first()
    total = sum(whole[k] for k in range(K)) or 1.0
    prior = [(whole[k] + 1.0) / (total + K) for k in range(K)]
    languages = F.array(*[F.lit(x) for x in names])

    def figures(kind: str) -> DataFrame:
        """Per value of a column: soft counts of the languages and their sum, over all documents with letters."""
        seen = rated.where(F.col(kind).isNotNull() & F.col("p").isNotNull()).groupBy(kind).agg(*sums(), F.count("*").cast("double").alias(f"{kind}_n"))
        return materialize(seen.select(kind, F.array(*[F.col(f"s{k}") for k in range(K)]).alias(f"{kind}_s"), f"{kind}_n"))

    out = rated
    evidence = [F.col("ll")[k] for k in range(K)]
    if declared:  # P(value | language), shrunk to P(value)
        out = join_figures(out, figures("declared"), "declared", "declared_n")
        s, n = F.col("declared_s"), F.col("declared_n")
        evidence = [e + F.coalesce(F.log((s[k] + VALUE_PULL * n / total + 1e-3) / (prior[k] * total + VALUE_PULL)), F.lit(0.0)) for k, e in enumerate(evidence)]
    one = F.when(F.col("p").isNotNull(), 1.0).otherwise(0.0)
    site: list[Column] = [F.lit(x) for x in prior]
    for kind, used, pull in (("suffix", bool(suffix or host), SUFFIX_PULL), ("host", bool(host), HOST_PULL)):
        if used:  # without the document itself; a null value has what the level above says
            out = join_figures(out, figures(kind), kind, f"{kind}_n")
            others = lambda c, own: F.greatest(F.coalesce(c, F.lit(0.0)) - F.when(F.col(kind).isNull(), 0.0).otherwise(own), F.lit(0.0))  # noqa: B023, E731
            n = others(F.col(f"{kind}_n"), one)
            names_of = [f"{kind}_prior{k}" for k in range(K)]
            out = out.withColumns({c: (others(F.col(f"{kind}_s")[k], F.coalesce(F.col("p")[k], F.lit(0.0))) + pull * site[k]) / (n + pull) for k, c in enumerate(names_of)})
            site = [F.col(c) for c in names_of]
    evidence = [e + F.log(site[k]) for k, e in enumerate(evidence)]

    out = out.withColumn("e", F.array(*evidence)).withColumn("top", F.array_max("e"))
    best = lambda c: F.element_at(languages, F.array_position(c, F.array_max(c)).cast("int"))
    letters = F.col("pairs") > 0
    if not rare.isEmpty():
        out = join_figures(out, rare.select(F.col("k").alias("tag"), F.col("docs").alias("tag_docs")), "tag", "tag_docs")
        letters = letters & F.col("tag_docs").isNull()
    sure = F.when(letters, 1 / F.aggregate(F.transform("e", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    out = out.select("doc_id", F.when(letters, best(F.col("e"))).alias("language"), sure.alias("confidence"), F.when(letters, best(F.col("ll"))).alias("text_language"), "declared", "mark")
    fits = F.col("language").isin(accept) if accept is not None else F.col("language").isNotNull()
    return out.withColumn("kept", F.coalesce(fits & (F.col("confidence") >= threshold), F.lit(False))).select("doc_id", "language", "confidence", "text_language", "declared", "kept", "mark")
