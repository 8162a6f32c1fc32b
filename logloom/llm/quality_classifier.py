"""Quality classifier: document evidence with host- and path-level posteriors by hierarchical empirical Bayes.

A logistic model over counts of words, characters and lines gives each document its evidence; it is fitted on a
bounded sample of labelled documents. Hosts and their paths get the mean of it over all their documents, shrunk:
a host toward the global mean, a path toward its host, each with a weight (in documents) estimated from the
spread between hosts or paths. A document's posterior log odds are its own plus ``site_weight`` times what its
path's log odds differ from the global ones, where the sums of path and host leave the document itself out: its
evidence counts once. Grouped sums are the only thing gathered, pre-aggregated by task.

Cases: null or empty text has the evidence of zero counts; a null host or path is a group of its own; the only
document of a path has its host's posterior, the only one of a host the global one; repeated labels count as one
document with their lowest quality; equal rows get equal results; without labels of both kinds nothing is rejected;
an empty table gives an empty result. Other columns pass through, but for those named like a result, which give way
to it (with ``into`` the results are one struct of that name, and every column stays). A host of a third of all
documents is summed up by task first, and dealt over many tasks if sites are joined by a shuffle.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import tables
from logloom.llm import textblocks as tb


@dataclasses.dataclass(frozen=True)
class Settings:
    #: The model is fitted on so many labelled documents at most, those of lowest hash.
    sample: int = 20_000
    site_weight: float = 0.5
    #: Documents with a higher posterior of being poor are rejected.
    reject_above: float = 0.5
    ridge: float = 1.0


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWERCASE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL, _SHOUT, _BAR = _table("0123456789"), _table("#*$%&<>={}\\^~@"), _table("!?"), _table("|")
FEATURES = 12


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    words = tb.Words(*tb.flat(column))
    data, at = words.data, words.at
    n = words.counts()
    per_word = np.maximum(n, 1)
    chars = np.maximum(words.chars(), 1)
    text = np.repeat(np.arange(len(n)), n)
    n_codes = int(words.codes.max(initial=0)) + 1
    pairs = np.sort(text * n_codes + words.codes)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    unique = np.bincount(pairs[fresh] // n_codes, minlength=len(n))
    again = np.zeros(len(words.codes), bool)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (text[1:] == text[:-1])
    shares = [tb.per_text(t[data], at) / chars for t in (_UPPER, _DIGIT, _SYMBOL, _SHOUT, _BAR)]
    shares[0] = tb.per_text(_UPPER[data], at) / np.maximum(tb.per_text(_UPPER[data] | _LOWERCASE[data], at), 1)
    lines = tb.per_text(data == 10, at) + 1
    dup_lines = tb.repeated_lines(data, at, words.inside)
    repeat = tb.repeated_words(words.codes, words.first, 5) / per_word
    out = [*shares, tb.per_text(again, words.first) / per_word, repeat, unique / per_word, dup_lines / lines, np.log1p(n) / 10, chars / per_word / 10, (n < 10).astype(float)]
    return np.stack(out, axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model (the last one: intercept) by Newton steps; features are scaled inside."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    coef = w[:-1] / scale
    return np.append(coef, w[-1] - coef @ mean)


def document_model(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str) -> np.ndarray | None:
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64(id_col), id_col).limit(settings.sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "quality")  # ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.blocks(batch, 0):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64())), part.column(1)], ["x", "quality"])

    got = rows.mapInArrow(run, "x array<double>, quality int").toArrow()
    y = (got["quality"].to_numpy() == 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # the sum's order doesn't follow the tasks'
    return fit(x[order], y[order], settings.ridge)


def evidence(docs: DataFrame, model: np.ndarray, text_col: str, keep: list[str], into: str = "evidence") -> DataFrame:
    """The named columns and ``evidence``, the log odds of being poor."""
    own = model.tolist()

    def made(texts: pa.Array) -> list[pa.Array]:
        w = np.array(own)
        return [pa.array(np.clip(features(texts) @ w[:-1] + w[-1], -20, 20))]

    return tables.extended(docs, text_col, keep, [T.StructField(into, T.DoubleType())], made)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclasses.dataclass
class Priors:
    """The global share of poor documents, and the weights, in documents, of the global mean in a host and of a host in its path."""

    mean: float
    of_host: float
    of_path: float

    def path_odds(self, n: Column, s: Column, host_n: Column, host_s: Column) -> Column:
        host = (host_s + self.of_host * self.mean) / (host_n + self.of_host)
        return _odds((s + self.of_path * host) / (n + self.of_path))

    @property
    def base(self) -> float:
        return float(np.log(self.mean / (1 - self.mean)))


def poor(evidence_: Column) -> Column:
    return 1 / (1 + F.exp(-evidence_))


def site_sums(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """host, path, n, s (documents and summed chances of being poor), host_n, host_s of all paths; and the priors. scored: host, path, evidence."""
    p = poor(F.col("evidence"))
    paths = tables.written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    both = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n:
        return both, Priors(0.5, 1.0, 1.0)
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6)

    def prior_weight(groups: DataFrame, share: Column, around: Column, size: Column) -> float:
        """Beta prior's weight in documents, by moments: spread between groups beyond what their sizes explain."""
        spread, noise = groups.agg(F.sum(size * (share - around) ** 2) / F.sum(size), F.sum(around * (1 - around)) / F.sum(size)).first()
        between = max((spread or 0.0) - (noise or 0.0), 1e-6)
        return max(mean * (1 - mean) / between - 1, 1.0)

    a = prior_weight(hosts, F.col("host_s") / F.col("host_n"), F.lit(mean), F.col("host_n"))
    b = prior_weight(both, F.col("s") / F.col("n"), F.col("host_s") / F.col("host_n"), F.col("n"))
    return both, Priors(mean, a, b)


def _key(column: Column) -> Column:
    """A string that is never null, another one for each value and for null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """The named columns (all by default), with host, path, evidence, score (posterior of being poor) and kept, or a struct of them."""
    names = [into] if into else ["host", "path", "evidence", "score", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    kept = [F.col(f"`{c}`") for c in keep]
    model = document_model(docs, labels, settings, id_col, text_col)
    at, own = tables.fresh(docs, "site"), tables.fresh(docs, "evidence")
    sited = docs.withColumn(at, F.struct(host.cast("string").alias("host"), path.cast("string").alias("path")))

    def results(frame: DataFrame, evidence_: Column, score: Column, take: Column) -> DataFrame:
        out = [F.col(at)["host"].alias("host"), F.col(at)["path"].alias("path"), evidence_.alias("evidence"), score.alias("score"), take.alias("kept")]
        return frame.select(*kept, *([F.struct(*out).alias(into)] if into else out))

    if model is None:
        return results(sited, F.lit(0.0), F.lit(0.0), F.lit(True))
    scored = evidence(sited, model, text_col, [*keep, at], own)
    if text_col in keep:  # texts are read twice rather than written
        narrow = evidence(sited, model, text_col, [at], own)
    else:
        narrow = scored = tables.written(scored, "quality-evidence")
    sums, priors = site_sums(narrow.select(F.col(at)["host"].alias("host"), F.col(at)["path"].alias("path"), F.col(own).alias("evidence")))
    keys = [tables.fresh(scored, "host"), tables.fresh(scored, "path")]
    s_col = tables.fresh(scored, "sums")
    sums = tables.written(sums.select(_key(F.col("host")).alias(keys[0]), _key(F.col("path")).alias(keys[1]), F.struct("n", "s", "host_n", "host_s").alias(s_col)), "quality-sites")
    keyed = scored.withColumn(keys[0], _key(F.col(at)["host"])).withColumn(keys[1], _key(F.col(at)["path"]))
    if sums.count() <= tables.BROADCAST_ROWS:
        found = keyed.join(F.broadcast(sums), keys, "left")
    else:
        found = tables.salted_join(keyed, sums, keys, hot=sums.where(F.col(s_col)["n"] > 1_000))
    p, of = poor(F.col(own)), F.col(s_col)
    without = lambda total: F.greatest(total - p, F.lit(0.0))
    odds = F.col(own) + settings.site_weight * (priors.path_odds(of["n"] - 1, without(of["s"]), of["host_n"] - 1, without(of["host_s"])) - priors.base)
    score = 1 / (1 + F.exp(-odds))
    return results(found, F.col(own), score, score <= settings.reject_above)
