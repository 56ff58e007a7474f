"""Quality classifier: two views that teach each other, then score all documents together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import apart

#: Buckets into which the names of sources and languages are hashed.
NAME_BUCKETS = 64


def text_features(text: bytes) -> np.ndarray:
    """The content view of a whole text: shares of kinds of bytes, repetition, words and lines."""
    raw = np.frombuffer(text, dtype=np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    lower, upper, digit = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
    letters = max(1, lower + upper)
    marks = np.array([counts[list(s)].sum() for s in (b".,;:", b"!?", b"|<>{}[]()/\\", b"#$%&*@^~_=+", b"\"'`-")])
    same = raw[1:] == raw[:-1]
    odd = (raw[1:] < 65) & (raw[1:] > 32)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    return np.array([
        upper / letters, digit / size, counts[128:].sum() / size, *(marks / n_words), (same & odd).sum() / n_words,
        same.sum() / size, counts[32] / size, len(set(words)) / n_words, len(set(lines)) / n_lines,
        np.log1p(size / n_words), np.log1p(n_words / n_lines), np.log1p(n_words), np.log1p(len(raw)),
        float(not len(words))])


def page_features(lang: str | None, source: str | None, chars: float | None) -> np.ndarray:
    """The metadata view: source and language by hashed name, and the recorded length."""
    out = np.zeros(2 * NAME_BUCKETS + 3)
    out[_bucket(source)] = 1.0
    out[NAME_BUCKETS + _bucket(lang)] = 1.0
    chars = float("nan") if chars is None else chars
    known = chars == chars
    out[-3:] = (np.log1p(max(0.0, chars)) / 10 if known else 0.0, float(known and chars < 100), float(not known))
    return out


def _bucket(name: str | None) -> int:
    number = 0
    for byte in (name or "").encode():
        number = (number * 257 + byte + 1) % 1_000_003
    return number % NAME_BUCKETS


@dataclass
class Logistic:
    """A logistic regression on standardised features, calibrated by a line on held-out scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread = np.where(spread > 1e-9, spread, 1.0)
        z = np.clip((x - mean) / spread, -8, 8)
        z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
        return cls(mean, spread, _newton(z, y, ridge, steps))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows the fit did not see."""
        line = np.stack([self.raw(x), np.ones(len(x))], axis=1)
        self.slope, self.shift = map(float, _newton(line, y, 1.0, 25))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def _newton(z: np.ndarray, y: np.ndarray, ridge: float, steps: int, centre: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression that the ridge draws to ``centre``, or to zero."""
    centre = np.zeros(z.shape[1]) if centre is None else centre
    weights = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (p - y) + ridge * (weights - centre)
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights = weights - move
        if np.abs(move).max() < 1e-6:
            break
    return weights


@dataclass
class CoTrained:
    """Both views after their rounds, how they combine (weights of either logit and a shift), and the held-out accuracy."""

    text: Logistic
    page: Logistic
    mix: np.ndarray
    held_out: float
    rounds: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Probability of good quality: by both views, by the text alone, by the page alone."""
        views = np.stack([self.text.logit(text), self.page.logit(page)], axis=1)
        return _probability(np.concatenate([(views @ self.mix[:2] + self.mix[2])[:, None], views], axis=1))


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _surest(p: np.ndarray, right: np.ndarray, precise: float) -> float:
    """The least p such that held-out rows of at least that p are right often enough; above 1 if there is none.

    The share of right rows is taken as (right + 1) / (rows + 2), so a few lucky rows are not enough.
    """
    order = np.argsort(-p, kind="stable")
    share = (np.cumsum(right[order]) + 1) / (np.arange(len(p)) + 3)
    last = np.append(p[order][1:] < p[order][:-1], True)[:len(p)]  # equal scores stand or fall together
    good = np.flatnonzero(last & (share >= precise))
    return float(p[order][good[-1]]) if len(good) else 2.0


def _tells_apart(p: np.ndarray, fine: np.ndarray, least: float = 2.5) -> bool:
    """Whether scores rank good held-out rows above bad ones, by more than ``least`` standard errors of chance (rank sums)."""
    n, m = int(fine.sum()), int((~fine).sum())
    _, place, times = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    return bool(rank[fine].sum() - n * (n + m + 1) / 2 > least * np.sqrt(n * m * (n + m + 1) / 12))


def _combined(views: np.ndarray, y: np.ndarray, good: float, ridge: float = 1.0) -> np.ndarray:
    """Weights of both logits and a shift. They start from independent views, whose logits add up with the prior
    counted once, and rows move them from there."""
    line = np.concatenate([views, np.ones((len(views), 1))], axis=1)
    return _newton(line, y, ridge, 25, np.array([1.0, 1.0, -np.log(good / (1 - good))]))


def co_train(text: np.ndarray, page: np.ndarray, labels: np.ndarray, *, rounds: int = 3, share: float = 0.1,
             confident: float = 0.95) -> CoTrained:
    """Train both views on labelled rows (0 or 1) and on each other's confident guesses for the rest (-1).

    A third of the labelled rows is held out for calibration, for the combination and for how sure a view may
    be. Each round, either view labels up to ``share`` of the open rows for the other: its most certain
    ones, good and bad in the proportion of the labels, beyond the score from which held-out rows are
    right at a share of ``confident``. A view whose scores do not tell the held-out rows apart teaches nothing.
    ``held_out`` is the accuracy of combinations that are fitted to one half of the held-out rows and
    judged on the other.
    """
    labelled = np.flatnonzero(labels >= 0)
    held, seen = labelled[::3], np.setdiff1d(labelled, labelled[::3])
    open_ = np.flatnonzero(labels < 0)
    good = float(np.clip(labels[labelled].mean(), 1e-3, 1 - 1e-3))
    fine_held = labels[held] == 1
    views = {"text": text, "page": page}
    known = {name: labels.astype(float).copy() for name in views}
    taught = {name: seen for name in views}
    models: dict[str, Logistic] = {}
    history = []

    def fit_all() -> None:
        for name, x in views.items():
            models[name] = Logistic.fit(x[taught[name]], known[name][taught[name]])
            models[name].calibrate(x[held], labels[held].astype(float))

    fit_all()
    for _ in range(rounds):
        counts = []
        for name, other in (("text", "page"), ("page", "text")):
            rest = np.setdiff1d(open_, taught[other])
            p, sure = (_probability(models[name].logit(views[name][rows])) for rows in (rest, held))
            most = int(share * len(open_)) if _tells_apart(sure, fine_held) else 0
            order = np.argsort(p, kind="stable")
            bad = order[:int(most * (1 - good))]
            fine = order[::-1][:int(most * good)]
            bad = bad[1 - p[bad] >= _surest(1 - sure, ~fine_held, confident)]
            fine = fine[p[fine] >= _surest(sure, fine_held, confident)]
            known[other][rest[bad]], known[other][rest[fine]] = 0.0, 1.0
            taught[other] = np.concatenate([taught[other], rest[bad], rest[fine]])
            counts.append(len(bad) + len(fine))
        history.append(tuple(counts))
        fit_all()
    logits = np.stack([models["text"].logit(text[held]), models["page"].logit(page[held])], axis=1)
    y, half = labels[held].astype(float), np.arange(len(held)) % 2 == 0
    right = 0
    for part in (half, ~half):
        mix = _combined(logits[part], y[part], good)
        right += ((logits[~part] @ mix[:2] + mix[2] >= 0) == fine_held[~part]).sum()
    return CoTrained(models["text"], models["page"], _combined(logits, y, good), float(right / max(1, len(held))), history)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 12_000, max_open: int = 12_000,
        label_column: str = "quality") -> CoTrained | None:
    """Train on at most ``max_labelled`` labelled and ``max_open`` unlabelled documents, by id hash.

    Only their ids are sent to the executors and only their features to the driver, so both are bounded.
    Rows without an id or a label of 0 or 1 are not used. None where labels of either kind are missing.
    """
    named = labels.where(f"doc_id is not null and {label_column} in (0, 1)").groupBy("doc_id").agg(
        F.max(label_column).cast("int").alias("label"))
    known = docs.where("doc_id is not null").select("doc_id").join(named, "doc_id", "left")
    chosen = [known.where(part).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for part, most in (("label is not null", max_labelled), ("label is null", max_open))]
    picked = chosen[0].union(chosen[1]).withColumn("label", F.coalesce("label", F.lit(-1)))
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in text])

    # At most max_labelled + max_open ids go out. Rows of one id become one, the least, before they come back:
    # as many rows of a few numbers, as Arrow batches.
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", *inputs(docs))
    viewed = sample.select("doc_id", F.struct("label", features("body").alias("view"), "lang", "source", "chars").alias("row"))
    rows = viewed.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id")
    marks = rows["label"].to_numpy().astype(np.int64)
    if (marks == 0).sum() < 3 or (marks == 1).sum() < 3:
        return None
    order = np.random.default_rng(0).permutation(len(rows))
    view = rows["view"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[order]
    page = np.stack([page_features(*row) for row in zip(*(rows[name].to_pylist() for name in ("lang", "source", "chars")))])[order]
    return co_train(view, page, marks[order])


def inputs(docs: DataFrame) -> list[Column]:
    """What the views read: the text as bytes, and metadata where the table has it."""
    def of(name: str, kind: str) -> Column:
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)

    return [F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"), of("lang", "string").alias("lang"),
            of("source", "string").alias("source"), of("n_chars", "double").alias("chars")]


def quality(docs: DataFrame, model: CoTrained | None) -> Column:
    """A column (score, text_score, page_score) for the rows of ``docs``; 1 throughout without a model."""
    if model is None:
        return F.struct(*[F.lit(1.0).alias(name) for name in ("score", "text_score", "page_score")])
    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in ("score", "text_score", "page_score")])

    @F.pandas_udf(kind)
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, chars: pd.Series) -> pd.DataFrame:
        view = np.stack([text_features(t) for t in text]) if len(text) else np.zeros((0, len(model.text.mean)))
        page = (np.stack([page_features(*row) for row in zip(lang, source, chars.astype("float64"))])
                if len(text) else np.zeros((0, len(model.page.mean))))
        return pd.DataFrame(model.scores(view, page), columns=[f.name for f in kind.fields])

    return score(*inputs(docs))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """Score all documents by both calibrated views and say which to keep.

    Returns one row per input row: doc_id, score (probability of good quality), text_score, page_score, keep
    (score of ``threshold`` or more). A null or empty text is scored as one without words; null or missing
    metadata counts as a name of its own; repeated rows score alike; an empty table gives no rows; without
    labels of both kinds every document is kept with score 1; other columns are not read.
    """
    model = fit(docs, labels, **options)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), quality(docs, model).alias("q"))
            .select("doc_id", "q.*").withColumn("keep", F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, unchanged."""
    model = fit(docs, labels, **options)
    name = apart("_quality", docs.columns)
    return docs.select("*", quality(docs, model).alias(name)).where(F.col(name)["score"] >= threshold).drop(name)
