"""Toxicity by weak supervision.

Lexicon and pattern voters look at a text. A generative label model learns from their
agreement over all documents how accurate and how correlated they are, without labels;
its posterior then labels the rows that a linear classifier over single words and
patterns is fitted on. The lexicons are mined from labelled rows outside the held-out
fold; nothing else of a label, and no language, source or id, reaches a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import in_arrow, stage, table, texts_of

FOLDS = 5
#: Labelled rows, at most, that the lexicons are mined from.
LABELLED_ROWS = 40_000
#: Documents, about, that the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: Candidate words, and words of the lexicons, at most.
CANDIDATES, LEXICON = 2_000, 200
#: Voters that share out the mined words.
MINED_VOTERS = 8
#: Lengths of the word beginnings that count as lexicon entries too, written ``begin*``.
BEGINNINGS = (4, 5, 6, 7)
#: Share of toxic documents where there are no labels.
PRIOR = 0.05

# Words of abuse, by kind.
INSULTS = ("clown", "idiot", "loser", "moron", "scum", "trash")
CONTEMPT = ("disgusting", "pathetic", "stupid", "worthless")

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[!?]{2,}")
_AIMED = re.compile(r"\byou(?:'re| are)? (?:an? |such an? |all )?(\w+)")
PATTERNS = ("shouting", "punctuation runs", "aimed at a person", "two abusive words",
            "abusive words lie dense")


@dataclass
class Voters:
    """The words looked for, and which of them each lexicon voter holds."""

    words: list[str] = field(default_factory=list)
    groups: list[list[int]] = field(default_factory=list)

    @classmethod
    def of(cls, mined: list[str]) -> Voters:
        words = list(dict.fromkeys([*INSULTS, *CONTEMPT, *mined]))
        place = {w: k for k, w in enumerate(words)}
        groups = [[place[w] for w in INSULTS], [place[w] for w in CONTEMPT]]
        groups += [g for k in range(MINED_VOTERS)
                   if (g := [place[w] for w in mined[k::MINED_VOTERS]])]
        return cls(words, groups)

    @property
    def size(self) -> int:
        return len(self.words) + len(PATTERNS)

    def features(self, texts: list[str]) -> np.ndarray:
        """Rows of 0 and 1: which words and which patterns a text has."""
        place = {w: k for k, w in enumerate(self.words)}
        sizes = [n for n in BEGINNINGS if any(len(w) == n + 1 for w in place if w[-1] == "*")]
        known: dict[str, list[int]] = {}
        base = len(place)
        out = np.zeros((len(texts), base + len(PATTERNS)), np.float64)
        for row, text in zip(out, texts, strict=True):
            lower = text.lower()
            words = _WORD.findall(lower)
            abusive = set()
            for word in set(words):
                found = known.get(word)
                if found is None:
                    names = [word, *(word[:n] + "*" for n in sizes if len(word) > n)]
                    found = known[word] = [place[w] for w in names if w in place]
                if found:
                    row[found] = 1
                    abusive.add(word)
            if not text.islower():
                row[base] = 3 * sum(map(str.isupper, _WORD.findall(text))) > len(words) > 0
            row[base + 1] = bool(_RUN.search(text))
            row[base + 2] = "you" in lower and any(w in abusive for w in _AIMED.findall(lower))
            if abusive:
                row[base + 3] = len(abusive) > 1
                row[base + 4] = sum(w in abusive for w in words) * 100 > len(words)
        return out

    def votes(self, features: np.ndarray) -> np.ndarray:
        lexicon = [features[:, g].max(1) for g in self.groups]
        return np.column_stack([*lexicon, features[:, len(self.words):]])


@dataclass
class LabelModel:
    """Rates of each voter for either class, and how much of its own it has to say."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, n: float, both: np.ndarray, prior: float) -> LabelModel:
        """From ``both[i, j]``, the documents of ``n`` in which voters i and j both fire.

        Given the class, independent voters have covariances of rank one: their product
        of sensitivities. These are fitted over the pairs that agree with rank one; the
        pairs that do not are correlated, and share their weight.
        """
        mean = np.diag(both) / max(n, 1)
        cov = both / max(n, 1) - np.outer(mean, mean)
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-12
        m = len(mean)
        use = ~np.eye(m, dtype=bool)
        v = np.array([cls._sensitivity(cov, i) for i in range(m)])
        for cut in (0.3, 0.2, 0.2):
            residual = np.abs(cov - np.outer(v, v)) / scale
            use = ~np.eye(m, dtype=bool) & (residual <= cut)
            for _ in range(200):
                v = (0.5 * v + 0.5 * np.where(use, cov * v, 0).sum(1)
                     / (np.where(use, v * v, 0).sum(1) + 1e-12))
        residual = np.where(np.eye(m, dtype=bool), 0, (cov - np.outer(v, v)) / scale)
        weight = 1 / (1 + np.where(np.abs(residual) > 0.05, np.abs(residual), 0).sum(1))
        gap = v / np.sqrt(prior * (1 - prior))
        low, high = 1e-4, 1 - 1e-4
        on_toxic = np.clip(mean + (1 - prior) * gap, low, high)
        on_clean = np.clip(mean - prior * gap, low, high)
        return cls(prior, on_toxic, on_clean, weight)

    @staticmethod
    def _sensitivity(cov: np.ndarray, i: int) -> float:
        """From triplets of voters; those with a correlated pair give more, so a low quantile."""
        others = [j for j in range(len(cov)) if j != i]
        found = [np.sqrt(cov[i, j] * cov[i, k] / cov[j, k]) for j in others for k in others
                 if j < k and cov[i, j] > 0 and cov[i, k] > 0 and cov[j, k] > 0]
        return float(np.quantile(found, 0.4)) if found else 1e-9

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.on_toxic / self.on_clean) * self.weight
        silent = np.log((1 - self.on_toxic) / (1 - self.on_clean)) * self.weight
        logit = np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ silent
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Classifier:
    voters: Voters
    coefficients: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.judge(self.voters.features(texts))

    def judge(self, features: np.ndarray) -> np.ndarray:
        logit = features @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _mine(docs: DataFrame, labels: DataFrame) -> tuple[list[str], float | None]:
    """Words and word beginnings that mark toxic documents, and the share of toxic rows among the labelled.

    At most LABELLED_ROWS labelled rows, those of smallest id hash, all outside fold 0.
    An entry's support counts different smallest word hashes of its documents, so that a
    group of copies counts about once.
    """
    sample = (
        labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS))
    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not rows or not toxic or toxic == rows:
        return [], toxic / rows if toxic else None
    # LABELLED_ROWS bounds what is broadcast.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    hashed = known.select("toxic", words.alias("words"), F.array_min(
        F.transform(words, lambda w: F.xxhash64(w))).alias("sketch"))
    begun = F.flatten(F.transform("words", lambda w: F.array(w, *(
        F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS))))
    entries = F.explode(F.array_distinct(F.array_compact(begun))).alias("word")
    single = hashed.select("toxic", "sketch", entries).where("word <> ''")
    on, off = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    share = toxic / rows
    first = (
        single.groupBy("word").agg(on.alias("hit"), off.alias("miss"))
        .where((F.col("hit") >= 5) & (F.col("hit") * (1 - share) > 8 * share * F.col("miss")))
        .orderBy(F.desc("hit"), "word").limit(CANDIDATES))
    support = (
        single.join(F.broadcast(first.select("word")), "word").groupBy("word").agg(
            F.count_distinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("hit"),
            F.count_distinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("miss")))
    least = max(5.0, 0.02 * toxic)
    best = (
        support.where((F.col("hit") >= least)
                      & (F.col("hit") * (1 - share) > 8 * share * F.col("miss")))
        .orderBy(F.desc("hit"), "word").limit(LEXICON))
    return [r.word for r in best.select("word").collect()], share


def featured(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, bits): features of every row, staged, eight to a byte; texts are read once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def convert(batch):
            bits = np.packbits(voters.features(texts_of(batch)).astype(bool), axis=1)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b.tobytes() for b in bits], pa.binary())],
                ["doc_id", "bits"])
        return convert

    return stage(in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, bits binary"),
                 "toxicity-features")


def _unpacked(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Rows of 0 and 1 of a batch of ``featured``."""
    packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8)
    return np.unpackbits(packed.reshape(batch.num_rows, -1), axis=1)[:, :size].astype(np.float64)


def _agreement(rows: DataFrame, voters: Voters) -> tuple[float, np.ndarray]:
    """Number of documents and how many of them each pair of voters fires on, over all."""
    size = len(voters.groups) + len(PATTERNS)

    def make():
        def convert(batch):
            votes = voters.votes(_unpacked(batch, voters.size))
            sums = np.r_[len(votes), (votes.T @ votes).ravel()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "n"])
        return convert

    counted = in_arrow(rows.select("bits"), make, "place bigint, n double")
    sums = {r.place: r.n for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    flat = np.array([sums.get(k, 0.0) for k in range(1 + size * size)])
    return flat[0], flat[1:].reshape(size, size)


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Mine lexicons, fit the label model over all documents, then the classifier."""
    return fit_featured(docs, labels)[0]


def fit_featured(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    """:func:`fit`, and the features of ``docs`` it came from, for ``scores_of``."""
    mined, share = _mine(docs, labels)
    voters = Voters.of(mined)
    rows = featured(docs, voters)
    prior = min(max(share or PRIOR, 0.001), 0.999)
    return _fitted(rows, voters, prior), rows


def _fitted(documents: DataFrame, voters: Voters, prior: float) -> Classifier:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n, both = _agreement(documents, voters)
    model = LabelModel.fit(n, both, prior)

    def make():
        def convert(batch):
            features = _unpacked(batch, voters.size)
            share = model.posterior(voters.votes(features))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(features), pa.list_(pa.float64())), pa.array(share)],
                ["features", "share"])
        return convert

    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(
        (1 << 20) * min(1.0, SAMPLE_ROWS / max(n, 1)) + 1)
    held = fold(F.col("doc_id"))
    rows = in_arrow(documents.where(some & (held != 0)).select("bits"), make,
                    "features array<double>, share double")
    rows = rows.select(array_to_vector("features").alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("share").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("share")).alias("weight")))).alias("x"))
    rows = rows.select("features", "x.label", "x.weight").where("weight > 0")
    if rows.isEmpty():
        return Classifier(voters, np.zeros(voters.size), float(np.log(prior / (1 - prior))))
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50,
                                standardization=False).fit(rows)
    return Classifier(voters, fitted.coefficients.toArray(), float(fitted.intercept))


def toxicity_scores(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) of each whole text; NULL and empty texts are scored as having no words.

    Every row keeps its own row, repeated rows get equal scores, other columns are ignored.
    """
    return scores_of(featured(docs, classifier.voters), classifier)


def scores_of(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """:func:`toxicity_scores` of rows whose features are known."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def convert(batch):
            features = _unpacked(batch, classifier.voters.size)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(classifier.judge(features))],
                ["doc_id", "score"])
        return convert

    return in_arrow(rows, make, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The documents of a score under 0.5, all columns unchanged and nothing shuffled."""
    def make():
        return lambda batch: batch.filter(pa.array(classifier.scores(texts_of(batch)) < 0.5))

    return in_arrow(docs, make, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    classifier, rows = fit_featured(docs, table(spark, sf_dir, "labels"))
    scored = scores_of(rows, classifier)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
