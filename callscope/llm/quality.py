"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is good or bad. Its potential is linear in figures of the line itself
and of its neighbours; a 2 x 2 table scores adjacent lines. Forward-backward gives
each line's marginal probability of being good; their mean weighted by line length
is the text's quality, which a logistic step fitted on the training texts turns
into the score.

Labels mark whole texts. In training all lines of a good text are good; in a bad
text a line starts out bad and, in a few rounds, is taken as bad where the field
of the last round finds it more likely bad, the worst line always.

The fit uses at most ``SAMPLE`` labelled texts of each class, chosen by a hash of
doc_id, whole and of at most ``CHAIN`` lines each, until a class has ``LINES`` lines.
Only their line figures reach the driver, 52 bytes a line. Scoring runs over all rows
and all lines without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import bounded, table, text_or_empty, windows

#: Bounds of the fit: labelled texts a class, lines of a text, lines a class.
SAMPLE, CHAIN, LINES = 1500, 1000, 50_000
THRESHOLD = 0.7
ROUNDS, STEPS, RATE, DECAY = 3, 80, 0.1, 1e-4
SYMBOLS = frozenset("#*$%&|<>{}[]^~\\=+@_/")
_NOT_LETTERS = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyz")
FIGURES = 12


def line_figures(text: str) -> tuple[list[tuple], list[int]]:
    """Figures and lengths of all lines of a whole text; an empty text is one empty line."""
    out, lengths, seen = [], [], set()
    for line in text.split("\n"):
        n = len(line)
        words = line.split()
        k = len(words)
        lengths.append(n + 1)
        if not k:
            out.append((1.0,) + (0.0,) * (FIGURES - 1))
            continue
        rest = line.lower().translate(_NOT_LETTERS)
        symbols = sum(map(rest.count, set(rest) & SYMBOLS))
        same = sum(a == b for a, b in zip(words, words[1:]))
        upper = sum(map(str.isupper, words))
        out.append(
            (
                0.0,
                np.log1p(k) / 5,
                min(n / k, 20) / 10,
                upper / k,
                sum(map(rest.count, set(rest) & {*"0123456789"})) / n,
                symbols / k,
                rest.count("!") / k,
                same / k,
                1 - len(set(words)) / k,
                float(line in seen),
                float(line[0].isupper()),
                float(line.rstrip()[-1] in ".!?"),
            )
        )
        seen.add(line)
    return out, lengths


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each line's figures beside those of the line before and after, zero beyond the text."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = 0
    after[last] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


def _step(message: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Log messages (docs, 2) times the link table."""
    return np.logaddexp(message[:, :1] + links[0], message[:, 1:] + links[1])


def marginals(potential: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once.

    ``potential``: per line the log potential of good (bad has 0). Returns the
    lines' probabilities of good and the expected counts of adjacent pairs.
    """
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    emit = np.zeros((len(potential), 2))
    emit[:, 1] = potential
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        rows = at[: int(np.count_nonzero(sizes > t))] + t
        forward[rows] = emit[rows] + (_step(forward[rows - 1], links) if t else 0)
    pairs = np.zeros((2, 2))
    for t in range(int(sizes[0]) - 2 if len(sizes) else -1, -1, -1):
        rows = at[: int(np.count_nonzero(sizes > t + 1))] + t
        ahead = emit[rows + 1] + backward[rows + 1]
        backward[rows] = _step(ahead, links.T)
        joint = forward[rows][:, :, None] + links + ahead[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


@dataclass
class Field:
    weights: np.ndarray
    links: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def quality(self, texts: list[str]) -> np.ndarray:
        """The length-weighted mean marginal of each text."""
        figures, lengths, sizes = [], [], []
        for text in texts:
            f, n = line_figures(text)
            figures += f
            lengths += n
            sizes.append(len(n))
        return self._quality(np.array(figures), np.array(lengths, float), np.array(sizes))

    def _quality(self, own: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        x = with_neighbours(own, ends - sizes, ends - 1)
        good, _ = marginals(x @ self.weights, sizes, self.links)
        return np.add.reduceat(good * lengths, ends - sizes) / np.add.reduceat(lengths, ends - sizes)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.quality(texts) + b)))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Field:
    """(label, line figures, line lengths) of each training text -> the fitted field.

    Without a text of both classes the field is neutral: every score is 0.5 or the
    one class's side.
    """
    rows = [r for r in rows if r[0] in (0, 1) and len(r[2])]
    width = 3 * FIGURES + 1
    if len({r[0] for r in rows}) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), (0.0, 0.0 if not rows else 4.0 * (rows[0][0] or -1)))
    labels = np.array([r[0] for r in rows])
    own, lengths = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    sizes = np.array([len(r[2]) for r in rows])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    x = with_neighbours(own, starts, ends - 1)
    text_of = np.repeat(np.arange(len(rows)), sizes)
    good_text = labels[text_of] == 1
    weight_of = np.where(good_text, len(own) / (2 * max(good_text.sum(), 1)), len(own) / (2 * max((~good_text).sum(), 1)))
    begins = np.zeros(len(own), bool)
    begins[starts] = True
    pair = np.flatnonzero(~begins)
    y = good_text.astype(float)
    theta = np.zeros(width + 4)
    for _ in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[pair - 1].astype(int), y[pair].astype(int)), 1)

        def gradient(theta, seen=seen, y=y):
            p, pairs = marginals(x @ theta[:width], sizes, theta[width:].reshape(2, 2))
            g = np.concatenate([x.T @ (weight_of * (y - p)), (seen - pairs).reshape(-1)]) / len(y)
            return g - DECAY * theta

        theta = _adam(gradient, theta, STEPS, RATE)
        field = Field(theta[:width], theta[width:].reshape(2, 2))
        p, _ = marginals(x @ field.weights, sizes, field.links)
        worst = np.minimum.reduceat(p, starts)[text_of]
        y = np.where(good_text, 1.0, ((p > 0.5) & (p > worst)).astype(float))
    q = field._quality(own, lengths.astype(float), sizes)

    def slope(ab):
        r = labels - 1 / (1 + np.exp(-(ab[0] * q + ab[1])))
        return np.array([(r * q).mean(), r.mean()]) - 1e-4 * ab

    field.scale = tuple(_adam(slope, np.zeros(2), 600, 0.2))
    return field


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_figures(t.as_py()) for t in batch["text"]]
        sizes = pa.array([len(n) for _, n in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["label"], batch["place"], sizes, pa.array([np.array(f, "<f4").tobytes() for f, _ in found], pa.binary()), pa.array([np.array(n, "<i4").tobytes() for _, n in found], pa.binary())], names=["label", "place", "n", "figures", "lengths"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chain: int = CHAIN, lines: int = LINES) -> Field:
    """Fit on labelled texts whose crc32(doc_id as text) mod 4 is not 2, of each class the first in order of a hash within the bounds."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    pick = lambda k: usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id").select("label", F.xxhash64("doc_id").alias("place"), "text")
    found = rows.transform(bounded).mapInArrow(_figures, "label int, place long, n long, figures binary, lengths binary").filter(F.col("n") <= chain)
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("place", "lengths", "figures").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = found.withColumn("upto", upto).filter(F.col("upto") <= lines).select("label", "figures", "lengths").collect()
    held = sorted((r.label, bytes(r.figures), bytes(r.lengths)) for r in held)
    return fit([(k, np.frombuffer(f, "<f4").reshape(-1, FIGURES).astype(float), np.frombuffer(n, "<i4")) for k, f, n in held])


def _scorer(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["__text"].to_pylist()
            scores = np.concatenate([field.score(texts[a:b]) for a, b in windows(texts, 1 << 19)]) if texts else np.zeros(0)
            rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([c for c, _ in rest] + [pa.array(scores, pa.float64())], names=[n for _, n in rest] + ["__score"])

    return run


def with_scores(docs: DataFrame, field: Field) -> DataFrame:
    """All columns and ``__score`` of the whole text; a null text is empty."""
    from pyspark.sql.types import DoubleType, StructType

    rows = docs.withColumn("__text", text_or_empty())
    return rows.transform(bounded).mapInArrow(_scorer(field), StructType([*docs.schema.fields]).add("__score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted; a row for each row.

    A null or empty text is one empty line and scores as such; a null doc_id is
    carried and its ``held_out`` is null; repeated rows give repeated rows; an
    empty table gives none; no usable labels give a neutral 0.5; further columns
    are ignored.
    """
    rows = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return rows.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, their columns unchanged."""
    return with_scores(docs, train(docs, labels)).filter(F.col("__score") >= threshold).drop("__score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the quality of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
