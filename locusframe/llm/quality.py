"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for a whole Arrow batch with numpy over the joined bytes. Trees grow on binned
statistics (quantile bins, logistic loss, second-order gains) from a bounded sample of labelled rows, and
are flattened into arrays, so scoring moves all rows through all trees at once, level by level.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, utf8

#: Most labelled rows used for training: those with the smallest hash of their identifier.
MOST_LABELLED = 20_000
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3

#: Byte classes whose share of a text's bytes is a statistic.
_CLASSES: dict[str, bytes] = {
    "lower": bytes(range(0x61, 0x7B)),
    "upper": bytes(range(0x41, 0x5B)),
    "digit": bytes(range(0x30, 0x3A)),
    "space": b" \t\v\f\r",
    "newline": b"\n",
    "high": bytes(range(0x80, 0x100)),
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
    "stop": b".",
    "comma": b",",
    "mark": b"!?",
    "dollar": b"$",
    "percent": b"%",
    "and": b"&",
    "star": b"*",
    "hash": b"#",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "slash": b"/\\|",
    "dash": b"-_=~+",
    "other": b"@:;^",
}
STATISTICS = (
    *_CLASSES,
    "log_bytes",
    "log_words",
    "word_bytes",
    "distinct_words",
    "top_word",
    "upper_words",
    "long_words",
    "one_byte_words",
    "symbol_ends",
    "log_lines",
    "distinct_lines",
    "line_bytes",
    "squeezed",
    "repeated_marks",
)
_TABLE = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes)] = _k


def statistics(texts: Sequence[str | None]) -> np.ndarray:
    """A row of ``STATISTICS`` for each whole text; null counts as empty, and empty texts have all zeros."""
    n, k = len(texts), len(_CLASSES)
    out = np.zeros((n, len(STATISTICS)))
    at = {name: j for j, name in enumerate(STATISTICS)}
    for i, text in enumerate(texts):
        raw = utf8(text)
        if not raw:
            continue
        data = np.frombuffer(raw, np.uint8)
        counts = np.bincount(_TABLE[data] if len(raw) < 4096 else _TABLE.take(data), minlength=k)
        out[i, :k] = counts / len(raw)
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x]
        row = out[i]
        row[at["log_bytes"]] = np.log1p(len(raw))
        row[at["log_lines"]] = np.log1p(len(lines))
        row[at["line_bytes"]] = np.log1p(len(raw) / max(1, len(lines)))
        row[at["distinct_lines"]] = len(set(lines)) / max(1, len(lines))
        row[at["squeezed"]] = len(zlib.compress(raw, 1)) / len(raw)
        row[at["repeated_marks"]] = np.count_nonzero((data[1:] == data[:-1]) & (data[1:] < 0x30) & (data[1:] > 0x20)) / len(raw)
        if words:
            seen = Counter(words)
            m = len(words)
            row[at["log_words"]] = np.log1p(m)
            row[at["word_bytes"]] = (len(raw) - int(counts[3] + counts[4])) / m
            row[at["distinct_words"]] = len(seen) / m
            row[at["top_word"]] = max(seen.values()) / m
            upper = long = one = ends = 0
            for w, c in seen.items():
                upper += c * w.isupper()
                long += c * (len(w) > 20)
                one += c * (len(w) == 1)
                ends += c * (w[-1] in b"!$%&*#@^~")
            row[at["upper_words"]], row[at["long_words"]], row[at["one_byte_words"]], row[at["symbol_ends"]] = upper / m, long / m, one / m, ends / m
    return out


@dataclass(frozen=True)
class Trees:
    """A boosted ensemble in flat arrays; a leaf's children are itself, so all walks take ``depth`` steps."""

    prior: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        total = self.prior + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least_leaf: int = 5) -> Trees:
    """Boost ``rounds`` trees of at most ``depth`` levels; with no rows or one label there are no trees, only the prior."""
    n = len(y)
    mean = (float(y.sum()) + 1) / (n + 2)
    prior = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        width = bins
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        p = x.shape[1]
        flat = binned + np.arange(p) * width
        total = np.full(n, prior)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-total))
            g, h = q - y, q * (1 - q)
            roots.append(len(nodes))
            nodes.append([0, np.inf, 0, 0, 0.0])
            level = [(roots[-1], np.arange(n))]
            for d in range(depth + 1):
                following = []
                for node, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    nodes[node] = [0, np.inf, node, node, -rate * gs / (hs + l2)]
                    if d == depth or len(rows) < 2 * least_leaf:
                        continue
                    index = flat[rows].ravel()
                    sums = lambda w: np.bincount(index, np.repeat(w[rows], p), p * width).reshape(p, width)  # noqa: E731, B023
                    gl, hl = np.cumsum(sums(g), 1), np.cumsum(sums(h), 1)
                    cl = np.cumsum(np.bincount(index, minlength=p * width).reshape(p, width), 1)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(cl < least_leaf) | (len(rows) - cl < least_leaf)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                        continue
                    goes = binned[rows, f] <= b
                    a, c = len(nodes), len(nodes) + 1
                    nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, c, c, 0.0]]
                    nodes[node] = [f, edges[f][b], a, c, 0.0]
                    following += [(a, rows[goes]), (c, rows[~goes])]
                level = following
            table = np.array(nodes[roots[-1] :])
            at, base = np.zeros(n, np.int64), roots[-1]
            for _ in range(depth):
                feature, threshold = table[at, 0].astype(int), table[at, 1]
                at = np.where(x[np.arange(n), feature] <= threshold, table[at, 2], table[at, 3]).astype(int) - base
            total = total + table[at, 4]
    a = np.array(nodes).reshape(-1, 5)
    return Trees(prior, np.array(roots, np.int64), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], depth)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the fifth of the rows that is never learnt from: crc32 of the identifier as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Fit on the labelled rows that are not held out, at most ``most``: those with the smallest identifier hash.

    Null labels and identifiers are passed over; conflicting labels of one identifier count as their mean,
    rounded down; of an identifier's rows the one with the smallest text counts. The sample's statistics, ``most``
    short rows at most, go to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.floor(F.avg(label_col)).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = sample.groupBy(F.col("__id").cast("string").alias("__id")).agg(F.min("__text").alias("__text"), F.first("__y").alias("__y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sample.select("__id", "__text", "__y").mapInArrow(work, "id string, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted of every row; null and empty texts are scored as all-zero statistics.

    Equal texts get equal scores; repeated rows stay; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(c) for c in keep if c not in ("score", "predicted")])
    own = src.columns
    if text_col not in own:
        src = docs.select(*own, F.col(text_col).alias("__text"))
    at = text_col if text_col in own else "__text"
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by rounds and depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(statistics(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*own, "score", "predicted"])

    return src.mapInArrow(work, schema)
