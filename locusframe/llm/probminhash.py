"""MinHash near-duplicates by ProbMinHash.

A document's shingles (five words) are weighted by how often they occur. Where no shingle recurs, the
similarity is the Jaccard similarity of the shingle sets. Every shingle is a Poisson process
whose rate is its weight: exponential arrivals, each at a random signature component; a component keeps the
shingle that arrives first. Two signatures agree in a component with the probability Jaccard similarity of
the two weighted sets. A shingle's arrivals end early, once they come later than every component's first.

Signatures are cut into bands. Texts that share a band are candidates: each first with the band's smallest
member (a star, so a band of n texts gives n - 1 pairs), then, after components are known, the pairs between
different components that a star has not seen, so no link that joins two classes is lost and no band is
spelt out into all pairs: members of a large band meet in blocks, and only links that join components leave
them. Candidates whose signatures agree too little are passed over; the others are verified by their exact
similarity from the whole texts. Exact copies are one node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix64, pack40, parts_for, small_batches, unpack40

WORDS = 5
SIMILARITY = 0.8
#: Bands and rows: at a similarity of 0.8 all bands differ for 7 of a million pairs.
BANDS, ROWS = 30, 5
#: Members of a band up to which unseen pairs come from a self-join; beyond, they are compared in blocks.
SMALL_BAND, BLOCK = 16, 512
#: Edges (16 bytes each) up to which one task finds the components.
MOST_EDGES = 200_000
#: Rows of 40 bytes that may be sent to every task.
MOST_BROADCAST = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x632BE59BD9B4E019)
MOST_WORDS = 100_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORD_HASHES = _WordHashes()


def weighted_shingles(texts: Sequence[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of whole texts, ordered by text and hash.

    Words are what white space separates. A text of fewer than ``words`` words, but one at least, is one
    shingle; null and empty texts have none.
    """
    if len(_WORD_HASHES) > MOST_WORDS:
        _WORD_HASHES.clear()
    get = _WORD_HASHES.__getitem__
    per = [np.fromiter(map(get, w), np.uint64, len(w)) for w in ((t or "").split() for t in texts)]
    lengths = np.array([len(p) for p in per], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.concatenate([*per, np.zeros(words - 1, np.uint64)])
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(total)
    mixed = np.zeros(total, np.uint64)
    for j in range(words):
        inside = place + j < ends[text]  # short texts' shingles stop at the text's end
        mixed = np.where(inside, mix64((mixed ^ hashes[j : j + total]) * _STEP + np.uint64(j + 1)), mixed)
    begins = (place == (ends - lengths)[text]) | (place + words <= ends[text])
    text, mixed = text[begins], mixed[begins]
    order = np.lexsort((mixed, text))
    text, mixed = text[order], mixed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (mixed[1:] != mixed[:-1])
    at = np.flatnonzero(new)
    return text[at], mixed[at], np.diff(np.append(at, len(text)))


def damped(count: np.ndarray) -> np.ndarray:
    """Another weight than the count, for ``probability_jaccard``: 1 + ln(count)."""
    return 1 + np.log(count)


def signatures(texts: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, components: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``components`` 16-bit values for each of ``texts`` texts; texts without shingles have zeros."""
    first = np.full(texts * components, np.inf)
    winner = np.zeros(texts * components, np.uint64)
    seed, rate, doc = shingle.copy(), count.astype(np.float64), text
    time = np.zeros(len(doc))
    worst = np.full(texts, np.inf)
    arrival, block = 0, 1
    while len(doc):
        rounds = np.arange(arrival, arrival + block, dtype=np.uint64)
        draws = mix64(seed[:, None] + _STEP * (rounds + np.uint64(1)))
        gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = time[:, None] + np.cumsum(gaps, 1) / rate[:, None]
        component = (mix64(draws ^ _SALT) % np.uint64(components)).astype(np.int64)
        slot = doc[:, None] * components + component
        early = times < worst[doc][:, None]
        t, s = times[early], slot[early]
        np.minimum.at(first, s, t)
        won = t == first[s]
        winner[s[won]] = np.broadcast_to(seed[:, None], times.shape)[early][won]
        worst = first.reshape(texts, components).max(1)
        time = times[:, -1]
        go = time < worst[doc]  # later arrivals of the others can't be first anywhere
        seed, rate, doc, time = seed[go], rate[go], doc[go], time[go]
        arrival += block
        block = min(64, max(1, 8_000 // max(1, len(doc)))) if arrival > 1 else 1
    return (mix64(winner) >> np.uint64(48)).astype(np.uint16).reshape(texts, components)


def probability_jaccard(a: str | None, b: str | None, words: int = WORDS, weight: Callable[[np.ndarray], np.ndarray] = damped) -> float:
    """The exact similarity: sum over common shingles d of 1 / sum over all e of max(a_e / a_d, b_e / b_d).

    Its default weight is ``damped``; ``near_duplicates`` weighs by counts, ``np.asarray`` here.
    """
    text, shingle, count = weighted_shingles([a, b], words)
    count = weight(count)
    return _exact(shingle[text == 0], count[text == 0], shingle[text == 1], count[text == 1])


def _exact(sa: np.ndarray, ca: np.ndarray, sb: np.ndarray, cb: np.ndarray) -> float:
    if not len(sa) or not len(sb):
        return 0.0
    every, inverse = np.unique(np.concatenate((sa, sb)), return_inverse=True)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[inverse[: len(sa)]], y[inverse[len(sa) :]] = ca, cb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratios, group = np.unique(y[both] / x[both], return_inverse=True)
    parts = np.bincount(group, x[both])
    return float(sum(p / np.maximum(x, y / r).sum() for p, r in zip(parts, ratios)))


def _key(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, components: int = BANDS * ROWS) -> DataFrame:
    """One row for each distinct text: node, key (MD5 of the text), least (its smallest identifier), signature (null without words)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            packed: list[bytes | None] = []
            for lo, hi in chunks(texts):
                text, shingle, count = weighted_shingles(texts[lo:hi], words)
                rows = signatures(hi - lo, text, shingle, count, components)
                has = np.zeros(hi - lo, bool)
                has[text] = True
                packed += [r.tobytes() if h else None for r, h in zip(rows, has)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(packed, pa.binary())], names=["id", "key", "signature"])

    signed = src.mapInArrow(work, "id long, key binary, signature binary")
    merged = signed.groupBy("key").agg(F.min("id").alias("least"), F.first("signature").alias("signature"))
    # written once, as the numbers of the nodes must not change when a part is computed again
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, parts_for(docs, 64.0))
    return cut(merged.coalesce(parts).select(F.monotonically_increasing_id().alias("node"), "key", "least", "signature"), parts)


def _bands(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, number, node): band is a hash of the band's number and values."""
    parts = [F.xxhash64(F.lit(b), F.substring("signature", b * rows * 2 + 1, rows * 2)) for b in range(bands)]
    return signed.where("signature is not null").select("node", F.posexplode(F.array(*parts)).alias("number", "band"))


def _agree(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` components at least."""
    s = signed.select("node", "signature")
    both = pairs.join(s.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").join(s.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _texts(wanted: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of some nodes: that of the document with the node's smallest identifier."""
    needed = cut(wanted.join(signed.select("node", "key", "least"), "node").select("node", F.col("key").alias("k"), F.col("least").alias("l")))
    if needed.count() <= MOST_BROADCAST:  # few short rows: the documents need not move
        needed = F.broadcast(needed)
    texts = docs.select(F.col(id_col).cast("long").alias("least"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
    return texts.join(needed, (F.col("key") == F.col("k")) & F.col("least").eqNullSafe(F.col("l"))).select("node", "text")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles, counts): each text's weighted shingles, packed: 40 bits each, and counts where one is above 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, packed = batch.column("text").to_pylist(), ([], [])
            for lo, hi in chunks(own):
                text, shingle, count = weighted_shingles(own[lo:hi], words)
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                for a, b in zip(bounds, bounds[1:]):
                    low = shingle[a:b] & np.uint64((1 << 40) - 1)
                    order = np.argsort(low)
                    packed[0].append(pack40(low[order]))
                    packed[1].append(count[a:b][order].astype("<u4").tobytes() if (count[a:b] > 1).any() else b"")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["node", "shingles", "counts"])

    return texts.mapInArrow(work, "node long, shingles binary, counts binary")


def _likeness_to(shingles: np.ndarray, counts: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The exact similarity of one weighted set to others, together where all counts are 1."""
    sizes = np.array([len(s) for s, _ in others])
    joined = np.concatenate([s for s, _ in others])
    at = np.minimum(np.searchsorted(shingles, joined), len(shingles) - 1)
    common = np.add.reduceat(shingles[at] == joined, np.cumsum(sizes) - sizes)
    out = common / (len(shingles) + sizes - common)
    plain = bool((counts == 1).all())
    for k, (s, c) in enumerate(others):
        if common[k] and not (plain and (c == 1).all()):
            out[k] = _exact(shingles, counts, s, c)
    return out


def _verify(pairs: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, words: int) -> DataFrame:
    """The pairs of texts with that similarity, each once; one document's text stands for each node."""
    pairs = cut(pairs)
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), signed, docs, id_col, text_col)
    side = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    both = pairs.join(side("b", "tb"), "b").join(side("a", "ta"), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            a_ids, others = batch.column("a").to_pylist(), batch.column("tb").to_pylist()
            for first, end in chunks(others):
                text, shingle, count = weighted_shingles(others[first:end], words)
                bounds = np.searchsorted(text, np.arange(end - first + 1))
                for k in range(first, end):
                    if own is None or a_ids[k] != last:
                        _, sa, ca = weighted_shingles([batch.column("ta")[k].as_py()], words)
                        last, own = a_ids[k], (sa, ca)
                    lo, hi = bounds[k - first], bounds[k - first + 1]
                    keep.append(_exact(*own, shingle[lo:hi], count[lo:hi]) >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long").distinct())


def _union_find(edges: DataFrame) -> DataFrame:
    """The components of few edges, in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        nodes = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(work, "node long, label long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each edge end's component.

    Up to ``MOST_EDGES`` edges go to one task; more are worked on by neighbours' labels and pointer jumping.
    """
    edges = cut(edges)
    if edges.count() <= MOST_EDGES:
        return cut(_union_find(edges))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        met = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = labels.select(F.col("u").alias("l"), F.col("l").alias("up"))
        new = cut(met.join(up, "l").select("u", "old", F.least("l", "up").alias("l")))
        labels = new.select("u", "l")
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("label"))


def _links_in(rows: pd.DataFrame, least: int, similarity: float, height: int) -> list[tuple[int, int]]:
    """Links between members of one band, enough of them to join all components that links join.

    Members outside the band's largest component are compared with the members in it, where the group has those,
    or else with one another; only across components, by signature and then by their whole weighted sets. A pair
    that shares an earlier band is left to it.
    """
    rows = rows.sort_values("node", ignore_index=True)
    signature = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), -1)
    sets = [(u := unpack40(s), np.frombuffer(c, "<u4") if c else np.ones(len(u), np.uint32)) for s, c in zip(rows["shingles"], rows["counts"])]
    node, block, number = rows["node"].to_numpy(), rows["block"].to_numpy(), int(rows["number"].iloc[0])
    _, component = np.unique(rows["label"].to_numpy(), return_inverse=True)
    largest = rows["big"].to_numpy()
    with_largest, two = bool(rows["with_largest"].iloc[0]), rows["p"].iloc[0] != rows["q"].iloc[0]
    out = []
    for k in np.flatnonzero(~largest):
        other = (component != component[k]) & (largest if with_largest else node > node[k])
        if two and not with_largest:
            other &= block != block[k]
        at = np.flatnonzero(other)
        agree = signature[at] == signature[k]
        near = agree.sum(1) >= least
        at, agree = at[near], agree[near]
        at = at[agree.reshape(len(at), -1, height).all(2).argmax(1) == number] if len(at) else at
        if not len(at):
            continue
        linked = at[_likeness_to(*sets[k], [sets[j] for j in at]) >= similarity - 1e-9]
        for c in np.unique(component[linked]):
            j = linked[component[linked] == c][0]
            out.append((min(node[k], node[j]), max(node[k], node[j])))
            component[component == c] = component[k]
    return out


def _more_links(members: DataFrame, labels: DataFrame, signed: DataFrame, docs: DataFrame, least: int, similarity: float, words: int, height: int, id_col: str, text_col: str) -> DataFrame:
    """Links that no star has seen: between members of one band in different components, neither its smallest member."""
    own = members.join(labels, "node", "left").select("band", "number", "node", F.coalesce("label", "node").alias("label"))
    open_ = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high").select("band", "n", "pivot")
    rest = cut(own.join(open_, "band").where("node <> pivot").select("band", "number", "node", "label", "n"))
    small = rest.where(F.col("n") <= SMALL_BAND)
    x = small.select("band", F.col("node").alias("a"), F.col("label").alias("la"))
    y = small.select("band", F.col("node").alias("b"), F.col("label").alias("lb"))
    few = _agree(x.join(y, "band").where("a < b and la <> lb").select("a", "b").distinct(), signed, least)
    few = _verify(few, signed, docs, id_col, text_col, similarity, words)
    # large bands: blocks of members outside the largest component meet one another and the largest's blocks, each
    # pair of blocks in a group of its own, compared and verified in place; pairs inside the largest need nothing,
    # so its members travel once for each block of the others, which are few
    large = rest.where(F.col("n") > SMALL_BAND)
    of_label = large.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = of_label.groupBy("band").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("all")).select("band", F.col("x.label").alias("most"), F.ceil(F.col("x.c") / BLOCK).cast("int").alias("of_big"), F.greatest(F.ceil((F.col("all") - F.col("x.c")) / BLOCK), F.lit(1)).cast("int").alias("of_small"))
    large = large.join(largest, "band").withColumn("big", F.col("label") == F.col("most"))
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("big"), F.col("of_big")).otherwise(F.col("of_small"))).cast("int"))
    smalls, bigs = F.sequence(F.lit(0), F.col("of_small") - 1), F.sequence(F.lit(0), F.col("of_big") - 1)
    group = lambda w, p, q: F.struct(F.lit(w).alias("with_largest"), p.alias("p"), q.alias("q"))
    of_big = F.transform(smalls, lambda x: group(True, x, F.col("block")))
    of_small = F.concat(F.transform(bigs, lambda x: group(True, F.col("block"), x)), F.transform(smalls, lambda x: group(False, F.least("block", x), F.greatest("block", x))))
    large = large.select("band", "number", "node", "label", "big", "block", F.explode(F.when(F.col("big"), of_big).otherwise(of_small)).alias("g")).select("band", "number", "node", "label", "big", "block", "g.*")
    sets = cut(_sets(_texts(large.select("node").distinct(), signed, docs, id_col, text_col), words).dropDuplicates(["node"]))
    large = large.join(sets, "node").join(signed.select("node", "signature"), "node")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_in(rows, least, similarity, height), columns=["a", "b"], dtype="int64")

    many = large.groupBy("band", "with_largest", "p", "q").applyInPandas(work, "a long, b long")
    return cut(few.union(many).distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id, the smallest identifier among the documents linked to it directly or through others,
    and class_text, the MD5 of the text of the class's first document.

    Every row of ``docs`` gives one row. Null texts are empty; texts without words are copies only of equal
    texts; texts of fewer than ``words`` words are compared as one shingle. Null identifiers are larger than
    all others, so a class has a null class_id only if all its identifiers are null. Rows of one identifier
    are told apart by text; equal rows are copies. An empty table gives no rows.
    """
    signed = nodes(docs, id_col, text_col, words, bands * rows)
    spread = (similarity * (1 - similarity) / (bands * rows)) ** 0.5
    least = int(np.floor((similarity - 5.5 * spread) * bands * rows))
    members = _bands(signed, bands, rows)
    pivots = members.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    shared = cut(members.join(pivots, "band"))  # members of bands that two texts share at least
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    edges = _verify(_agree(stars, signed, least), signed, docs, id_col, text_col, similarity, words)
    labels = components(edges)
    more = _more_links(shared.select("band", "number", "node"), labels, signed, docs, least, similarity, words, rows, id_col, text_col)
    if not more.isEmpty():
        labels = components(edges.union(more))
    labelled = signed.select("node", "key", "least").join(labels, "node", "left").select("key", "least", F.coalesce("label", "node").alias("label"))
    first = F.struct(F.col("least").isNull(), "least", "key")
    classes = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.hex(F.min_by("key", first)).alias("class_text"))
    of_text = labelled.join(classes, "label").select("key", "class_id", "class_text")
    return docs.select(F.col(id_col).alias("doc_id"), _key(text_col).alias("key")).join(of_text, "key").select("doc_id", "class_id", "class_text")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest identifier; equal rows count once."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    repeated = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    if not repeated:
        kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id"))
        return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
    # identifiers that repeat don't name a row: the text of the class's first document does
    kept = classes.select(F.col("class_id").alias("__id"), F.unhex("class_text").alias("__text_key")).distinct()
    keyed = docs.withColumn("__key", _key(text_col))
    first = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__key"] == kept["__text_key"]), "left_semi")
    return first.dropDuplicates([id_col, "__key"]).drop("__key")
