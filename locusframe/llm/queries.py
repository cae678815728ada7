"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, lz_fingerprint, matroska, mixing, probminhash, quality, sstable, suffix_dedup, url_filter
from .common import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that documents of smaller identifiers have."""
    return suffix_dedup.span_digests(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by its host's template."""
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written as sorted string tables and read back."""
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return sstable.read_shards(spark, shards)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by trees learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, trees)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the curriculum takes, and when first, in training order."""
    assigned = mixing.assign(table(spark, sf_dir, "documents"), keep=("doc_id",))
    first = assigned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(F.get("positions", F.lit(0)), 6).alias("first_position"), F.size("positions").alias("copies"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col("first_position").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.least(F.floor(F.col("first_position") * n), F.lit(n - 1)))
    return first.repartitionById(n, part.cast("int")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the streaming BPE transducer and back through the decoder."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a Matroska file, read back by the parser."""
    return matroska.media_digest(matroska.media_column(table(spark, sf_dir, "documents")))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrase fingerprint beside that of its edited text and of the next document."""
    return lz_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_probminhash, op2_suffix_dedup, op3_html_extract, op4_token_shards, op5_quality_classifier, op6_mixing, op7_streaming_bpe, op8_media_columns, op9_lz_fingerprint, op10_url_filter)}


def _op10_sql() -> str:
    rules = ",\n    ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
    blocked = "cheap-pills|spam-farm|casino"
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
    {rules}),
parts AS (
    SELECT page_id, url,
        translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
    FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
fits AS (
    SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY page_id)
SELECT page_id, host, path, rule,
    CASE WHEN rule IS NOT NULL THEN rverdict
         WHEN host = '' OR regexp_matches(host, '{blocked}')
              OR regexp_matches(host || path, '(^[^/]*\\.zip$)|/login/|/wp-admin/|\\.exe$') THEN 'block'
         ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits USING (page_id)"""


def _op6_sql() -> str:
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))

    def inverse(knots: tuple[float, ...]) -> str:
        """The time by which a share y is due, as SQL."""
        m = len(knots) - 1
        areas = [(a + b) / 2 / m for a, b in zip(knots, knots[1:])]
        whole, out = sum(areas), ""
        for k, (a, b) in enumerate(zip(knots, knots[1:])):
            rest = f"greatest(y * {whole!r} - {sum(areas[:k])!r}, 0)"
            slope = (b - a) * m
            ahead = f"{rest} / {a!r}" if not slope else f"(sqrt(greatest({a * a!r} + {2 * slope!r} * {rest}, 0)) - {a!r}) / {slope!r}"
            out += f"WHEN y * {whole!r} <= {sum(areas[: k + 1])!r} OR {k} = {m - 1} THEN {k / m!r} + least({ahead}, {1 / m!r}) "
        return f"CASE {out}END"

    times = " ".join(f"WHEN {k} THEN {inverse(knots)}" for k, knots in enumerate(mixing.SCHEDULES))
    return f"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (
    SELECT *, CASE place % {len(mixing.WEIGHTS)} {weights} END::DOUBLE AS w, place % {len(mixing.SCHEDULES)} AS k, {mixing.MOST_PASSES} * source_size AS cap FROM sources),
-- a source is stopped if its cap is below its share; caps over weights in ascending order fill up first
ranked AS (
    SELECT *, (SELECT {mixing.SHARE} * sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
level AS (SELECT max(rest / open_weight) FILTER (rest / open_weight <= cap / w) AS unit FROM ranked),
targets AS (SELECT source, source_size, k, least(CAST(cap AS DOUBLE), (SELECT unit FROM level) * w) AS target FROM weighed),
starts AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, t.k, CAST(floor(t.target + {mixing.ROUNDING}) AS BIGINT) AS whole,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
    SELECT *, (start + least(size, whole - start) / 2.0::DOUBLE) / target AS y,
        CAST({" + ".join(f"CASE WHEN start + {e} * source_size < whole THEN 1 ELSE 0 END" for e in range(mixing.MOST_PASSES))} AS INT) AS copies,
        CAST({" + ".join(f"greatest(least(size, whole - start - {e} * source_size), 0)" for e in range(mixing.MOST_PASSES))} AS BIGINT) AS words FROM starts)
SELECT doc_id, size, source_size, round(target, 6) AS target, words AS taken, CASE WHEN copies > 0 THEN round(CASE k {times} END, 6) END AS first_position, copies
FROM taken"""


def _op1_sql() -> str:
    n, least = probminhash.WORDS, probminhash.SIMILARITY - 1e-9
    return rf"""
WITH RECURSIVE texts AS (SELECT md5(coalesce(text, '')) AS k, min(doc_id) AS first_id, any_value(coalesce(text, '')) AS text FROM documents GROUP BY 1),
words AS (SELECT k, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS w FROM texts),
shingles AS (SELECT k, array_to_string(w[i : i + {n - 1}], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0) AS places),
weights AS (SELECT k, s, CAST(count(*) AS DOUBLE) AS v FROM shingles GROUP BY k, s),
totals AS (SELECT k, sum(v) AS total FROM weights GROUP BY k),
common AS (SELECT x.k AS a, y.k AS b, x.v AS va, y.v AS vb FROM weights x JOIN weights y ON x.s = y.s AND x.k < y.k),
-- the similarity is at most the common shingles' share of either text
pairs AS (
    SELECT a, b, ta.total AS ta, tb.total AS tb, sum(va) AS ca, sum(vb) AS cb FROM common JOIN totals ta ON a = ta.k JOIN totals tb ON b = tb.k
    GROUP BY a, b, ta.total, tb.total HAVING sum(va) >= {least} * ta.total AND sum(vb) >= {least} * tb.total),
ratios AS (SELECT a, b, vb / va AS r, sum(va) AS part FROM common SEMI JOIN pairs USING (a, b) GROUP BY a, b, vb / va),
maxima AS (SELECT a, b, r, part, sum(greatest(c.va, c.vb / r)) AS m FROM ratios JOIN common c USING (a, b) GROUP BY a, b, r, part),
alike AS (SELECT a, b FROM maxima JOIN pairs USING (a, b) GROUP BY a, b HAVING sum(part / (m + ta - ca + (tb - cb) / r)) >= {least}),
links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach AS (SELECT k, k AS r FROM texts UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.r = links.a),
classes AS (SELECT reach.k, min(t.first_id) AS class_id, upper(min_by(t.k, t.first_id)) AS class_text FROM reach JOIN texts t ON reach.r = t.k GROUP BY reach.k)
SELECT d.doc_id, c.class_id, c.class_text FROM documents d JOIN classes c ON md5(coalesce(d.text, '')) = c.k"""


def _op2_sql() -> str:
    n = suffix_dedup.LENGTH
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * n}) AS g FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - {n - 1}, 0))) AS s FROM docs) AS starts),
firsts AS (SELECT g, min(doc_id) AS least FROM strings GROUP BY g),
hits AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM strings JOIN firsts USING (g) WHERE least < doc_id),
islands AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM hits),
spans AS (SELECT doc_id, min(s) AS a, max(s) + {n} AS b FROM islands GROUP BY doc_id, island),
pieces AS (
    SELECT doc_id, a AS place, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM spans
    UNION ALL SELECT d.doc_id, length(h) // 2 + 1, coalesce(max(b), 0), length(h) // 2 FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id, h),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY place) AS h FROM pieces p JOIN docs d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
counts AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id"""


def _op3_sql() -> str:
    """For pages whose main text is an article of headings and paragraphs, as all of the tables' are."""
    return r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
lines AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), '<br>', ' ', 'g'), '</?(h1|p)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS l FROM articles),
plain AS (SELECT page_id, url, [y FOR y IN [trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN l] IF y <> ''] AS l FROM lines)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM plain"""


def oracle_sql() -> dict[str, str]:
    return {"op1_probminhash": _op1_sql(), "op2_suffix_dedup": _op2_sql(), "op3_html_extract": _op3_sql(), "op6_mixing": _op6_sql(), "op10_url_filter": _op10_sql()}
