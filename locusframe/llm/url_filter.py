"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And mask: every rule has a start bit followed by
one bit for each literal position, words of 64 bits are chained by carries, and one pass over a
canonical URL's bytes moves all rules at once. A batch of URLs moves in lock step with numpy.

Globs: ``*`` any run within a host or path segment (no ``/``), ``**`` any run, ``?`` one byte but
``/``; other characters stand for themselves. A rule matches the whole canonical URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_PARTS = re.compile(r"(?s)://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A verdict for one host (and its subdomains) and a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


#: The rules that a caller may override.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

#: The method's own list, for URLs that no rule fits: blocked if a glob matches the canonical URL.
BLOCK_GLOBS = (
    "*cheap-pills*",
    "*cheap-pills*/**",
    "*spam-farm*",
    "*spam-farm*/**",
    "*casino*",
    "*casino*/**",
    "*.zip",
    "**/login/**",
    "**/wp-admin/**",
    "**.exe",
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lowered, path): host from after the first ``://`` up to ``/ ? #``, path up to ``? #``."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class GlobAutomaton:
    """Glob patterns as chained 64-bit Shift-And words."""

    def __init__(self, globs: Sequence[str]):
        tokens = [self._parse(g) for g in globs]
        bits = sum(1 + sum(kind == "byte" for kind, _ in t) for t in tokens)
        self.words = words = max(1, -(-bits // 64))
        self.n = len(globs)
        self.step = np.zeros((256, words), np.uint64)  # after this byte, a shifted bit may stand here
        self.stay = np.zeros((256, words), np.uint64)  # a bit that stands here may stay at this byte
        self.start = np.zeros(words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        not_slash = np.arange(256) != 0x2F
        at = 0
        for t in tokens:
            w, b = divmod(at, 64)
            self.start[w] |= np.uint64(1 << b)
            for kind, value in t:
                if kind == "byte":
                    at += 1
                    w, b = divmod(at, 64)
                    here = not_slash if value is None else np.arange(256) == value
                    self.step[here, w] |= np.uint64(1 << b)
                else:
                    w, b = divmod(at, 64)
                    self.stay[slice(None) if kind == "any" else not_slash, w] |= np.uint64(1 << b)
            w, b = divmod(at, 64)
            self.accept.append((w, np.uint64(1 << b)))
            at += 1

    @staticmethod
    def _parse(glob: str) -> list[tuple[str, int | None]]:
        out: list[tuple[str, int | None]] = []
        for piece in re.findall(r"\*\*+|\*|\?|[^*?]+", glob):
            if piece[0] == "*":
                out.append(("any" if len(piece) > 1 else "segment", None))
            elif piece == "?":
                out.append(("byte", None))
            else:
                out += [("byte", x) for x in piece.encode()]
        return out

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean matrix (texts x globs): which globs match which whole texts."""
        n = len(texts)
        out = np.zeros((n, self.n), bool)
        if not n:
            return out
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # the longest first: active texts stay a prefix
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        state = np.tile(self.start, (n, 1))
        top = np.uint64(63)
        active = n
        for t in range(int(sorted_lengths[0])):
            active = int(np.searchsorted(-sorted_lengths[:active], -t, side="left"))
            byte = data[begins[:active] + t]
            old = state[:active]
            moved = old << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= old[:, :-1] >> top
            state[:active] = (moved & self.step[byte]) | (old & self.stay[byte])
        for k, (w, bit) in enumerate(self.accept):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS, url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns and host, path, rule, verdict of every row.

    Of the rules that fit, the one with the longest host and path together wins; with none, the rule is
    null and the URL is blocked if one of ``block_globs`` matches ``host + path``, else allowed. A null
    URL or one without ``://`` has an empty host and path, no rule, and is blocked: it can't be fetched.
    Repeated rows stay, an empty table gives no rows, and other columns of ``pages`` are ignored.
    """
    small_batches(pages.sparkSession)
    rules = list(rules)
    globs = [g for r in rules for g in r.globs()] + list(block_globs)
    owner = [k for k, r in enumerate(rules) for _ in r.globs()]
    src = pages.select(*[F.col(c) for c in keep], F.col(url_col).alias("__url"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        size = np.array([len(r.name) for r in rules] or [0])
        for batch in batches:
            split = [split_url(u) for u in batch.column("__url").to_pylist()]
            hits = automaton.run([(h + p).encode("utf-8", "surrogatepass") for h, p in split])
            fits = np.zeros((len(split), max(1, len(rules))), bool)
            for k, r in enumerate(owner):
                fits[:, r] |= hits[:, k]
            best = np.where(fits, size + 1, 0).argmax(1)
            ruled = fits.any(1)
            own = hits[:, len(owner) :].any(1)
            name = [rules[b].name if f else None for b, f in zip(best, ruled)]
            verdict = [rules[b].verdict if f else "block" if o or not h else "allow" for b, f, o, (h, _) in zip(best, ruled, own, split)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(name, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names[:-1], "host", "path", "rule", "verdict"],
            )

    return src.mapInArrow(work, f"{fields}{', ' if fields else ''}host string, path string, rule string, verdict string")
