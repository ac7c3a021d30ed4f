"""URL filtering: allow and block rules, and gradient-boosted trees for the rest (operator 10).

The trees are fitted on labelled URLs: a table that the caller has, or else what made_urls() makes. The
rules' own URLs are never learned from: rules decide by names, trees by what a URL looks like."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, md5_bits

#: (action, host and path start): the longest that fits decides.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Labelled URLs the trees are fitted on, at most: those of least MD5. Without a table, as many as MADE are made.
TRAIN_URLS, MADE = 20_000, 6_000
TREES, DEPTH, RATE, BINS, SMOOTH, FOLDS = 60, 3, 0.2, 32, 5.0, 5
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_labels", "path_depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "fragment", "hyphens", "https", "first_segment_length", "longest_token", "suffix_rate",
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


class Rules:
    """Rules by host, so that a URL meets only those of its host and the host's parents."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, rest = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + rest, rule, action))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits (of equals, the last by code point) and its action."""
        best, at = (-1, "", ""), 0
        while host:
            for start, rule, action in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    best = max(best, (len(rule), rule, action))
            at = host.find(".", at) + 1
            if not at:
                break
        return (best[1], best[2]) if best[0] >= 0 else (None, None)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def suffix(host: str) -> str:
    """The host's last label, by which block rates are counted."""
    return host.rpartition(".")[2]


def lexical(url: str) -> list[float]:
    """FEATURES of a URL but the rate, which comes last."""
    host, path = split_url(url)
    rest = url.partition("://")[2][len(host) + len(path) :] if "://" in url else url
    query, mark, _ = rest.partition("#")
    digits = sum(c.isdigit() for c in url)
    segments = [s for s in path.split("/") if s]
    return [
        len(url), len(host), len(path), len(query), host.count(".") + bool(host), len(segments), digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        _entropy(url), _entropy(host), query.count("=") or query.count("&"), float(bool(mark)), url.count("-"), float(url.startswith("https")),
        len(segments[0]) if segments else 0, max(map(len, re.split(r"[^0-9A-Za-z]+", url))),
    ]


class Rates:
    """Smoothed block rates of suffixes; the rate of all stands for what was never seen. Each fold's
    URLs are also counted apart, so that a URL that is learned from is described by the others' labels."""

    def __init__(self, urls: list[str], y: np.ndarray):
        self.prior = float(y.mean())
        self.folds = np.arange(len(urls)) % FOLDS
        self.sums: dict[str, np.ndarray] = {}
        for url, fold, label in zip(urls, self.folds, y, strict=True):
            self.sums.setdefault(suffix(split_url(url)[0]), np.zeros((FOLDS + 1, 2)))[[fold, FOLDS]] += (label, 1)

    def of(self, url: str, fold: int | None = None) -> list[float]:
        """The rate of a URL's suffix, without the labels of a fold."""
        entry = self.sums.get(suffix(split_url(url)[0]))
        blocked, n = (0.0, 0.0) if entry is None else entry[FOLDS] - (0 if fold is None else entry[fold])
        return [(blocked + SMOOTH * self.prior) / (n + SMOOTH)]


#: Traits of junk that made_urls() gives to URLs.
TRAITS = ("chained_host", "numbered_host", "long_token", "many_parameters", "deep_path", "long_numbers", "odd_suffix")


def made_urls(count: int = MADE, seed: int = 10, traits: tuple[str, ...] = TRAITS) -> list[tuple[str, bool]]:
    """Labelled URLs made up for training: (url, junk), the same for the same arguments.

    A clean URL has a host of one word or two, a few readable segments, seldom a parameter, and in a
    quarter of cases one trait. Junk, a third of all, is a URL with two to four traits. So no trait by
    itself tells junk; none of the names is a real one."""
    rng = random.Random(seed)
    syllables = [c + v for c in "bcdfglmnprst" for v in "aeiou"]
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    token = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    out = []
    for _ in range(count):
        junk = rng.random() < 1 / 3
        own = set(rng.sample(traits, min(len(traits), rng.randint(2, 4) if junk else int(rng.random() < 0.25))))
        host = word() if rng.random() < 0.85 else f"{word()}-{word()}"
        if "chained_host" in own:
            host = "-".join(word() for _ in range(rng.randint(3, 5)))
        if "numbered_host" in own:
            host += str(rng.randint(10, 10 ** rng.randint(2, 6)))
        ending = rng.choice(["top", "icu", "zz", "biz"]) if "odd_suffix" in own else rng.choice(["com", "com", "net", "org", "org", "de", "fr", "es"])
        path = [rng.choice([word(), f"{word()}-{word()}", str(rng.randint(1, 9999)), "en", "de", "fr"]) for _ in range(rng.randint(1, 4))]
        if "deep_path" in own:
            path += [word() for _ in range(rng.randint(5, 9))]
        if "long_token" in own:
            path.insert(rng.randint(0, len(path)), token(18, 40))
        if "long_numbers" in own:
            path += [str(rng.randint(10**7, 10**14)) for _ in range(rng.randint(1, 2))]
        many = rng.randint(4, 9) if "many_parameters" in own else rng.choice([0, 0, 0, 0, 0, 1, 1, 2])
        asked = "&".join(f"{word()[:4]}={rng.choice([word(), str(rng.randint(1, 99)), token(3, 8)])}" for _ in range(many))
        tail = rng.choice(["", "", "/", ".html"]) + (f"?{asked}" if asked else "") + rng.choice(["", "", "", "", "#top"])
        out.append((f"http{rng.choice(['s', 's', ''])}://{rng.choice(['', '', 'www.', 'm.', 'blog.'])}{host}.{rng.choice(['', '', 'example.'])}{ending}/{'/'.join(path)}{tail}", junk))
    return out


def _edges(values: np.ndarray) -> np.ndarray:
    """Thresholds at about the quantiles, each midway between two values that occur, and at even steps."""
    distinct, steps = np.unique(values), np.linspace(0, 1, BINS + 1)[1:-1]
    low = np.unique(np.quantile(values, steps, method="lower"))
    low = low[low < distinct[-1]]
    return np.unique(np.concatenate([(low + distinct[np.searchsorted(distinct, low, "right")]) / 2, distinct[0] + steps * (distinct[-1] - distinct[0])]))


class Boosted:
    """Gradient-boosted regression trees of fixed depth on the logistic loss, fitted on binned features."""

    def __init__(self) -> None:
        self.base = -math.inf  # without labels nothing is blocked
        self.rates: Rates | None = None
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, urls: list[str], blocked: list[bool]) -> Boosted:
        """Labels of one class give that class always."""
        y = np.array(blocked, float)
        if not len(y):
            return self
        if y.min() == y.max():
            self.base = math.inf if y[0] else -math.inf
            return self
        self.rates = Rates(urls, y)
        x = np.array([lexical(u) + self.rates.of(u, fold) for u, fold in zip(urls, self.rates.folds, strict=True)])
        edges = [_edges(x[:, f]) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        self.base = math.log(y.mean() / (1 - y.mean()))
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, threshold = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
            at = np.zeros(len(y), int)
            for node in range(2**DEPTH - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-9, 0, np.inf, len(y) + BINS)  # without a split all rows go left, as they do in blocked()
                for f, e in enumerate(edges):
                    if not len(e) or len(rows) < 2:
                        continue
                    g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(e) + 1))
                    h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(e) + 1))
                    left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
                    gain = left + right - g[-1] ** 2 / (h[-1] + 1)
                    equal = np.flatnonzero(gain >= gain.max() - 1e-9)
                    k = int(equal[len(equal) // 2])  # midway between the two sides
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(e[k]), k)
                feature[node], threshold[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[3])
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
            margin += value[leaf]
            self.trees.append((feature, threshold, value))
        return self

    def importances(self) -> dict[str, float]:
        """Each feature's part of the splits."""
        used = np.concatenate([f[np.isfinite(t)] for f, t, _ in self.trees]) if self.trees else np.zeros(0, int)
        return {name: float((used == k).mean()) if len(used) else 0.0 for k, name in enumerate(FEATURES)}

    def blocked(self, urls: list[str]) -> np.ndarray:
        """Whether the log-odds of block are above zero."""
        margin = np.full(len(urls), self.base)
        if self.trees and urls:
            x = np.array([lexical(u) + self.rates.of(u) for u in urls])
            rows = np.arange(len(urls))
            for feature, threshold, value in self.trees:
                at = np.zeros(len(urls), int)
                for _ in range(DEPTH):
                    at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
                margin += value[at - (2**DEPTH - 1)]
        return margin > 0


def _ruled(rules: Rules, model: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            matched = [rules.match(*p) for p in parts]
            verdict = [m[1] for m in matched]
            open_ = [i for i, v in enumerate(verdict) if v is None]
            for i, block in zip(open_, model.blocked([urls[i] or "" for i in open_]), strict=True):
                verdict[i] = "block" if block else "allow"
            columns = [[p[0] for p in parts], [p[1] for p in parts], [m[0] for m in matched], verdict]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict"])

    return run


def train(labelled: DataFrame | None = None, train_urls: int = TRAIN_URLS) -> Boosted:
    """Fits the trees on labelled URLs (url, verdict), of which at most train_urls distinct ones are taken,
    those of least MD5, the same on every run; without a table on made_urls().

    Only URLs whose hash is below a bound leave the scan; the bound rises until there are enough or all."""
    if labelled is None:
        urls, junk = zip(*made_urls(), strict=True)
        return Boosted().fit(list(urls), list(junk))
    source = labelled.filter("verdict in ('allow', 'block')").select("url", "verdict").filter(F.col("url").isNotNull())
    part = min(1.0, 4.0 * train_urls / max(1, source.count()))
    while True:
        some = cut(source.filter(md5_bits(F.col("url"), 8).cast("double") / 16.0**8 <= part).distinct())
        if part >= 1 or some.count() >= train_urls:
            break
        part = min(1.0, 4 * part)
    sample = some.orderBy(F.md5("url"), "url", "verdict").limit(train_urls).toArrow()
    return Boosted().fit(sample.column("url").to_pylist(), [v == "block" for v in sample.column("verdict").to_pylist()])


def judge(pages: DataFrame, model: Boosted, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A null URL, or one without `://`, has an empty host and path, fits no rule and is judged by the
    trees as the text it is (null: empty). Trees that were given no labels allow. Repeated rows are
    judged alike; an empty table gives no rows; other columns aren't read."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = rows.mapInArrow(_ruled(Rules(rules), model), f"id {dict(rows.dtypes)['id']}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", "page_id")
