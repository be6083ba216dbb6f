"""HTML extraction: gradient-boosted trees over the nodes of a page, and a decoding that agrees from ancestors to descendants."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import layouts
from matchloom.llm.common import table
from matchloom.llm.dom import Page, read

#: Labelled pages that the trees are fitted to, and the seed of their layouts.
SAMPLE_PAGES, SEED = 1_200, 11
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.2, 32, 2.0, 2.0
STOPS = re.compile(r"[.,;:!?…。、]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Nodes that are judged together.
NODES = 20_000


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row for each node: size, share and density of its subtree, links and stops in it, tag and attribute words of itself,
    its ancestors and what is below it (by their log odds of holding main text), depth, place, and how it compares with its siblings."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 9))  # characters, words, linked characters, stops, fields, elements, list items, runs, headings
    for i, (tag, text) in enumerate(zip(page.tag, page.text)):
        if text is None:
            own[i, 4:] = page.fields[i], 1, tag == "li", 0, tag in HEADINGS
        else:
            own[i] = len(text), text.count(" ") + 1, page.linked[i], len(STOPS.findall(text)), 0, 0, 0, 1, 0
    before = np.cumsum(own[:, 0]) - own[:, 0]
    below = own.copy()
    depth, odd = np.zeros(n), np.zeros((n, 9))  # odds: tag; words least and most; of ancestors: tag least, words least and most; below: tag least, words least and most
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        words = [odds.get("." + t, 0.0) for t in page.tokens[i]]
        odd[i, 0] = odds.get("<" + page.tag[i], 0.0)
        odd[i, 1], odd[i, 2] = min(0.0, *words, 0.0), max(0.0, *words, 0.0)
        odd[i, 3] = min(odd[p, 3], odd[p, 0])
        odd[i, 4], odd[i, 5] = min(odd[p, 4], odd[p, 1]), max(odd[p, 5], odd[p, 2])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        below[p] += below[i]
        odd[p, 6] = min(odd[p, 6], odd[i, 6], odd[i, 0])
        odd[p, 7], odd[p, 8] = min(odd[p, 7], odd[i, 7], odd[i, 1]), max(odd[p, 8], odd[i, 8], odd[i, 2])
    chars = np.maximum(below[:, 0], 1)
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    up = np.maximum(parent, 0)
    place = np.zeros(n)
    seen: dict[int, int] = {}
    alike: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        place[i] = seen[parent[i]] = seen.get(parent[i], -1) + 1
        alike[parent[i], page.tag[i]] = alike.get((parent[i], page.tag[i]), 0) + 1
    same = np.array([0, *[alike[page.parent[i], page.tag[i]] for i in range(1, n)]])
    siblings = np.maximum(kids[up], 1)
    rest = np.maximum(below[up, 0] - below[:, 0], 0) / np.maximum(siblings - 1, 1)
    links, stops = below[:, 2] / chars, below[:, 3] / np.maximum(below[:, 1], 1)
    return np.column_stack([
        np.log1p(below[:, 0]), np.log1p(below[:, 1]), links, stops, below[:, 0] / max(below[0, 0], 1), below[:, 5] / chars, np.log1p(below[:, 4]), np.log1p(below[:, 6]), np.log1p(below[:, 7]),
        below[:, 8], below[:, 0] / np.maximum(below[:, 7], 1), odd, depth, place / siblings, siblings, same / siblings, np.log1p(rest), before / max(below[0, 0], 1),
        (np.array(page.tag) == "#text"), links[up], stops[up], np.log1p(below[up, 0]), below[:, 0] / np.maximum(below[up, 0], 1), kids, below[:, 0] / np.maximum(below[:, 1], 1),
    ])


def grow(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of depth DEPTH for the logistic loss: split features and limits (tree, inner node), leaves (tree, leaf).

    Each tree sees half of the rows, the other half than the one before. Splits are sought in histograms of BINS quantiles; a
    node is split while both sides keep a second derivative of LEAST, else its limit is infinite and all go left.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)])
    feature = np.zeros((TREES, 2**DEPTH - 1), np.int32)
    limit = np.full((TREES, 2**DEPTH - 1), np.inf)
    leaves = np.zeros((TREES, 2**DEPTH))
    score, every = np.zeros(len(x)), x
    half = np.random.default_rng(SEED).permutation(len(x)) % 2
    halves = [(x[half == i], np.ascontiguousarray(binned[half == i].T), y[half == i], half == i) for i in (0, 1)]
    for t in range(TREES):
        x, bins, y, some = halves[t % 2]
        p = 1 / (1 + np.exp(-score[some]))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            best = np.zeros(nodes)
            for f, k in enumerate(cuts):
                key = at * BINS + bins[f]
                sums = [np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (g, h)]
                gl, hl = (s[:, : len(k)] for s in sums)
                ga, ha = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain = np.where((hl >= LEAST) & (ha - hl >= LEAST), gain, 0)
                if len(k):
                    j = gain.argmax(1)
                    top = gain[np.arange(nodes), j]
                    for v in np.flatnonzero(top > best + 1e-9):
                        best[v] = top[v]
                        feature[t, nodes - 1 + v], limit[t, nodes - 1 + v] = f, k[j[v]]
            where = nodes - 1 + at
            at = 2 * at + (x[np.arange(len(x)), feature[t, where]] > limit[t, where])
        leaves[t] = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        score += judge_tree(every, feature[t], limit[t], leaves[t])
    return feature, limit, leaves


def judge_tree(x: np.ndarray, feature: np.ndarray, limit: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
    return leaves[at - (2**DEPTH - 1)]


def judge(x: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability that a node's text is main text, for each row of features."""
    return 1 / (1 + np.exp(-sum(judge_tree(x, *tree) for tree in zip(*trees))))


def judged(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are judged: those with text and not all of it in one child, which speaks for both; and which have text at all."""
    chars = np.array([len(t) if t else 0 for t in page.text])
    some = np.zeros(len(chars), np.int64)  # children with text
    for i in range(len(chars) - 1, 0, -1):
        if chars[i]:
            chars[page.parent[i]] += chars[i]
            some[page.parent[i]] += 1
    return (chars > 0) & (some != 1), chars > 0


def decode(page: Page, pure: np.ndarray, main: np.ndarray) -> list[int]:
    """The runs of the likeliest labelling of the tree: from the root down, a node is all main, all other, or mixed.

    pure is the probability that a node is not mixed, main that a pure one is main, both given that its parent is mixed: below a
    pure node nothing is judged any more, so no descendant contradicts an ancestor. Of even choices a node is other.
    """
    n = len(page.tag)
    on, some = judged(page)
    lo = 1e-4
    pure, main = np.clip(pure, lo, 1 - lo), np.clip(main, lo, 1 - lo)
    pure[[t is not None for t in page.text]] = 1.0
    keep, drop, mixed = np.log(pure * main), np.log(pure * (1 - main)), np.log(np.maximum(1 - pure, 1e-300))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not some[i]:
            continue
        if on[up]:
            mixed[up] += max(keep[i], drop[i], mixed[i])
        else:
            keep[up], drop[up], mixed[up] = keep[i], drop[i], mixed[i]
    out, label = [], [0] * n  # 1: main, -1: other, 0: mixed
    for i in range(n):
        above = label[page.parent[i]] if i else 0
        label[i] = above or (0 if mixed[i] > max(keep[i], drop[i]) else 1 if keep[i] > drop[i] else -1)
        if page.text[i] is not None and label[i] > 0:
            out.append(i)
    return out


def learn(pages: int = SAMPLE_PAGES, seed: int = SEED) -> tuple:
    """Odds of tags and attribute words, trees for pure nodes and for main ones, from labelled pages in varied layouts.

    A sample of fixed size, whatever the input. Only nodes below mixed ones are learned from, as only they are ever judged.
    """
    made = []
    for source in layouts.sample(pages, seed):
        page = read(source)
        main = np.zeros(len(page.tag))
        chars = np.zeros(len(page.tag))
        for i, text in enumerate(page.text):
            if text is not None:
                main[i] = len(text) * (layouts.MAIN in text)
                chars[i] = len(text)
                page.text[i] = text.replace(layouts.MAIN, "")
        for i in range(len(page.tag) - 1, 0, -1):
            main[page.parent[i]] += main[i]
            chars[page.parent[i]] += chars[i]
        made.append((page, main / np.maximum(chars, 1)))
    seen: dict[str, list[float]] = {}
    for page, share in made:
        for i in np.flatnonzero(judged(page)[1]):
            for name in ("<" + page.tag[i], *["." + t for t in page.tokens[i]]):
                count = seen.setdefault(name, [0.0, 0.0])
                count[0] += share[i]
                count[1] += 1
    odds = {name: float(np.log((a + 1) / (n - a + 1))) for name, (a, n) in seen.items() if n >= 3}
    rows, shares, runs = [], [], []
    for page, share in made:
        on = judged(page)[0]
        under = [True]  # below a mixed node, the nearest of those that are judged
        for i in range(1, len(page.tag)):
            up = page.parent[i]
            under.append(0 < share[up] < 1 if on[up] else under[up])
        on = np.flatnonzero(on & under)
        rows.append(features(page, odds)[on])
        shares.append(share[on])
        runs.append(np.array([t is not None for t in page.text])[on])
    x, share, run = np.concatenate(rows), np.concatenate(shares), np.concatenate(runs)
    one = (share == 0) | (share == 1)
    return odds, grow(x[~run], one[~run].astype(float)), grow(x[one], share[one])


def main_texts(sources: list[str], model: tuple) -> list[str]:
    """The main text of each page: its main runs in page order, with one space between them."""
    odds, pure, main = model
    out: list[str] = []
    held: list[Page] = []
    rows: list[np.ndarray] = []

    def flush() -> None:
        if held:
            x, at = np.concatenate(rows), 0
            p, q = judge(x, pure), judge(x, main)
            for page in held:
                out.append(" ".join(page.text[i] for i in decode(page, p[at : at + len(page.tag)], q[at : at + len(page.tag)])))
                at += len(page.tag)
        held.clear()
        rows.clear()

    for source in sources:
        held.append(read(source))
        rows.append(features(held[-1], odds))
        if sum(map(len, rows)) > NODES:
            flush()
    flush()
    return out


def extract(df: DataFrame, id_col: str, html_col: str, model: tuple, keep: list[str] = ()) -> DataFrame:
    """One row for each row: id, the columns in `keep`, and text, the page's main text.

    A page is read whole; a null or empty one, or one without main text, gives an empty text. Rows and ids may repeat or be
    null; an empty table gives no rows; other columns are dropped, whatever their names. A page's result depends on that page alone. Nothing is
    shuffled. A task holds the nodes of one page, or of some small ones.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # plain arrays of some 100 KB, fixed by TREES and DEPTH
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_texts([t or "" for t in part.column(len(names)).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=[*part.schema.names[: len(names)], "text"])

    inner = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(html_col).alias("html"))
    out = inner.mapInArrow(run, inner.drop("html").schema.add("text", "string"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "text")


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), "page_id", "html", learn(), keep=["url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
