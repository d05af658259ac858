"""Main text of web pages by a linear-chain conditional random field over the blocks of a page.

A block is the text between two block-level tags. Its features are the tags and the words of the class, id and role
attributes above it, its own tag, and buckets of its length, punctuation and share of link text. The field has the labels
main text and other, one weight per feature and label and four transition weights; it is trained with exact gradients
(forward and backward sums) on labelled pages, and decoded by Viterbi.

Scripts, styles, templates, titles and other elements that never show text are no blocks. Comments and declarations
vanish; unclosed elements end where their parent ends, and a head at the first tag or text that cannot stand in it; a quote that is never closed ends its tag at the next ``>``.

Defined results: null, empty and textless pages give an empty text; pages are decided one by one, so ties, repeated rows
and null ids change nothing; no pages give no rows. Extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.htmlpages import training_pages

TRAINING_PAGES = 200
ROUNDS = 8

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HIDDEN = frozenset("script style noscript template title textarea iframe select option button head".split())
#: What can stand in a head; any other start tag, or text, ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these kinds first.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
_RAW = frozenset("script style noscript template title textarea iframe".split())
_TAG = re.compile(r"<(?:!--|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>)")
_HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[str, ...]:
    words = set()
    for name, *values in _HINT.findall(attributes):
        words.update(f"{name.lower() == 'role' and 'role' or 'name'}={w}" for w in _PARTS.findall(" ".join(values).lower()))
    return tuple(sorted(words))


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, features of the elements around it, share of link text) of each block in page order.

    What is open is counted as elements open and close, so time grows with the page and not with its depth."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple]] = []
    around: list[str] = []  # the block elements of the stack
    opened: Counter[str] = Counter()
    features: Counter[str] = Counter()
    known: tuple[str, ...] | None = None
    pieces: list[str] = []
    linked = links = 0
    hidden = 0

    def close() -> None:
        nonlocal linked, known
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                if known is None:
                    known = tuple(sorted([*features, f"own={around[-1] if around else ''}"]))
                out.append((text, known, min(1.0, linked / max(1, len(text)))))
            pieces.clear()
        linked = 0

    def push(name: str, hints: tuple) -> None:
        nonlocal hidden, links, known
        stack.append((name, hints))
        opened[name] += 1
        hidden += name in _HIDDEN
        links += name == "a"
        if name in _BLOCK:
            around.append(name)
            features.update((f"above={name}", *hints))
            known = None

    def pop(depth: int) -> None:
        nonlocal hidden, links, known
        while len(stack) > depth:
            name, hints = stack.pop()
            opened[name] -= 1
            hidden -= name in _HIDDEN
            links -= name == "a"
            if name in _BLOCK:
                around.pop()
                for feature in (f"above={name}", *hints):
                    features[feature] -= 1
                    if not features[feature]:
                        del features[feature]
                known = None

    def end_head() -> None:
        if opened["head"]:
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "head"))

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else size]
        if hidden and stack[-1][0] == "head" and text.strip():
            end_head()
        if text and not hidden:
            pieces.append(text)
            if links:
                linked += len(text.strip())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            if page.startswith("<!--", tag.start()):
                end = page.find("-->", tag.start() + 2)
                at = size if end < 0 else end + 3
            continue
        if tag[1] or tag[4]:
            if name in _BLOCK:
                close()
            if opened[name]:
                depth = len(stack) - 1
                # the end of an inline element does not reach beyond the block it stands in
                while stack[depth][0] != name and (name in _BLOCK or stack[depth][0] not in _BLOCK):
                    depth -= 1
                if stack[depth][0] == name:
                    pop(depth)
            continue
        if name not in _IN_HEAD:
            end_head()
        if name in _RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = size if stop < 0 else stop + 1
            if name in ("textarea", "iframe"):  # these take room in the text, a script does not
                pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
        if name in _BLOCK:
            close()
            ended = ("p", *_ENDS.get(name, ()))
            depth = len(stack) - 1
            while depth >= 0 and any(opened[e] for e in ended):
                if stack[depth][0] in ended:
                    pop(depth)
                elif stack[depth][0] in _BLOCK:
                    break
                depth -= 1
        if name not in _VOID and not (tag[3] or tag[6] or "").endswith("/"):
            push(name, _hints(tag[3] or tag[6] or ""))
    close()
    return out


def _text_features(text: str, linked: float) -> tuple[str, ...]:
    length = len(text)
    return (
        f"length={min(length.bit_length(), 9)}", f"links={int(linked * 3.99)}",
        f"points={sum(1 for _ in islice(_PUNCTUATION.finditer(text), 3))}", f"ends={text[-1] in '.!?'}", f"copyright={'©' in text}",
    )


class Field:
    """Weights of a trained field: per feature (other, main), and of the four transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self._of_path: dict[tuple, tuple[float, float]] = {}

    def _sum(self, features) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def decode(self, page: list[tuple[str, tuple[str, ...], float]]) -> list[int]:
        """The labels of a page's blocks with the highest sum (Viterbi); equal sums go to other."""
        back, other, main = [], 0.0, 0.0
        (oo, om), (mo, mm) = self.moves
        for i, (text, path, linked) in enumerate(page):
            if path not in self._of_path:
                if len(self._of_path) > 50_000:
                    self._of_path.clear()
                self._of_path[path] = self._sum(path)
            a, b = self._of_path[path]
            c, d = self._sum(_text_features(text, linked))
            if i:
                back.append((other + oo < main + mo, other + om < main + mm))
                other, main = max(other + oo, main + mo), max(other + om, main + mm)
            other, main = other + a + c, main + b + d
        label = int(main > other)
        labels = [label] if page else []
        for choice in reversed(back):
            label = int(choice[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Weights by adaptive gradient steps on the log-likelihood of whole pages."""
    ids: dict[str, int] = {}
    data = []
    for page, labels in pages:
        rows = [
            [ids.setdefault(f, len(ids)) for f in (*path, *_text_features(text, linked))]
            for text, path, linked in blocks(page)
        ]
        assert len(rows) == len(labels), "a label for each block"
        if rows:
            data.append((rows, labels))
    weight, moves = np.zeros((len(ids), 2)), np.zeros((2, 2))
    seen, seen_moves = np.full((len(ids), 2), 1e-2), np.full((2, 2), 1e-2)
    for _ in range(rounds):
        for rows, labels in data:
            score = np.array([weight[r].sum(axis=0) for r in rows])
            n = len(rows)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + moves, axis=0) + score[i]
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(moves + (score[i + 1] + behind[i + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            slope = np.eye(2)[labels] - np.exp(ahead + behind - total)
            turn = np.zeros((2, 2))
            for i in range(1, n):
                turn[labels[i - 1], labels[i]] += 1
                turn -= np.exp(ahead[i - 1][:, None] + moves + (score[i] + behind[i])[None, :] - total)
            for r, g in zip(rows, slope):
                seen[r] += g * g
                weight[r] += rate * (g - decay * weight[r]) / np.sqrt(seen[r])
            seen_moves += turn * turn
            moves += rate * (turn - decay * moves) / np.sqrt(seen_moves)
    return Field({f: (float(weight[i, 0]), float(weight[i, 1])) for f, i in ids.items()}, moves.tolist())


@lru_cache(maxsize=2)
def default_field(pages: int = TRAINING_PAGES) -> Field:
    return train(list(training_pages(pages)))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(text for (text, _, _), label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or default_field()
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            texts = [main_text(page, own) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
