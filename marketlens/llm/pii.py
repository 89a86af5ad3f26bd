"""Personal data: patterns as a base, and a skip-chain conditional random field that adds spans.

Nodes are the blank-separated tokens that hold a digit or an at sign; a text without any has no
entities. Neighbouring nodes are linked as a chain. A node is also linked to the last earlier node
that repeats or resembles it (same digits, same last seven digits, same local part of an address),
however far away, if a pattern labels any node that can be reached by such links; runs of neighbouring
groups of digits are compared as one number, and their groups linked by the places of their digits
from the end. So an entity keeps one label through a document. Sum-product messages run along both
kinds of links until they settle. Node weights are fitted to the labels the patterns give in a
bounded sample of texts; link weights are the sample's logarithmic label associations. Nodes under a
pattern's span are held to its label; other nodes whose marginal reaches `SURE` add a span.

Empty cases: null and empty texts have no spans; an empty table gives an empty result; without
texts to fit, no span is added; null ids are carried along; equal rows get equal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
HASHED = 1 << 12
#: Digits of the longest entity, and how many last ones make two numbers alike.
LONGEST, ALIKE = 19, 7
_LABELS = len(KINDS) + 1
_HOLD = 12.0
#: Largest change of a message that has settled, and the rounds after which even texts that swing are left.
_SETTLED = 1e-4
_LEAST_ROUNDS, _ROUNDS_PER_LINK = 48, 4
_EDGE = ".,;:!?()[]{}<>\"'"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that no address follows would fail from each of its digits: only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BLANK = re.compile(r"\s")
_SIGN = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[^\W\d]|@")


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _tokens(text: str) -> list[tuple[int, int]]:
    """Blank-separated tokens that hold a digit or an at sign; found from their signs, so other long words cost nothing."""
    found, free, sign = [], 0, _SIGN.search(text)
    while sign:
        start = sign.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, sign.end())
        free = blank.start() if blank else len(text)
        found.append((start, free))
        sign = _SIGN.search(text, free)
    return found


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", token))


def _check(token: str) -> str:
    """Whether a number of a card's length passes its check."""
    digits = _digits(token)
    return str(_luhn(digits)) if 13 <= len(digits) <= 19 else "-"


def _keys(token: str) -> list[str]:
    """What makes another token a repetition of this one, or like it."""
    digits, found = _digits(token), []
    if len(digits) >= 7:
        found += [f"d{digits}", f"e{digits[-7:]}"]
    if "@" in token:
        found.append("l" + token.strip(_EDGE).split("@")[0].lower())
    elif len(token) > 4:
        found.append("l" + token.strip(_EDGE).lower())
    return found


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % HASHED


def _tails(token_digits: list[str]) -> list[str]:
    """Joined digits of the last one, two, ... of some neighbouring groups, of `ALIKE` digits to `LONGEST`."""
    found, joined = [], ""
    for digits in reversed(token_digits):
        joined = digits + joined
        if len(joined) > LONGEST:
            break
        if len(joined) >= ALIKE:
            found.append(joined)
    return found


class Graph:
    """Nodes and links of several texts at once."""

    def __init__(self):
        self.text, self.start, self.end, self.label = [], [], [], []
        self.features, self.chain, self.skip = [], [], []
        self.aligned: set[tuple[int, int]] = set()

    def add(self, number: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        first = len(self.start)
        nodes = _tokens(text)
        shapes = ["^", *(_shape(text[s:e]) for s, e in nodes), "$"]
        met: dict[str, int] = {}
        ended: dict[str, tuple[int, list[str]]] = {}
        groups: list[str] = []
        by_start = sorted(spans, key=lambda x: x[1])
        at = 0
        for k, (s, e) in enumerate(nodes):
            while at < len(by_start) and by_start[at][2] <= s:
                at += 1
            label, near = 0, at
            while not label and near < len(by_start) and by_start[near][1] < e:
                label = by_start[near][0] + 1 if s < by_start[near][2] else 0
                near += 1
            before = k > 0 and nodes[k - 1][1] + 1 >= s
            after = k + 1 < len(nodes) and e + 1 >= nodes[k + 1][0]
            token = text[s:e]
            plain = token.strip(_EDGE)
            self.features.append(
                [
                    _hash("s" + shapes[k + 1]),
                    _hash("p" + _shape(plain)),
                    _hash("b" + (shapes[k] if before else "-")),
                    _hash("a" + (shapes[k + 2] if after else "-")),
                    _hash(f"n{min(len(_digits(plain)), 20)}{'@' in plain}{plain[:1] == '+'}{min(plain.count('.'), 4)}"),
                    _hash("c" + _check(plain)),
                ]
            )
            here = len(self.start)
            self.text.append(number)
            self.start.append(s)
            self.end.append(e)
            self.label.append(label)
            if before:
                self.chain.append((here - 1, here))
            for key in _keys(token):
                if met.get(key, here) != here and (met[key], here) not in self.chain[-1:]:
                    self.skip.append((met[key], here))
                    self.aligned.add((met[key], here))
                met[key] = here
            digits = "" if _GROUP.search(token) else _digits(token)
            # Not more groups than the longest entity has digits.
            groups = [*(groups if before else [])[1 - LONGEST :], digits] if digits else []
            tails = _tails(groups)
            for key in dict.fromkeys([*(f"d{x}" for x in tails), *(f"e{x[-ALIKE:]}" for x in tails)]):
                if key in ended:
                    self._align(*ended[key], here, groups)
                ended[key] = here, groups
        assert len(self.start) - first == len(nodes)

    def _align(self, there: int, old: list[str], here: int, new: list[str]) -> None:
        """Link the groups of two runs that end alike, by the places of their digits from the end."""
        if len(old) == len(new) == 1:
            return
        a, b = "".join(old), "".join(new)
        same = 0
        while same < min(len(a), len(b), LONGEST) and a[-1 - same] == b[-1 - same]:
            same += 1
        i = j = at_a = at_b = 0
        while i < len(old) and j < len(new) and max(at_a, at_b) < same and there < here - j:
            link = (there - i, here - j)
            if link not in self.aligned:
                self.aligned.add(link)
                self.skip.append(link)
            end_a, end_b = at_a + len(old[-1 - i]), at_b + len(new[-1 - j])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b

    def arrays(self):
        links = lambda x: np.array(x, np.int64).reshape(-1, 2)
        return np.array(self.features, np.int64).reshape(-1, 6), np.array(self.label, np.int64), links(self.chain), links(self.skip)


def fit(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node weights and the two link matrices from texts labelled by the patterns."""
    graph = Graph()
    for number, text in enumerate(rows):
        graph.add(number, text, base_spans(text))
    features, label, chain, skip = graph.arrays()
    weights = np.zeros((HASHED, _LABELS))
    wanted = np.eye(_LABELS)[label] if len(label) else np.zeros((0, _LABELS))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, 121 if len(label) else 1):
        z = weights[features].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = 1e-4 * weights
        for k in range(features.shape[1]):
            for c in range(_LABELS):
                slope[:, c] += np.bincount(features[:, k], (p - wanted)[:, c], HASHED) / len(label)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)

    def association(links: np.ndarray) -> np.ndarray:
        joint = np.full((_LABELS, _LABELS), 1.0)
        np.add.at(joint, (label[links[:, 0]], label[links[:, 1]]), 1)
        joint /= joint.sum()
        return np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)))

    return weights, association(chain), association(skip)


def _heard_of(label: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The skip links of groups of linked nodes in which a pattern labels at least one: repetition alone is no evidence."""
    group = np.arange(len(label))
    while True:
        least = group.copy()
        np.minimum.at(least, skip[:, 0], group[skip[:, 1]])
        np.minimum.at(least, skip[:, 1], group[skip[:, 0]])
        least = least[least]
        if (least == group).all():
            break
        group = least
    known = np.zeros(len(label), bool)
    known[group[label > 0]] = True
    return skip[known[group[skip[:, 0]]]]


def marginals(graph: Graph, weights: np.ndarray, chain_weights: np.ndarray, skip_weights: np.ndarray) -> np.ndarray:
    """Label probabilities of all nodes, by damped sum-product messages over all links."""
    features, label, chain, skip = graph.arrays()
    node = weights[features].sum(axis=1)
    node -= node.max(axis=1, keepdims=True)
    node[label > 0] -= _HOLD
    node[np.flatnonzero(label > 0), label[label > 0]] += 2 * _HOLD
    skip = _heard_of(label, skip)
    # Nodes that share several keys have one link of their joint weight: parallel links would feed messages back.
    skip, times = np.unique(skip, axis=0, return_counts=True)
    ends = np.concatenate([chain, skip])
    table = np.concatenate([np.repeat(np.exp(chain_weights)[None], len(chain), 0), np.exp(times[:, None, None] * skip_weights)])
    tail = np.concatenate([ends[:, 0], ends[:, 1]])
    head = np.concatenate([ends[:, 1], ends[:, 0]])
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    half = len(ends)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    sent = np.zeros((2 * half, _LABELS))

    def settle() -> None:
        """Rounds over the links of texts whose messages still change."""
        of_text = np.array(graph.text, np.int64)[tail]
        depth = np.zeros(len(node), np.int64)
        for low, high in sorted(map(tuple, np.sort(ends, axis=1).tolist()), key=lambda x: x[1]):
            depth[high] = max(depth[high], depth[low] + 1)
        # A message goes one link a round.
        limit = _LEAST_ROUNDS + _ROUNDS_PER_LINK * int(depth.max())
        mine, nodes = np.arange(2 * half), np.arange(len(node))
        own, t, h, back_to, weight, s = node, tail, head, back, table, sent
        for number in range(1, limit + 1):
            cavity = (own + np.stack([np.bincount(h, s[:, c], len(own)) for c in range(_LABELS)], axis=1))[t] - s[back_to]
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ij,ijk->ik", cavity, weight) + 1e-300)
            new = 0.5 * s + 0.5 * (new - new.max(axis=1, keepdims=True))
            change, s = np.abs(new - s).max(axis=1), new
            sent[mine] = s
            if number % 8 and number < limit:
                continue
            moved = np.zeros(int(of_text[mine].max()) + 1, bool)
            moved[of_text[mine[change >= _SETTLED]]] = True
            stay = moved[of_text[mine]]
            if not stay.any():
                return
            if stay.mean() < 0.8:
                mine = mine[stay]
                nodes = np.unique(tail[mine])
                place = np.full(2 * half, -1)
                place[mine] = np.arange(len(mine))
                own, t, h = node[nodes], np.searchsorted(nodes, tail[mine]), np.searchsorted(nodes, head[mine])
                back_to, weight, s = place[back[mine]], table[mine], s[stay]

    def heard() -> np.ndarray:
        return node + np.stack([np.bincount(head, sent[:, c], len(node)) for c in range(_LABELS)], axis=1)

    if half:
        settle()
    belief = heard()
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def find(parts: list[str], model: tuple) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, by kind and start."""
    base = [base_spans(text) if _SIGN.search(text) else [] for text in parts]
    graph = Graph()
    for number, text in enumerate(parts):
        if _SIGN.search(text):
            graph.add(number, text, base[number])
    every = [list(spans) for spans in base]
    if graph.start:
        share = marginals(graph, *model)
        best = share[:, 1:].argmax(axis=1) + 1
        for k in np.flatnonzero((share[np.arange(len(best)), best] >= SURE) & (np.array(graph.label) == 0)).tolist():
            number, s, e = graph.text[k], graph.start[k], graph.end[k]
            token = parts[number][s:e]
            s, e = s + len(token) - len(token.lstrip(_EDGE)), e - (len(token) - len(token.rstrip(_EDGE)))
            if s < e:
                every[number].append((int(best[k]) - 1, s, e))
    return [(spans, sorted(more)) for spans, more in zip(base, every)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for kind, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def fitted(docs: DataFrame, text_col: str = "text", sample: int = 4000):
    """A model from at most `sample` texts that hold a digit or an at sign, in the order of a hash of the text; broadcast."""
    some = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("h")).distinct().orderBy("h").limit(sample)
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(F.broadcast(some), "h").dropDuplicates(["h"])
    found = rows.orderBy("h").limit(sample).select("text").collect()
    return docs.sparkSession.sparkContext.broadcast(fit([row.text for row in found]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, with_text: bool = False) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans for every row; with_text adds the redacted text."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = fitted(docs, sample=sample)
    counts = [f"n_{kind}" for kind in KINDS]
    schema = "doc_id bigint, " + "".join(f"{c} bigint, " for c in counts) + "base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches):
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                parts = [x or "" for x in batch.column(1).to_pylist()]
                found = find(parts, model.value)
                columns = [batch.column(0)]
                columns += [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
                columns.append(pa.array([joined(every) for _, every in found], pa.string()))
                if with_text:
                    columns.append(pa.array([None if raw is None else redacted(raw, every) for raw, (_, every) in zip(batch.column(1).to_pylist(), found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_sha256", "spans", *(["text"] if with_text else [])])

    return docs.mapInArrow(run, schema + (", text string" if with_text else ""))


def redacted_rows(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars, where there is one, brought up to date."""
    model = fitted(docs, sample=sample)
    text_at = docs.columns.index("text")
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches):
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw = batch.column(text_at).to_pylist()
                found = find([x or "" for x in raw], model.value)
                clean = [x if x is None or not spans else redacted(x, spans) for x, (_, spans) in zip(raw, found)]
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(clean, batch.column(text_at).type))
                if length_at is not None:
                    old = batch.column(length_at)
                    sizes = [n if x is y else len(y) for x, y, n in zip(raw, clean, old.to_pylist())]
                    batch = batch.set_column(length_at, batch.schema.field(length_at), pa.array(sizes, old.type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
