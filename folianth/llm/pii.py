"""Personal data by rules and a skip-chain conditional random field over their candidates (operator 9)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folianth.llm.blocks import small_batches

#: Kinds in the order in which ties are listed.
KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the query's contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What is scanned instead: quantifiers that give nothing back, so that long runs cost time in proportion.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
#: What may be personal data in another spelling: an address with its sign written out, or a long run of digits.
_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_DIGITS = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])*+")
_SOME = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
LEAST_DIGITS, MOST_DIGITS = 8, 19

#: Labels are the kinds and none.
NONE = len(KINDS)
LABELS = NONE + 1
#: The shape of words beside candidates; up to so many on each side are nodes, looked for in so many characters.
WORD, BESIDE, NEAR = "word", 2, 200
#: Before any evidence like tokens share their label by this log odds; the prior's precision, for every weight.
AGREE, PRECISION = 2.0, 0.5
#: Messages pass until they change by less than this, or so many times; then settled is false.
SETTLED, MOST_ROUNDS = 1e-6, 500


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local_start(text: str, done: int, at: int) -> int:
    """Where the run of an address's characters begins that ends before `at`."""
    while at > done and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str):
    """Matches of EMAIL, from each @ backwards and forwards."""
    at, done = text.find("@"), 0
    while at >= 0:
        start, domain = _local_start(text, done, at), _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    """Matches of IP: four parts after four parts of each run of parts."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                yield at, end, parts[i : i + 4]
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's spans: leftmost matches of each kind, failing ones dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for a, b, parts in _ips(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in parts):
            out.append((a, 1, b))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 2 * MOST_DIGITS:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(text: str) -> str:
    """What two spellings of one value share: its digits, or the address in lower case with its sign."""
    if "@" in text or not text[-1:].isdigit():
        return re.sub(r" ?[(\[]at[)\]] ?", "@", text.lower())
    return re.sub("[^0-9]", "", text)


def shape(text: str) -> str:
    """What a candidate looks like; the field learns what shapes say of labels."""
    if "@" in text or not text[-1:].isdigit():
        return "address"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text):
        return "four parts"
    digits = re.sub("[^0-9]", "", text)
    n = len(digits)
    check = " checked" if n >= 14 and luhn(digits) else ""
    return f"{'+' * (text[0] == '+')}{n} digits{check}"


class Node(NamedTuple):
    start: int
    end: int
    kind: int  # of a base span, else -1
    shape: str
    key: str


def candidates(text: str) -> list[Node]:
    """The base spans, and other tokens that might be data: spelled-out addresses and runs of digits with no letter at
    either side; a run of too many digits is taken word by word."""
    base = base_spans(text)
    found = [(a, b, kind) for a, kind, b in base]
    other = []
    done = 0
    for m in _AT.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start, domain = _local_start(text, done, stop), _DOMAIN.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))
        if start < stop and domain:
            other.append((start, domain.end()))
            done = domain.end()
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < LEAST_DIGITS:
            continue
        n = sum("0" <= c <= "9" for c in m[0])
        parts = [(m.start(), m.end())] if n <= MOST_DIGITS else [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"[^\x20]+", m[0])]
        for a, b in parts:
            if LEAST_DIGITS <= sum("0" <= c <= "9" for c in text[a:b]) <= MOST_DIGITS and not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum():
                other.append((a, b))
    taken, i, last = sorted((a, b) for a, b, _ in found), 0, -1
    for a, b in sorted(other):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            found.append((a, b, -1))
            last = b
    return [Node(a, b, kind, shape(text[a:b]), _key(text[a:b])) for a, b, kind in sorted(found)]


class Graph(NamedTuple):
    """Candidates and the words beside them in their order. chain: numbers of neighbours; group: members of each value."""

    nodes: list[Node]
    chain: list[tuple[int, int]]
    groups: list[list[int]]


def graph(text: str) -> Graph:
    """Chain edges join neighbouring tokens; tokens with the same value, or the same last nine digits, are a group."""
    nodes: list[Node] = []
    chain: list[tuple[int, int]] = []

    def words(n: int, joined: bool) -> None:
        for k in range(n):
            if k or joined:
                chain.append((len(nodes) - 1, len(nodes)))
            nodes.append(Node(-1, -1, -1, WORD, ""))

    at = 0
    for node in candidates(text):
        between = text[at : node.start] if node.start - at <= NEAR else None
        n = 2 * BESIDE if between is None else sum(any(c.isalnum() for c in w) for w in between.split())
        if not nodes:
            words(min(n, BESIDE), False)
            joined = n > 0
        elif n < 2 * BESIDE:
            words(n, True)
            joined = node.start >= at
        else:
            words(BESIDE, True)
            words(BESIDE, False)
            joined = True
        if joined:
            chain.append((len(nodes) - 1, len(nodes)))
        nodes.append(node)
        at = max(at, node.end)
    if nodes:
        words(min(BESIDE, len(text[at : at + NEAR].split())), True)
    by: dict[str, list[int]] = defaultdict(list)
    for i, node in enumerate(nodes):
        if node.key:
            for name in {"=" + node.key} | ({"~" + node.key[-9:]} if node.key.isdigit() and len(node.key) >= 10 else set()):
                by[name].append(i)
    return Graph(nodes, chain, [g for _, g in sorted(by.items()) if len(g) > 1])


class Field:
    """The field's weights: of labels by shape, of labels of neighbours, and of like tokens' sharing a label."""

    def __init__(self, shapes: dict[str, np.ndarray], chain: np.ndarray, agree: float):
        self.shapes, self.chain, self.agree = shapes, chain, agree

    @classmethod
    def fit(cls, texts) -> Field:
        return cls.of_counts(field_counts(texts))

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, int, int, int, int], int]) -> Field:
        """The weights of the greatest pseudo-likelihood of the counted tokens, under a Gaussian prior, by gradient ascent.

        counts: how often a token of a shape, with labels before, behind and of its like (LABELS for none there), has a
        label. All tokens count, so the weights are those of the whole table, in a loop over the different cases only.
        """
        names = sorted({k[0] for k in counts})
        x, agree = np.zeros((len(names), LABELS)), AGREE
        chain = np.zeros((LABELS + 1, LABELS + 1))
        if counts:
            cases = sorted(counts)
            of = np.searchsorted(names, [k[0] for k in cases])
            before, behind, like, label = np.array([k[1:] for k in cases], np.int64).T
            n = np.array([counts[k] for k in cases], float)
            n /= max(1.0, n.sum() / 1000)  # so many tokens are evidence enough
            every = np.arange(LABELS)
            same = (like[:, None] == every).astype(float)
            steps = [np.full(x.shape, 1e-3), np.full(chain.shape, 1e-3), 1e-3]
            for _ in range(400):
                z = x[of] + chain[before][:, :LABELS] + chain[:LABELS, behind].T + agree * same
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = n[:, None] * ((label[:, None] == every) - p)
                gx, gc = -PRECISION * x, -PRECISION * chain
                np.add.at(gx, of, d)
                np.add.at(gc[:, :LABELS], before, d)
                np.add.at(gc.T[:, :LABELS], behind, d)
                ga = float((d * same).sum()) - PRECISION * (agree - AGREE)
                for k, g in enumerate((gx, gc, ga)):
                    steps[k] = steps[k] + g * g
                x, chain, agree = x + gx / np.sqrt(steps[0]), chain + gc / np.sqrt(steps[1]), agree + ga / np.sqrt(steps[2])
        return cls({s: x[i] for i, s in enumerate(names)}, chain[:LABELS, :LABELS], float(agree))


def field_counts(texts) -> Counter:
    """How often each case of Field.of_counts occurs. A token that no base pattern labels, but that is like one that a
    pattern does, isn't known to be none and doesn't count."""
    out: Counter = Counter()
    for text in texts:
        g = graph(text)
        label = [NONE if v.kind < 0 else v.kind for v in g.nodes]
        before, behind, like = ([LABELS] * len(label) for _ in range(3))
        for i, j in g.chain:
            behind[i], before[j] = label[j], label[i]
        for members in g.groups:
            n = Counter(label[i] for i in members)
            for i in members:
                rest = n - Counter([label[i]])
                if rest and like[i] in (LABELS, NONE):
                    like[i] = min(rest, key=lambda y: (y == NONE, -rest[y], y))
        for v, *case in zip(g.nodes, before, behind, like, label, strict=True):
            if not (case[3] == NONE and case[2] < NONE):
                out[v.shape, *case] += 1
    return out


def beliefs(local: np.ndarray, edges: list[tuple[int, int]], weights: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Log marginals of each variable by loopy message passing, and whether the messages settled; exact on trees.

    local: log potentials; weights: a table of log potentials for each edge (a, b), labels of a in its rows."""
    if not edges:
        return local - _log_sum(local)[:, None], True
    a, b = np.array(edges, np.int64).T
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    tables = np.stack(weights)
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), local.shape[1]))
    for rounds in range(MOST_ROUNDS):
        total = local.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + tables
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        if rounds >= 50:  # what swings is slowed down
            new = (new + message) / 2
        settled = bool(np.abs(new - message).max() < SETTLED)
        message = new
        if settled:
            break
    total = local.copy()
    np.add.at(total, target, message)
    return total - _log_sum(total)[:, None], settled


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def added_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], bool]:
    """Spans (start, kind number, end) that the field adds to the base, and whether the messages settled.

    Base spans are sure. The members of a group share the label of a variable of their own, so a value of many copies
    costs an edge each. Each other candidate takes its most likely label.
    """
    g = graph(text)
    if all(v.kind >= 0 for v in g.nodes if v.shape != WORD):
        return [], True
    local = np.zeros((len(g.nodes) + len(g.groups), LABELS))
    for i, v in enumerate(g.nodes):
        if v.kind >= 0:
            local[i] = -50.0
            local[i, v.kind] = 0.0
        elif v.shape in field.shapes:
            local[i] = field.shapes[v.shape]
    shared = [(i, len(g.nodes) + k) for k, members in enumerate(g.groups) for i in members]
    weights = [field.chain] * len(g.chain) + [field.agree * np.eye(LABELS)] * len(shared)
    belief, settled = beliefs(local, g.chain + shared, weights)
    top = belief.argmax(axis=1).tolist()
    return [(v.start, y, v.end) for v, y in zip(g.nodes, top, strict=False) if v.kind < 0 and v.shape != WORD and y != NONE], settled


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    parts, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def fit_field(docs: DataFrame) -> Field:
    """The field of the counts over the candidates of all documents. Only the different cases come to the driver: shapes
    (some 40) by 6 x 6 x 6 labels around them by 5 of their own bound these."""

    def evidence(batches):
        total: Counter = Counter()
        for batch in batches:
            total += field_counts(t for t in batch.column(0).to_pylist() if t and _SOME.search(t))
        rows = list(total.items())
        columns = [pa.array([k[0] for k, _ in rows], pa.string())] + [pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(1, 5)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in rows], pa.int64())], ["shape", "before", "behind", "alike", "label", "n"])

    texts = small_batches(docs).select(F.col("text").cast("string").alias("text"))
    case = ["shape", "before", "behind", "alike", "label"]
    counts = texts.mapInArrow(evidence, "shape string, before int, behind int, alike int, label int, n long").groupBy(*case).agg(F.sum("n").alias("n"))
    return Field.of_counts({tuple(r[c] for c in case): r.n for r in counts.collect()})


def personal_data(docs: DataFrame, field: Field | None = None, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, settled, and on request the
    redacted text and the columns to carry along. settled: whether the document's messages did.

    Counts and base_sha256 are of the base spans, spans holds those and what the field adds. Places are code points, ends
    exclusive. Null and empty texts have no spans and the digest of nothing; rows without a doc_id and repeated rows are
    judged each, an empty table gives no rows; other columns are ignored. The field is fitted on all documents where none
    is given. Very long texts and runs of one character cost time in proportion to their length.
    """
    field = field or fit_field(docs)
    kept = {"field": field}

    def run(batches):
        field = kept["field"]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text) if (some := _SOME.search(text)) else []
                more, settled = added_spans(text, field) if some else ([], True)
                spans = base + more
                n = Counter(k for _, k, _ in base)
                out.append((doc, n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), settled, redact(text, spans) if with_text else None))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.bool_(), pa.string()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "settled", "redacted"]
            columns = [pa.array([r[i] for r in out], types[i]) for i in range(8 + with_text)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [*names[: 8 + with_text], *carried])

    carried = [f"carried_{c}" for c in carry or []]
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry or [], carried, strict=True)])
    schema = StructType.fromDDL("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, settled boolean" + ", redacted string" * with_text)
    out = rows.mapInArrow(run, StructType([*schema, *rows.schema[2:]]))
    return out.withColumnsRenamed(dict(zip(carried, carry or [], strict=True)))
