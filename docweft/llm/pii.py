"""Personal data: exact base patterns, plus candidates that boosted trees accept.

Base spans (email, ip, card, phone) are always kept. High-recall generators then propose more spans, overlapping each other
and the base: addresses written out (``name (at) host dot com``), card-length digit groups, phone numbers without a plus or
with extensions, and loosely punctuated ip addresses. Gradient-boosted trees score each by its format (digits, separators,
grouping, checksum, length) and its context (words before and after). Their scores are calibrated per kind on held-out
candidates (Platt's scaling), a threshold per kind selects at a wanted precision, and overlaps go to the better score.

The trees are fitted on candidates in two kinds of context. Around base matches of a bounded sample of documents
(``SAMPLE_DOCS``), the match is rewritten into a disguised form (positive) or spoiled into a look-alike: a broken checksum, a
part above 255, a span of prose (hard negative). Where documents hold few base matches, made-up candidates fill up.

Defined cases: null and empty texts have no spans; very long texts are read whole; repeated rows give repeated rows; null
ids stay null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.session import table

#: Kinds in order, base patterns, context words of each kind.
KINDS = ["email", "ip", "card", "phone"]
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = {
    "email": "mail email e-mail contact write reach address courriel correo",
    "ip": "ip host server address addr client login from adresse",
    "card": "card visa mastercard amex credit debit payment pan cvv carte karte tarjeta",
    "phone": "phone tel telephone call mobile cell fax whatsapp contact dial téléphone telefon teléfono",
}
AGAINST = "order invoice isbn version figure page section part id number no ref total sum date year build serial".split()
#: Generators of further candidates, by kind.
WRITTEN = re.compile(r"\b([A-Za-z0-9._%+-]{1,64})[ ]?(?:\(at\)|\[at\]|\{at\}|<at>| at )[ ]?([A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot )[ ]?[A-Za-z0-9-]{1,63})+)", re.I)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?\.[ ]?|[ ]?\[\.\][ ]?|\(\.\)|,)[0-9]{1,3}(?:[ ]?\.[ ]?|[ ]?\[\.\][ ]?|\(\.\)|,)[0-9]{1,3}(?:[ ]?\.[ ]?|[ ]?\[\.\][ ]?|\(\.\)|,)[0-9]{1,3}(?![0-9.])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+@.])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?0?[0-9]{2,4}\)?[ ./-][0-9]{2,4}[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){0,2}(?![0-9A-Za-z@])")
GENERATORS = [("email", WRITTEN), ("ip", LOOSE_IP), ("card", LOOSE_CARD), ("phone", LOOSE_PHONE)]
CONTEXT = 32
#: Parameters of the trees and of the labelled candidates: made-up ones, documents sampled for contexts, base matches used of them.
TREES, DEPTH, RATE, LEAST = 40, 3, 0.2, 12
LABELLED = 3000
SAMPLE_DOCS = 2000
SAMPLE_MATCHES = 600
PRECISION = 0.98
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, by start and kind.

    An email is found at its ``@``: its local part is the longest run before it that no earlier email covers, which is the
    leftmost match of the whole pattern without trying every start.
    """
    out, last = [], 0
    if "@" in text:
        for m in HOST.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` that the generators propose, overlaps included."""
    out = []
    for kind, pattern in GENERATORS:
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = _digits(span)
    near = set(re.findall(r"[^\W\d_]+", before))
    wanted = set(WORDS[KINDS[kind]].split())
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    separators = re.findall(r"[^0-9A-Za-z]+", span)
    return [
        float(kind),
        float(len(span)),
        float(len(digits)),
        len(digits) / max(1, len(span)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(len(set(separators))),
        float(luhn(digits)) if digits else 0.0,
        float(all(int(g) <= 255 for g in re.findall(r"[0-9]{1,4}", span))) if kind == 1 else 0.0,
        float(bool(re.search(r"\(at\)|\[at\]|\{at\}|<at>", span, re.I))),
        float(bool(re.search(r"\(dot\)|\[dot\]|\{dot\}|<dot>", span, re.I))),
        float(bool(re.search(r"\b(com|org|net|edu|gov|io|de|fr|es|uk)\W*$", span.lower()))),
        float(bool(near & wanted)),
        float(any(w in near for w in AGAINST)),
        float(before.rstrip().endswith((":", "=", "#"))),
        float(bool(after[:1]) and (after[0].isalnum() or after[0] in "_-/")),
        float("(" in span),
        float(span.startswith(("0", "(0"))),
    ]


def labelled_candidates(rows: int = LABELLED, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made-up candidates: real formats in speaking context against look-alikes."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(["re", "tion", "ver", "ung", "que", "os", "ment", "la", "th", "er"], 3))

    def card(n: int) -> str:
        head = "4" + number(n - 2)
        return next(head + str(c) for c in range(10) if luhn(head + str(c)))

    x, y = [], []
    while len(x) < rows:
        kind, good = int(rng.integers(4)), bool(rng.integers(2))
        cue = rng.choice(WORDS[KINDS[kind]].split()) + rng.choice([": ", " ", " = "])
        plain = word() + rng.choice([" ", ", "])
        other = rng.choice(AGAINST) + rng.choice([" ", ": ", " #"])
        if kind == 0:
            at, dot = rng.choice([" (at) ", "[at]", " at "]), rng.choice([" (dot) ", "[dot]", " dot "])
            if good:
                marked = "(" in at or "[" in at
                span = word() + at + word() + dot + rng.choice(["com", "org", "net", "de"])
                lead = rng.choice([cue, plain]) if marked else cue
            else:
                span, lead = word() + " at " + word() + " dot " + word(), rng.choice([plain, other])
        elif kind == 1:
            parts = [str(v) for v in rng.integers(0, 256 if good else 999, 4)]
            span, lead = rng.choice(["[.]", "(.)"] if good else [",", " . ", ", "]).join(parts), rng.choice([cue, plain] if good else [plain, other])
        elif kind == 2:
            digits = card(16) if good else number(16)
            sep = rng.choice([" ", "-", ".", "/", "_"])
            span, lead = sep.join(digits[i : i + 4] for i in range(0, 16, 4)), cue if good else rng.choice([plain, other])
        else:
            sep = rng.choice([" ", "-", ".", "/"])
            if good:
                span, lead = rng.choice([f"({number(3)}) {number(3)}{sep}{number(4)}", f"0{number(2)}{sep}{number(3)}{sep}{number(4)}", f"00{rng.integers(1, 99)}{sep}{number(3)}{sep}{number(3)}{sep}{number(3)}"]), cue
            else:
                span, lead = sep.join(number(int(n)) for n in rng.integers(2, 5, 3)), rng.choice([plain, other])
        text = f"{word()} {lead}{span}{rng.choice([' ', '.', ', '])}{word()}"
        start = text.index(span)
        hits = [c for c in candidates(text) if c[1] == kind and c[0] < start + len(span) and c[2] > start]
        for hit in hits[:1]:
            x.append(features(text, *hit))
            y.append(float(good))
    return np.array(x), np.array(y)


def disguised(kind: int, span: str, rng: np.random.Generator) -> str:
    """A base match in a form that the base patterns miss and a reader still understands."""
    if kind == 0:
        name, host = span.split("@", 1)
        at, dot = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), ("{at}", "{dot}")][rng.integers(4)]
        return name.replace("+", "") + at + host.replace(".", dot if dot != "." else "(dot)")
    digits = _digits(span)
    if kind == 1:
        return ["[.]", "(.)"][rng.integers(2)].join(span.split("."))
    if kind == 2:
        return [".", "/", "_", " - "][rng.integers(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"00{digits[:-10]} {local[:3]} {local[3:6]} {local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}"][rng.integers(3)]


def spoiled(kind: int, span: str, rng: np.random.Generator) -> str:
    """A look-alike of a base match that is none."""
    if kind == 0:
        host = span.split("@", 1)[1].split(".")
        return f"{span[:3].strip('.') or 'we'} at {host[0]} dot {host[-1]}{'ted' if rng.integers(2) else ' '}"
    digits = _digits(span)
    if kind == 1:
        parts = [p.zfill(1) for p in span.split(".")]
        parts[rng.integers(4)] = str(rng.integers(256, 999))
        return ["[.]", ",", " . "][rng.integers(3)].join(parts)
    if kind == 2:
        broken = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        return [" ", ".", "/", "-"][rng.integers(4)].join(broken[i : i + 4] for i in range(0, len(broken), 4))
    return ["-", ".", " "][rng.integers(3)].join([digits[:2], digits[2:5], digits[5:8], digits[8:10]][: int(rng.integers(3, 5))])


def matches_in_context(texts: list[str], most: int = SAMPLE_MATCHES) -> list[tuple[int, str, str, str]]:
    """``(kind, before, match, after)`` of base matches, as many of each kind as there are up to ``most // 4``."""
    found: list[list] = [[], [], [], []]
    for text in texts:
        for start, kind, end in base_spans(text):
            if len(found[kind]) < most // 4:
                found[kind].append((kind, text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]))
    return [m for of_kind in found for m in of_kind]


def contextual_candidates(matches: list[tuple[int, str, str, str]], seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in the documents' own contexts, with a cue word before some of them."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for kind, before, span, after in matches:
        for good in (True, False):
            shown = (disguised if good else spoiled)(kind, span, rng)
            cue = (str(rng.choice(WORDS[KINDS[kind]].split())) if good else str(rng.choice(AGAINST))) + ": " if rng.integers(2) or (good and kind == 3) else ""
            text = f"{before}{cue}{shown}{after}"
            start = len(before) + len(cue)
            hits = [c for c in candidates(text) if c[1] == kind and c[0] < start + len(shown) and c[2] > start]
            for hit in hits[:1]:
                x.append(features(text, *hit))
                y.append(float(good))
    return np.array(x), np.array(y)


class Boosted:
    """Logistic gradient boosting over depth-limited trees, with exact split scans; calibration and threshold per kind."""

    def __init__(self):
        self.start, self.trees = 0.0, []
        self.scaling = [(1.0, 0.0)] * len(KINDS)
        self.thresholds = [1.1] * len(KINDS)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = -g.sum() / (h.sum() + 1.0)
        if depth == 0 or len(g) < 2 * LEAST:
            return value
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut >= LEAST - 1) & (cut < len(v) - LEAST)]
            if not len(cut):
                continue
            gain = cg[cut] ** 2 / (ch[cut] + 1.0) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1.0) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] is None:
            return value
        left = x[:, best[1]] < best[2]
        return best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of being personal data; the first feature is the kind."""
        slope, shift = np.array(self.scaling)[x[:, 0].astype(int)].T
        return 1 / (1 + np.exp(-(slope * self.raw(x) + shift)))

    def accepts(self, x: np.ndarray) -> np.ndarray:
        return self.chance(x) >= np.array(self.thresholds)[x[:, 0].astype(int)]

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> "Boosted":
        """Trees on three quarters of the rows; calibration and thresholds on the rest."""
        held = np.random.default_rng(3).permutation(len(y)) % 4 == 3
        tx, ty = x[~held], y[~held]
        mean = np.clip(ty.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(len(ty), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(tx, p - ty, p * (1 - p), DEPTH)
            self.trees.append(tree)
            raw += RATE * self._walk(tree, tx)
        score = self.raw(x)
        for kind in range(len(KINDS)):
            rows = held & (x[:, 0] == kind)
            if y[rows].min(initial=1) == y[rows].max(initial=0):
                continue
            self.scaling[kind] = platt(score[rows], y[rows])
            chance, truth = self.chance(x[rows]), y[rows]
            order = np.argsort(-chance, kind="stable")
            kept = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
            last_of_value = np.append(chance[order][1:] < chance[order][:-1], True)
            enough = np.flatnonzero((kept >= precision) & last_of_value)
            if len(enough):
                self.thresholds[kind] = float(max(0.5, chance[order[enough[-1]]]))
        return self


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through ``score``, by Newton's steps on smoothed labels."""
    good = y.sum()
    wanted = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * score + b)))
        g = np.array([((p - wanted) * score).sum(), (p - wanted).sum()])
        w = p * (1 - p)
        h = np.array([[(w * score * score).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
    return float(a), float(b)


def train(docs: DataFrame | None = None, text: str = "text") -> Boosted:
    """The trees on made-up candidates and on those in the contexts of at most ``SAMPLE_DOCS`` documents, in hash order."""
    x, y = labelled_candidates()
    if docs is not None:
        likely = docs.where(F.col(text).rlike("[0-9]{3}|@")).select(F.col(text).alias("text")).orderBy(F.xxhash64("text")).limit(SAMPLE_DOCS)
        cx, cy = contextual_candidates(matches_in_context([r["text"] for r in likely.collect()]))
        if len(cy):
            x, y = np.concatenate([x, cx]), np.concatenate([y, cy])
    return Boosted().fit(x, y)


def all_spans(text: str, model: Boosted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with accepted candidates; a candidate that meets a base or better span is dropped."""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base, base
    taken = sorted((s, e) for s, _, e in base)
    free = [c for c in found if all(c[2] <= s or e <= c[0] for s, e in taken)] if len(taken) * len(found) < 10_000 else _free(found, taken)
    if not free:
        return base, base
    seen = np.array([features(text, *c) for c in free])
    chance, good = model.chance(seen), model.accepts(seen)
    chosen: list[tuple[int, int, int]] = []
    last: list[tuple[int, int]] = []
    for i in np.lexsort((np.arange(len(free)), -chance)):
        c = free[i]
        if good[i] and _free([c], last):
            chosen.append(c)
            insort(last, (c[0], c[2]))
    return base, sorted(base + chosen)


def _free(found: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that meet none of the sorted spans."""
    out = []
    for c in found:
        i = bisect_left(taken, (c[2], -1))
        if not any(e > c[0] for _, e in taken[max(0, i - 4) : i]):
            out.append(c)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _finder(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            counts, digests, lists = [[], [], [], []], [], []
            for i in range(batch.num_rows):
                base, every = all_spans(texts[i].as_py() or "", model)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                names=[f.split(" ")[0] for f in SCHEMA.split(", ")],
            )

    return run


def find(docs: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, for every row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_finder(model or train(read)), SCHEMA)


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find(table(spark, sf_dir, "documents"))
