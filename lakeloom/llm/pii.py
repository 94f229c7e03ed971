"""PII: a semi-Markov conditional random field over candidate segments, beside exact patterns.

Patterns give the base spans (email, ip, card, phone), which always stay. Around digits and at-signs the text is cut
into islands of all tokens that a segment with such a mark could reach; candidate segments of at most MAX_TOKENS
tokens, clear of base spans, are described by whole-span features, and dynamic programming over the island chooses boundaries and types jointly (the best sequence
of segments, everything else outside). What it finds is added. Outside of candidates the score is zero, so islands
are independent and a text takes time in proportion to its length.

The field is fitted by conditional likelihood (forward and backward sums over segments) on islands around base spans
and on rewritten forms of them (no plus sign, other separators, spaced at-signs), and on islands without any: at most
TRAIN_ISLANDS of each, from documents chosen by a hash of their id, whatever their length. Without any, nothing is added.
The sums of all islands of the sample run side by side, a token place at a time.

Defined cases: null is an empty text; texts without digits and at-signs have no spans; repeated rows give a row each;
null ids are allowed; an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.llm.common import carried, carried_schema, columns, lean, table, with_carried

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, TRAIN_DOCUMENTS, TRAIN_ISLANDS = 16, 4000, 300
FOUND = "base array<struct<kind:string,a:int,b:int>>, added array<struct<kind:string,a:int,b:int>>"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# the guard before the first digit changes no match: within a run of digits a later start fails as an earlier one does
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
AROUND_AT = re.compile(r"\s*@\s*")
MARK = re.compile(r"[0-9@]")
RUN = re.compile(r"[0-9]+|@")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
CUES = {"email": re.compile(r"(?i)mail|write|contact"), "ip": re.compile(r"(?i)\bip\b|host|server|address"), "card": re.compile(r"(?i)card|visa|account|pay"), "phone": re.compile(r"(?i)phone|tel|call|mobile|fax")}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then by start; leftmost and not overlapping within a kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and LOCAL.match(text, a - 1):
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        else:
            last = max(last, a)
        at = text.find("@", max(at + 1, last))
    if MARK.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- islands, candidates, features


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def tokens_back(text: str, p: int, n: int) -> int:
    """Where the n tokens before p begin."""
    while n and p:
        same = _letter if _letter(text[p - 1]) else (lambda c: "0" <= c <= "9") if "0" <= text[p - 1] <= "9" else None
        p -= 1
        while same and p and same(text[p - 1]):
            p -= 1
        n -= 1
    return p


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of MAX_TOKENS - 1 tokens to both sides of each run of marks; those that touch join.

    What holds no candidate, with fewer than four digits and no at-sign, is left out.
    """
    out: list[list[int]] = []
    for m in RUN.finditer(text):
        a, b = tokens_back(text, m.start(), MAX_TOKENS - 1), m.end()
        for _ in range(MAX_TOKENS - 1):
            if b == len(text):
                break
            b = TOKEN.match(text, b).end()
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if text.find("@", a, b) >= 0 or len(digits_of(text[a:b])) >= 4]


FEATURES = 26


def features(text: str, a: int, b: int, kinds=KINDS) -> list[int]:
    """Indices of the features that hold for the span; the same for all kinds, which have weights of their own."""
    s = text[a:b]
    d = digits_of(s)
    n, f = len(d), [0]
    f.append(1 + (n < 7) * 0 + (7 <= n <= 9) + 2 * (10 <= n <= 11) + 3 * (12 <= n <= 15) + 4 * (16 <= n <= 19) + 5 * (n > 19))
    if "@" in s:
        f.append(7 if s.count("@") == 1 else 8)
        if EMAIL_WHOLE.fullmatch(AROUND_AT.sub("@", s)):
            f.append(9)
    elif any(c.isalpha() for c in s):
        f.append(10)
    if n >= 16 and luhn(d):
        f.append(11)
    if s[0] == "+":
        f.append(12)
    if "(" in s and ")" in s:
        f.append(13)
    groups = re.findall(r"[0-9]+", s)
    if s.count(".") == 3 and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        f.append(14)
    if len(groups) >= 3 and all(2 <= len(g) <= 4 for g in groups[-3:]):
        f.append(15)
    if " " in s:
        f.append(16)
    if "-" in s:
        f.append(17)
    if not (s[-1].isalnum() and (s[0].isalnum() or s[0] in "+(")):
        f.append(18)
    if a and (text[a - 1].isalnum() or text[a - 1] in "+.@-_"):
        f.append(19)
    if b < len(text) and (text[b].isalnum() or text[b] in "@_" or (text[b] in ".-" and b + 1 < len(text) and text[b + 1].isalnum())):
        f.append(20)
    if any(not (c.isalnum() or c in " .+-()@_%") for c in s):
        f.append(21)
    before = text[max(0, a - 20) : a]
    return f + [22 + k for k, kind in enumerate(kinds) if CUES[kind].search(before)]


def candidates(text: str, a: int, b: int, taken: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token bounds of the island, and segments (first token, token after the last, features) clear of taken spans."""
    bounds = [a, *[m.end() for m in TOKEN.finditer(text, a, b)]]
    blocked = [any(x < bounds[i + 1] and bounds[i] < y for x, y in taken) for i in range(len(bounds) - 1)]
    out = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if blocked[i] or not (first.isalnum() or first in "+("):
            continue
        digits, at = 0, False
        for j in range(i + 1, min(i + MAX_TOKENS, len(bounds) - 1) + 1):
            if blocked[j - 1]:
                break
            piece = text[bounds[j - 1] : bounds[j]]
            digits += len(piece) if "0" <= piece[0] <= "9" else 0
            at = at or piece == "@"
            if (digits >= 7 or at or digits >= 4 and j - i >= 7) and piece[-1].isalnum():
                out.append((i, j, features(text, bounds[i], bounds[j])))
    return bounds, out


def scores(segs, w: np.ndarray) -> np.ndarray:
    return np.array([w[:, f].sum(axis=1) for _, _, f in segs]) if segs else np.zeros((0, len(KINDS)))


def decode(bounds: list[int], segs, w: np.ndarray) -> list[tuple[str, int, int]]:
    """The best sequence of segments: best[j] is over all ways to label the first j tokens."""
    s = scores(segs, w)
    ending: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(segs):
        ending.setdefault(j, []).append(k)
    best, back = [0.0] * len(bounds), [None] * len(bounds)
    for j in range(1, len(bounds)):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            kind = int(s[k].argmax())
            if best[segs[k][0]] + s[k][kind] > best[j]:
                best[j], back[j] = best[segs[k][0]] + s[k][kind], (k, kind)
    out, j = [], len(bounds) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            out.append((KINDS[kind], bounds[segs[k][0]], bounds[segs[k][1]]))
            j = segs[k][0]
    return out[::-1]


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray | None) -> list[tuple[str, int, int]]:
    out = []
    if w is not None and MARK.search(text):
        spans = sorted((a, b) for _, a, b in base)
        k, reach = 0, []
        for a, b in islands(text):
            while k < len(spans) and spans[k][0] < b:
                reach.append(spans[k])
                k += 1
            reach = [x for x in reach if x[1] > a]
            out += decode(*candidates(text, a, b, reach), w)
    return out


# ---------------------------------------------------------------- fitting


def rewritten(kind: str, s: str, turn: int) -> str:
    """The entity in another form, which the patterns don't match."""
    d = digits_of(s)
    if kind == "email":
        return s.replace("@", (" @ ", "@ ", " @")[turn % 3])
    if kind == "phone":
        return (f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[-10:-7]} {d[-7:-4]} {d[-4:]}")[turn % 4]
    if kind == "card":
        return (".", "/", "  ", "_")[turn % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    return s


def examples(samples: list[tuple[str, str, int, int]]):
    """samples: (island's text, kind, start, end). Gives (bounds, segments, true (first, last, kind) triples)."""
    out = []
    for turn, (text, kind, a, b) in enumerate(samples):
        if kind == "none":
            if not base_spans(text):
                out.append((*candidates(text, a, b, []), []))
            continue
        forms = [(text, a, b)]
        other = rewritten(kind, text[a:b], turn)
        if other != text[a:b]:
            forms.append((text[:a] + other + text[b:], a, a + len(other)))
        for t, x, y in forms:
            bounds, segs = candidates(t, max(0, x - 40), min(len(t), y + 40), [])
            if x in bounds and y in bounds:
                gold = (bounds.index(x), bounds.index(y))
                hit = [k for k, (i, j, _) in enumerate(segs) if (i, j) == gold]
                others = {(s[1], s[2]) for s in base_spans(t)} - {(x, y)}
                if hit and not others:
                    out.append((bounds, segs, [(hit[0], KINDS.index(kind))]))
        blank = text[:a] + "12 of 345" + text[b:]  # numbers which are nobody's
        bounds, segs = candidates(blank, max(0, a - 40), min(len(blank), a + 60), [])
        if not base_spans(blank):
            out.append((bounds, segs, []))
    return out


class Islands:
    """Examples as arrays: each segment's island, first token, token after the last, and features (0 or 1)."""

    def __init__(self, data):
        self.size = np.array([len(bounds) - 1 for bounds, _, _ in data])
        self.island = np.repeat(np.arange(len(data)), [len(segs) for _, segs, _ in data])
        self.i = np.array([i for _, segs, _ in data for i, _, _ in segs])
        self.j = np.array([j for _, segs, _ in data for _, j, _ in segs])
        self.x = np.zeros((len(self.i), FEATURES))
        for k, f in enumerate(f for _, segs, _ in data for _, _, f in segs):
            self.x[k, f] = 1.0
        first = np.concatenate([[0], np.cumsum([len(segs) for _, segs, _ in data])])
        self.gold = [(int(first[n]) + k, kind) for n, (_, _, gold) in enumerate(data) for k, kind in gold]
        places = np.arange(self.size.max() + 1)
        self.ends, self.starts = ([np.flatnonzero(at == p) for p in places] for at in (self.j, self.i))

    def sums(self, w: np.ndarray):
        """exp of each segment's scores by kind, sums over the labelings of the tokens before and behind each place, and of all."""
        e = np.exp(np.clip(self.x @ w.T, -30, 30))
        weight, n = e.sum(axis=1), len(self.ends)
        ahead, behind = np.ones((len(self.size), n)), np.zeros((len(self.size), n))
        add = lambda on, x: np.bincount(self.island[on], x, len(self.size))
        for p in range(1, n):
            on = self.ends[p]
            ahead[:, p] = ahead[:, p - 1] + add(on, ahead[self.island[on], self.i[on]] * weight[on])
        for p in range(n - 1, -1, -1):
            on = self.starts[p]
            after = behind[:, p + 1] if p + 1 < n else 0.0
            behind[:, p] = np.where(self.size == p, 1.0, after + add(on, weight[on] * behind[self.island[on], self.j[on]]))
        return e, ahead, behind, behind[:, 0]


def fit(samples: list[tuple[str, str, int, int]], rounds: int = 40) -> np.ndarray | None:
    """Weights kinds x features, by gradient ascent on the conditional likelihood with a quadratic penalty."""
    data = [x for x in examples(samples) if x[1]]
    if not any(x[2] for x in data):
        return None
    t = Islands(data)
    w = np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -2.0
    square = np.full_like(w, 1e-8)
    for _ in range(rounds):
        e, ahead, behind, all_ = t.sums(w)
        p = (ahead[t.island, t.i] * behind[t.island, t.j] / all_[t.island])[:, None] * e
        grad = -0.02 * w - p.T @ t.x
        for k, kind in t.gold:
            grad[kind] += t.x[k]
        square += grad**2
        w += 0.8 * grad / np.sqrt(square)
    return w


def training_samples(docs: DataFrame) -> list[tuple[str, str, int, int]]:
    """Bounded: TRAIN_ISLANDS islands with and as many without base spans, of about TRAIN_DOCUMENTS documents chosen by a hash of their id."""
    n = docs.count()
    part = max(1, n // TRAIN_DOCUMENTS)
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0) & F.col("text").rlike("[0-9@]"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = base_spans(text)
                for kind, x, y in own:
                    if len(TOKEN.findall(text, x, y)) <= MAX_TOKENS:  # others are no candidates
                        lo = max(0, x - 60)
                        out.append((doc, text[lo : y + 60], kind, x - lo, y - lo))
                for x, y in islands(text):
                    if not any(p < y and x < q for _, p, q in own):
                        lo = max(0, x - 20)
                        out.append((doc, text[lo : y + 20], "none", x - lo, y - lo))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "s", "kind", "a", "b"])

    cuts = chosen.mapInArrow(cut, "doc_id long, s string, kind string, a int, b int")
    first = W.partitionBy(F.col("kind") == "none").orderBy(F.xxhash64("doc_id", "a"), "kind", "s")
    some = cuts.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= TRAIN_ISLANDS)
    return [(r["s"], r["kind"], r["a"], r["b"]) for r in some.orderBy(F.col("kind") == "none", "rn").collect()]


def find_pii(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document: the columns in carry (doc_id, if none are given), base and added spans in code points."""
    w = fit(training_samples(columns(docs, doc_id="long", text="string")))

    def find(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
        rows = lambda spans: [{"kind": k, "a": a, "b": b} for k, a, b in spans]
        for batch in batches:
            base, added = [], []
            for x in batch.column(0):
                text = x.as_py() or ""
                own = base_spans(text)
                base.append(rows(own))
                added.append(rows(added_spans(text, own, w)))
            yield carried(batch, pa.array(base, kind), pa.array(added, kind), names=["base", "added"])

    return with_carried(docs, carry).mapInArrow(lean(find), carried_schema(docs, carry, FOUND))


def digest(spans) -> F.Column:
    """kind:start:end of spans by kind as listed, then start, joined by commas."""
    order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
