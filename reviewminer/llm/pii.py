"""Personal data: fixed formats, and boosted candidates beside them.

Base spans follow fixed formats with checks. High-recall generators propose
further, overlapping spans: every run of whole digit groups of a stretch, every
end of a loose mail address. Boosted stumps score them by shape and context.
No span labels exist, and "is a base span" would make every addition wrong, so
the model learns from rewritten base spans: the same data in a form the base
formats do not know is right, a spoilt one and every other cut through it is
wrong. Every such example counts: two thirds fit the stumps, from sums over places
between cuts that Spark adds up in each round, and each kind's threshold is the
lowest that keeps the precision on the other third. The driver sees values,
sums and scores with their counts, whose number does not grow with the texts. Candidates
that meet no base span and pass are added, best first, without overlaps; base
spans always stay. Without base spans there is nothing to learn from.

Null texts are empty and have no spans. Repeated rows are judged alike.
Offsets are code points; whole texts are read in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enough_tasks, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS = 40
RATE = 0.3
PLACES = np.linspace(0.05, 0.95, 13)  # quantiles that cut a feature's values
STEPS = 1024  # scores are multiples of 1 / STEPS
_UNIT = 1 << 24  # sums are whole numbers of 1 / _UNIT, so they do not depend on their order
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}"
)
_LABEL = re.compile(r" ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}")
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[ ().\[\]/-]+")
_MOST_DIGITS, _DOMAIN_CHARS = 19, 253  # the longest card; the longest domain name
_HINTS = tuple(
    re.compile(p)
    for p in ("mail|contact|write", "ip|server|host|address", "card|visa|credit|pay", "phone|call|tel|fax|mobile")
)
_BEFORE = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from every @: no run is scanned twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans = [(0, a, b) for a, b in emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals: all runs of whole digit groups, for every kind whose length they have."""
    spans = []
    for m in _LOOSE_MAIL.finditer(text):
        end, most = m.end(), m.end() + _DOMAIN_CHARS
        while (more := _LABEL.match(text, end)) and more.end() <= most:
            end = more.end()
            spans.append((0, m.start(), end))
        if end == m.end():
            spans.append((0, m.start(), end))
    stretch: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if stretch and not _GAP.fullmatch(text, stretch[-1][1], m.start()):
            spans += _runs(text, stretch)
            stretch = []
        stretch.append(m.span())
    return [*spans, *_runs(text, stretch)]


def _runs(text: str, groups: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    for i, (start, _) in enumerate(groups):
        n = dots = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > _MOST_DIGITS:
                break
            end = groups[j][1]
            dots += text.count(".", groups[j - 1][1], groups[j][0]) if j > i else 0
            if j - i == 3 and dots == 3 and n <= 12:
                yield 1, start, end
            if n >= 13:
                yield 2, start, end
            if 7 <= n <= 15:
                first = start - (text[start - 1 : start] == "(" and text.find(")", start, end) >= 0)
                yield 3, first - (text[first - 1 : first] == "+"), end


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - _BEFORE) : start].lower(), text[end : end + 1]
    digits, groups = _digits(body), _GROUP.findall(body)
    mail = _LOOSE_MAIL.match(body) if kind == 0 else None
    more = _LABEL.match(text, end) if kind == 0 else None
    numbers, sizes = [n.lstrip("0") for n in groups], [len(n) for n in groups] or [0]
    return [
        kind, len(digits), end - start, len(numbers), sum(not c.isalnum() for c in body), body.count("."), body.count(" "),
        float(body.startswith("+")), float("(" in body), float("@" in body), float("[" in body), float(". " in body),
        float(luhn(digits)) if digits else 0.0, float(all(len(n) <= 3 and int(n or 0) <= 255 for n in numbers)),
        float(before[-1:].isalnum()), float(after.isalnum()),
        *_beside(_GAP_BEFORE.search(before)), *_beside(_GAP_AFTER.match(text[end : end + _BEFORE])),
        sizes[0], sizes[-1], max(sizes), min(sizes), len(set(_GAP.findall(body))),
        len(_LABEL.findall(body, mail.end())) if mail else 0, float(more is not None and more[0][:2] != ". "),
        *(float(bool(h.search(before))) for h in _HINTS),
    ]


_GAP_BEFORE = re.compile(r"[0-9A-Za-z]([ ().\[\]/-]+)$")
_GAP_AFTER = re.compile(r"([ ().\[\]/-]+)[0-9A-Za-z]")


def _beside(found: re.Match | None) -> tuple[float, float]:
    """Whether more is joined to the span: tightly, or digits after space."""
    gap = found[1] if found else ""
    digit = bool(found) and any(c.isdigit() for c in (found[0][0], found[0][-1]))
    return float(gap != "" and " " not in gap), float(" " in gap and digit)


WIDTH = 27 + len(_HINTS)


def _checked(digits: str) -> str:
    """The digits with a last one that makes them pass the check."""
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def _cut(digits: str, sizes: tuple[int, ...], gap: str) -> str:
    ends = np.cumsum(sizes).tolist()
    return gap.join(g for a, b in zip([0, *ends], [*ends, len(digits)], strict=True) if (g := digits[a:b]))


def _mail_again(body: str, right: bool, rng: random.Random) -> str:
    local, domain = body.split("@", 1)
    local, labels = local[-rng.randint(1, len(local)) :].lstrip(".") or "x", domain.split(".")
    domain = ".".join(labels[-rng.randint(2, len(labels)) :])
    at = rng.choice((" [at] ", "[at]", " (at) ", "(at)", " @ "))
    dot = rng.choice((".", ".", " [dot] ", "[dot]", " (dot) ", "(dot)"))
    return local + at + (domain.replace(".", dot) if right else labels[0])


def _ip_again(body: str, right: bool, rng: random.Random) -> str:
    parts = body.split(".")
    if not right:
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
    gap = rng.choice(("[.]", "(.)", " . "))
    return gap.join(parts) if rng.random() < 0.5 else ".".join(parts[:3]) + gap + parts[3]


def _card_again(body: str, right: bool, rng: random.Random) -> str:
    n = rng.choice((13, 15, 15, 16, 16, 16))
    digits = _checked(_digits(body)[: n - 1])
    if not right:
        digits = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
    if n == 16:
        return _cut(digits, (4, 4, 4), rng.choice((".", ".", "/", "  ", "[-]")))
    return _cut(digits, (4, 6), rng.choice(("", " ", "-", "."))) if n == 15 else digits


def _phone_again(body: str, right: bool, rng: random.Random) -> str:
    digits = _digits(body)
    if not right:
        y, m, d, n = rng.randint(1950, 2049), rng.randint(1, 12), rng.randint(1, 28), rng.randint(10**6, 10**10)
        return rng.choice((f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y} {d % 24:02}", f"{y}-{y + m}", f"{n}", f"{n:,}".replace(",", "."),
                           f"{d} {m} {y} {n % 1000}"))
    far, own = digits[:-10] or "1", digits[-10:]
    area, mid, last = own[:-7], own[-7:-4], own[-4:]
    gap = rng.choice("-. ")
    tail = gap.join(x for x in (area, mid, last) if x)
    return rng.choice((tail, tail, f"({area or far}) {mid}-{last}", f"00{far} {tail}", f"{far}{gap}{tail}", f"{area or far}/{mid}-{last}", f"call {own}"))


_AGAIN = (_mail_again, _ip_again, _card_again, _phone_again)


def examples(text: str, span: tuple[int, int, int]) -> tuple[list[list[float]], list[int]]:
    """Features and labels of all candidates of the span in new forms, right and spoilt, in its own context."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 2 * _BEFORE) : start], text[end : end + _BEFORE]
    rng, x, y = random.Random(zlib.crc32((before + body).encode("utf-8", "surrogatepass"))), [], []
    for right in (True, True, False):
        made, true, text = [_AGAIN[kind](body, right, rng) for _ in range(rng.choice((1, 1, 2)))], set(), before
        for form in made:
            lead = "call " if form.startswith("call ") else ""
            text += " " * (text[-1:].isalnum()) + lead
            true |= {(kind, len(text), len(text) + len(form) - len(lead))} if right else set()
            text += form[len(lead) :]
        last, ends = len(text), {b for _, _, b in true}
        text += rng.choice((after, ". Then", ", ", " and"))
        known = set(base_spans(text))
        for c in candidates(text):
            if c[2] <= len(before) or c in known or (c[2] in ends and c not in true and len(_digits(text[c[1] : c[2]])) >= 10 and c[0] == 3):
                continue  # in front of the new forms, of a base form after all, or a number without its country
            if c[1] < last:
                x.append(features(text, c))
                y.append(int(c in true))
    return x, y


Stump = tuple[int, float, float, float]  # feature, cut, left, right


def predict(model: list[Stump], x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for f, cut, low, high in model:
        score += np.where(x[:, f] <= cut, low, high)
    return score


def predict_kinds(models: list[list[Stump]], x: np.ndarray) -> np.ndarray:
    """A model per kind: what tells one kind from chance says nothing about another."""
    score = np.select([x[:, 0] == k for k in range(len(KINDS))], [predict(m, x) for m in models])
    return np.round(score * STEPS) / STEPS


def quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct quantiles at ``PLACES`` of rising values that occur so often."""
    ends = np.cumsum(counts)
    at = PLACES * (ends[-1] - 1)
    below, above = (values[np.searchsorted(ends, i, side="right")] for i in (np.floor(at), np.ceil(at)))
    return np.unique(below + (above - below) * (at - np.floor(at)))


def _examples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and whether they are held out, of all examples in a batch; a hash of document and place decides."""
    x = np.frombuffer(b"".join(batch.column("learnt").to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
    lists = batch.column("rights")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    draw = np.repeat(batch.column("draw").to_numpy().view(np.uint64), sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    draw = (draw ^ (draw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x, lists.flatten().to_numpy(zero_copy_only=False), (draw >> np.uint64(32)) % np.uint64(3) == 0


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each kind's features take each value in the examples that are not held out."""
    for batch in batches:
        x, _, held = _examples(batch)
        for k in range(len(KINDS)):
            mine = x[(x[:, 0] == k) & ~held]
            for f in range(WIDTH if len(mine) else 0):
                found, many = np.unique(mine[:, f], return_counts=True)
                yield _table(["kind", "feature", "value", "n"], np.full(len(found), k), np.full(len(found), f), found, many)


def _placed(cuts: dict[tuple[int, int], np.ndarray]):
    """Examples by the number of cuts below each feature; feature <= cut j means a place of at most j."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, held = _examples(batch)
            for k in range(len(KINDS)):
                mine = x[:, 0] == k
                rows = np.zeros((int(mine.sum()), WIDTH), np.uint8)
                for f in range(WIDTH):
                    rows[:, f] = np.searchsorted(cuts.get((k, f), np.empty(0)), x[mine, f], side="left")
                if len(rows):
                    yield _table(["kind", "held", "places", "right"], np.full(len(rows), k), held[mine], [r.tobytes() for r in rows], y[mine].astype(np.int64))

    return place


def _scores(batch: pa.RecordBatch, models: list[list[Stump]]) -> tuple[np.ndarray, ...]:
    """Kinds, places, counts, right ones and scores of a batch of equal examples; the models cut places."""
    places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint8).reshape(-1, WIDTH)
    kind, n, rights = (batch.column(c).to_numpy() for c in ("kind", "n", "rights"))
    score = np.select([kind == k for k in range(len(KINDS))], [predict(m, places) for m in models])
    return kind, places, n, rights, score


def _sums(models: list[list[Stump]]):
    """Gradient and curvature of logistic loss by kind, feature and place, in units of 1 / _UNIT."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(PLACES) + 1
        total = np.zeros((2, len(KINDS) * WIDTH * width), np.int64)
        for batch in batches:
            kind, places, n, rights, score = _scores(batch, models)
            p = 1 / (1 + np.exp(-score))
            sums = [np.round(v * _UNIT).astype(np.int64) for v in (rights - n * p, n * p * (1 - p))]
            for f in range(WIDTH):
                slot = (kind * WIDTH + f) * width + places[:, f]
                for i in range(2):
                    np.add.at(total[i], slot, sums[i])
        used = np.flatnonzero(total.any(axis=0))
        yield _table(["slot", "g", "h"], used, total[0][used], total[1][used])

    return add


def _stump(g: np.ndarray, h: np.ndarray, cuts: list[int]) -> Stump | None:
    """The Newton step of most gain: g and h by feature and place, ``cuts`` the number of each feature."""
    best = None
    for f, many in enumerate(cuts):
        for place in range(many):
            gl, hl = g[f, : place + 1].sum(), h[f, : place + 1].sum()
            gr, hr = g[f].sum() - gl, h[f].sum() - hl
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
            if best is None or gain > best[0] * (1 + 1e-9):
                best = (gain, f, float(place), RATE * gl / (hl + 1), RATE * gr / (hr + 1))
    return best[1:] if best else None


def _margins(models: list[list[Stump]]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, _, n, rights, found = _scores(batch, models)
            yield _table(["kind", "score", "n", "rights"], kind, np.round(found * STEPS) / STEPS, n, rights)

    return score


def threshold(score: np.ndarray, n: np.ndarray, rights: np.ndarray, precision: float = PRECISION) -> float:
    """Of falling scores with counts: the lowest with the precision at and above it, half way to the next; never, where it is not reached."""
    good = np.flatnonzero(np.cumsum(rights) >= precision * np.cumsum(n)) if len(n) else []
    return float(score[good[-1] : good[-1] + 2].mean()) if len(good) else np.inf


def learnt(proposed: DataFrame) -> tuple[list[list[Stump]], list[float]]:
    """Boosted stumps and a threshold for each kind, from all examples of ``proposed``."""
    examples = proposed.where(F.size("rights") > 0).select("learnt", "rights", F.xxhash64(F.lit(6), "doc_id").alias("draw"))
    values = examples.mapInArrow(_values, "kind bigint, feature bigint, value double, n bigint")
    values = values.groupBy("kind", "feature", "value").agg(F.sum("n").alias("n")).toPandas()  # spans are short: few values each
    cuts = {key: quantiles(v["value"].to_numpy(), v["n"].to_numpy()) for key, v in values.sort_values("value").groupby(["kind", "feature"])}
    models: list[list[Stump]] = [[] for _ in KINDS]
    if not cuts:
        return models, [np.inf] * len(KINDS)
    placed = examples.mapInArrow(_placed(cuts), "kind bigint, held boolean, places binary, right bigint")
    cells = written(placed.groupBy("kind", "held", "places").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("rights")), "examples")
    many = [[len(cuts.get((k, f), ())) for f in range(WIDTH)] for k in range(len(KINDS))]
    shape = (len(KINDS), WIDTH, len(PLACES) + 1)
    for _ in range(ROUNDS):
        sums = cells.where("not held").mapInArrow(_sums(models), "slot bigint, g bigint, h bigint")
        g, h = np.zeros(np.prod(shape)), np.zeros(np.prod(shape))
        for row in sums.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # at most a row per place
            g[row["slot"]], h[row["slot"]] = row["g"] / _UNIT, row["h"] / _UNIT
        steps = [_stump(g.reshape(shape)[k], h.reshape(shape)[k], many[k]) for k in range(len(KINDS))]
        models = [[*m, s] if s else m for m, s in zip(models, steps, strict=True)]
    margins = cells.where("held").mapInArrow(_margins(models), "kind bigint, score double, n bigint, rights bigint")
    margins = margins.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("rights").alias("rights")).toPandas()  # multiples of 1 / STEPS
    margins = margins.sort_values("score", ascending=False)
    bars = [threshold(*(margins.loc[margins["kind"] == k, c].to_numpy() for c in ("score", "n", "rights"))) for k in range(len(KINDS))]
    named = [[(f, float(cuts[k, f][int(place)]), low, high) for f, place, low, high in m] for k, m in enumerate(models)]
    return named, bars


def _apart(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    i = bisect_left(starts, end)
    return i > 0 and ends[i - 1] > start


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, loose, values, learnt, rights = [], [], [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            sure = base_spans(text)
            covered = _apart(sure)
            found = [c for c in candidates(text) if not _meets(*covered, *c[1:])]
            made = [examples(text, s) for s in sure]
            base.append(np.array(sure, np.int64).tobytes())
            loose.append(np.array(found, np.int64).tobytes())
            values.append(np.array([features(text, c) for c in found], np.float32).tobytes())
            learnt.append(np.array([v for x, _ in made for v in x], np.float32).tobytes())
            rights.append([v for _, y in made for v in y])
        columns = [batch.column("doc_id"), *(pa.array(c, pa.binary()) for c in (base, loose, values, learnt))]
        columns.append(pa.array(rights, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "loose", "features", "learnt", "rights"])


def best_apart(spans: list[tuple[int, int, int]], scores: list[float]) -> list[tuple[int, int, int]]:
    """By falling score, then length, the spans that meet none taken before."""
    taken: list[tuple[int, int, int]] = []
    for _, _, a, b, k in sorted((-p, s[1] - s[2], s[1], s[2], s[0]) for s, p in zip(spans, scores, strict=True)):
        i = bisect_left(taken, (b,))
        if not (i and taken[i - 1][1] > a):
            insort(taken, (a, b, k))
    return [(k, a, b) for a, b, k in taken]


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _decide(model, bars):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, loose, values in zip(*(batch.column(c).to_pylist() for c in ("base", "loose", "features")), strict=True):
                sure = [tuple(s) for s in np.frombuffer(base, np.int64).reshape(-1, 3).tolist()]
                found = [tuple(s) for s in np.frombuffer(loose, np.int64).reshape(-1, 3).tolist()]
                x = np.frombuffer(values, np.float32).reshape(-1, WIDTH).astype(float)
                scores = predict_kinds(model, x).tolist() if found else []
                passed = [(s, p) for s, p in zip(found, scores, strict=True) if p >= bars[s[0]]]
                added = best_apart([s for s, _ in passed], [p for _, p in passed])
                counts = [sum(s[0] == k for s in sure) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_named(sure).encode()).hexdigest(), _named(sorted({*sure, *added}))))
            columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))]
            columns += [pa.array([r[i] for r in rows], pa.string()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return decide


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are those of the base formats."""
    rows = enough_tasks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    schema = "doc_id bigint, base binary, loose binary, features binary, learnt binary, rights array<int>"
    proposed = written(rows.mapInArrow(_propose, schema), "candidates")
    return proposed.select("doc_id", "base", "loose", "features").mapInArrow(
        _decide(*learnt(proposed)),
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )
