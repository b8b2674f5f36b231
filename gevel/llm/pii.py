"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import fraction, keep_table, map_arrow, text_hash

KINDS = ("email", "ip", "card", "phone")
#: Words, numbers and marks in an entity at most.
LONGEST = 24
#: Characters of context on both sides of digits or ``@``, and between such places in one stretch.
AROUND = 24
#: Stretches the model is fitted on at most, passes over them, step size, ridge.
STRETCHES = 4000
EPOCHS, RATE, RIDGE = 6, 0.5, 1e-3
#: How far the best labelling with a span must beat the best without it, in log-odds.
MARGIN = 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]")
_CORE = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _MAIL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) by the fixed patterns, sorted."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out)


def stretches(text: str) -> list[tuple[int, str]]:
    """(start, text) of the places with digits or ``@`` and their surroundings; elsewhere no entity can be."""
    out: list[list[int]] = []
    for m in _CORE.finditer(text):
        if out and m.start() - out[-1][1] <= 2 * AROUND and "\n" not in text[out[-1][1] : m.start()]:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    return [(max(0, a - AROUND), text[max(0, a - AROUND) : b + AROUND]) for a, b in out]


def candidates(text: str) -> list[tuple[int, int, list[str]]]:
    """(first, end, features) of the segments that could be entities, over token positions.

    A segment has at most ``LONGEST`` tokens on one line, begins and ends at the edge
    of a word or number, and holds seven digits or an ``@``. Features describe it as a
    whole and what stands on either side.
    """
    tokens = _TOKEN.findall(text)
    out = []
    for i, first in enumerate(tokens):
        if not (first.isascii() and (first.isalnum() or first in "+(")):
            continue
        before = tokens[i - 1] if i else ""
        if before and before[-1].isalnum():
            continue
        digits, shape, ats = "", "", 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            t = tokens[j]
            if t.isascii() and t.isdigit():
                digits += t
                shape += f"d{min(len(t), 20)}"
            elif t.isascii() and t.isalpha():
                shape += "a" if not shape.endswith("a") else ""
            elif t in " .()-+@_%" and t:
                shape += t
                ats += t == "@"
            else:
                break
            after = tokens[j + 1] if j + 1 < len(tokens) else ""
            if not t.isalnum() or (after and after[0].isalnum()) or not (len(digits) >= 7 or ats):
                continue
            parts = "".join(tokens[i : j + 1]).split(".")
            quad = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
            out.append(
                (
                    i,
                    j + 1,
                    [
                        "bias",
                        f"shape={shape[:40]}",
                        f"digits={min(len(digits), 20)}",
                        f"luhn={14 <= len(digits) <= 19 and luhn(digits)}",
                        f"quad={quad}",
                        f"ats={min(ats, 2)} dot={'.' in shape.rpartition('@')[2] if ats else ''}",
                        f"letters={'a' in shape}",
                        f"first={first if first in '+(' else ''}",
                        f"left={before if not before.isalnum() else 'w'}",
                        f"right={after if not after.isalnum() else 'w'}",
                    ],
                )
            )
    return out


def segments(text: str) -> tuple[int, list[tuple[int, int, list[str]]], list[int]]:
    """Number of tokens, candidates, character positions of the tokens."""
    at, n = [0], 0
    for t in _TOKEN.findall(text):
        n += 1
        at.append(at[-1] + len(t))
    return n, candidates(text), at


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> dict[str, float]:
    """Weights from (text, spans) rows, by AdaGrad on the likelihood of whole labellings.

    Forward and backward sums run over segmentations of bounded segments; a token
    outside entities scores zero.
    """
    data = []
    for text, spans in rows:
        n, found, at = segments(text)
        truth = {(a, b): kind for a, b, kind in spans}
        kinds = [truth.get((at[i], at[j])) for i, j, _ in found]
        if found:
            data.append((n, found, kinds))
    weight: dict[str, float] = {}
    past: dict[str, float] = {}
    for _ in range(EPOCHS):
        for n, found, truth in data:
            score = [[sum(weight.get(f"{k}:{x}", 0.0) for x in fs) for k in range(len(KINDS))] for _, _, fs in found]
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for c, (i, j, _) in enumerate(found):
                ends.setdefault(j, []).append(c)
                starts.setdefault(i, []).append(c)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for t in range(1, n + 1):
                total = ahead[t - 1]
                for c in ends.get(t, ()):
                    for s in score[c]:
                        total = _add(total, ahead[found[c][0]] + s)
                ahead[t] = total
            for t in range(n - 1, -1, -1):
                total = behind[t + 1]
                for c in starts.get(t, ()):
                    for s in score[c]:
                        total = _add(total, behind[found[c][1]] + s)
                behind[t] = total
            for c, (i, j, fs) in enumerate(found):
                for k in range(len(KINDS)):
                    p = math.exp(min(0.0, ahead[i] + score[c][k] + behind[j] - ahead[n]))
                    g = p - (truth[c] == k)
                    if abs(g) < 1e-4:
                        continue
                    for x in fs:
                        name = f"{k}:{x}"
                        w = weight.get(name, 0.0)
                        step = g + RIDGE * w
                        past[name] = past.get(name, 0.0) + step * step
                        weight[name] = w - RATE * step / math.sqrt(past[name] + 1e-8)
    return weight


def decode(text: str, weight: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the entities of the best labelling, each worth at least ``MARGIN``."""
    n, found, at = segments(text)
    if not found:
        return []
    ends: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, fs in found:
        for k in range(len(KINDS)):
            s = sum(weight.get(f"{k}:{x}", 0.0) for x in fs) - MARGIN
            if s > 0:
                ends.setdefault(j, []).append((i, k, s))
    best: list[float] = [0.0] * (n + 1)
    came: list[tuple[int, int] | None] = [None] * (n + 1)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for i, k, s in ends.get(t, ()):
            if best[i] + s > best[t]:
                best[t], came[t] = best[i] + s, (i, k)
    out, t = [], n
    while t > 0:
        if came[t]:
            i, k = came[t]
            out.append((at[i], at[t], k))
            t = i
        else:
            t -= 1
    return out[::-1]


def free(added: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``added`` that overlap neither ``taken`` nor one another, the first ones first."""
    out, edge, t = [], 0, 0
    walls = sorted(taken)
    reach = 0
    for a, b, k in sorted(added):
        while t < len(walls) and walls[t][0] < b:
            reach = max(reach, walls[t][1])
            t += 1
        if a >= max(edge, reach):
            out.append((a, b, k))
            edge = b
    return out


FOUND = (
    "doc_id long, k_hash long, base array<struct<start:int,end:int,kind:int>>, places array<struct<start:int,text:string>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, places = [], []
        for text in batch.column("text").to_pylist():
            has = text and _CORE.search(text)
            base.append([{"start": a, "end": b, "kind": k} for a, b, k in base_spans(text)] if has else [])
            places.append([{"start": a, "text": t} for a, t in stretches(text)] if has else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k_hash"), pa.array(base, _SPANS), pa.array(places, _PLACES)],
            ["doc_id", "k_hash", "base", "places"],
        )


def train(found: DataFrame) -> dict[str, float]:
    """The model from about ``STRETCHES`` stretches, with the base spans inside them as labels.

    Stretches are thinned by a hash of their text, so that copies come or go together.
    """
    places = found.select(F.explode("places").alias("place"), "base").where(F.length("place.text") < 2000)
    end = F.col("place.start") + F.length("place.text")
    inside = F.filter("base", lambda s: (s["start"] >= F.col("place.start")) & (s["end"] <= end))
    shifted = F.transform(
        inside,
        lambda s: F.struct(
            (s["start"] - F.col("place.start")).alias("start"), (s["end"] - F.col("place.start")).alias("end"), s["kind"]
        ),
    )
    rows = places.select(F.col("place.text").alias("text"), shifted.alias("spans"))
    rows = rows.where("text rlike '[0-9][^a-zA-Z]{5,}[0-9]|@'").distinct()
    n = rows.count()
    if n == 0:
        return {}
    sample = rows.where(fraction("pii", F.col("text")) < min(1.0, STRETCHES / n)).orderBy("text").collect()
    return fit([(r["text"], [(s[0], s[1], s[2]) for s in r["spans"]]) for r in sample])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, k_hash, base, spans) of every row: arrays of (start, end, kind), code points, end exclusive.

    ``base`` has the matches of the fixed patterns, ``spans`` these and what the random
    field adds without touching them; both by start, then kind. Kinds are numbered as
    in ``KINDS``. The field learns from the base spans of a bounded sample of places
    and is applied to every place with digits or ``@`` in every whole text.

    Null and empty texts: no spans. Repeated rows are kept. Null doc_id: a document like
    others. No places to learn from: base spans only. No rows: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("k_hash"), "text")
    found, _ = keep_table(map_arrow(rows, _base, FOUND), "places")
    weights = docs.sparkSession.sparkContext.broadcast(train(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        for batch in batches:
            out = []
            bases, places = batch.column("base").to_pylist(), batch.column("places").to_pylist()
            for base, here in zip(bases, places):
                taken = [(s["start"], s["end"], s["kind"]) for s in base]
                added = [
                    (a + place["start"], b + place["start"], k)
                    for place in here
                    for a, b, k in decode(place["text"], weight)
                ]
                ordered = sorted(taken + free(added, taken), key=lambda s: (s[0], s[2], s[1]))
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in ordered])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k_hash"), batch.column("base"), pa.array(out, _SPANS)],
                ["doc_id", "k_hash", "base", "spans"],
            )

    spans = "array<struct<start:int,end:int,kind:int>>"
    return map_arrow(found, run, f"doc_id long, k_hash long, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(column: str):
        ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"], s["kind"], s["end"])))
        texts = F.transform(
            ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(texts, ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
