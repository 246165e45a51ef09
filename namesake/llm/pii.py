"""Personal data: patterns, and a character tagger that finds what they miss."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_lowest, map_texts
from .lstm_crf import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, AROUND = 64, 32, 24
#: Characters of a word that are looked at on each side of a digit or an @; of a stretch; and of two stretches in common.
WORD, LONG, OVERLAP = 256, 65536, 512
#: Bound of the sample whose spans train the tagger.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 1500

# The patterns of each kind. Digits and dots can't be given back for a match, so that runs are taken whole.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CLUE = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """Matches of local@domain, found from each @ outwards, so that runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        end = match.end() if match else at + 1
        if match:
            yield start, end
        at = text.find("@", end)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and apart within a kind; kinds as places in KINDS."""
    text = text or ""
    if not CLUE.search(text):
        return []
    spans = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


#: Inputs of the tagger: 0 past the end, ASCII characters, and other characters by their code's remainder.
OTHERS = 64
INPUTS = 1 + 128 + OTHERS


def inputs_of(text: str) -> np.ndarray:
    """The tagger's input for each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(codes < 128, 1 + codes, 129 + codes % OTHERS).astype(np.uint8)


def stretches(text: str) -> list[tuple[int, int, int, int]]:
    """Parts of the text that may hold personal data: all kinds have a digit or an @. A part has the whole words with
    these and AROUND characters more on each side. Those of over LONG characters are cut into overlapping ones, so that
    memory is bounded. (start, end, first and last + 1 of the places where its spans may begin)."""
    out: list[list[int]] = []
    for m in CLUE.finditer(text):
        if out and m.end() + AROUND <= out[-1][1]:
            continue
        first, b = max(0, m.start() - WORD), m.end()
        a = max(first, text.rfind(" ", first, m.start()) + 1)
        end = text.find(" ", b, b + WORD)
        a, b = max(0, a - AROUND), min(len(text), (end if end >= 0 else b + WORD) + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    cut = []
    for a, b in out:
        for c in range(a, max(a + 1, b - OVERLAP), LONG - OVERLAP):
            end = min(c + LONG, b)
            cut.append((c, end, c if c == a else c + OVERLAP // 2, end if end == b else end - OVERLAP // 2))
    return cut


def tags_of(length: int, spans) -> np.ndarray:
    """0 outside, 1 + 2k at the first character of kind k, 2 + 2k at its others."""
    tags = np.zeros(length, np.int8)
    for a, k, b in spans:
        tags[a:b], tags[a] = 2 + 2 * k, 1 + 2 * k
    return tags


def variants(text: str, spans, pick: int):
    """The text with its spans written in ways that the patterns miss, and the spans there: phones without +, and
    e-mail addresses with spaces at the @."""
    out, moved, at = [], [], 0
    size = 0
    for a, k, b in spans:
        if a < at:
            continue
        out.append(text[at:a])
        size += a - at
        piece = text[a:b]
        if k == 3:
            piece = piece[1:] if pick % 2 else piece[1:].lstrip("0123456789").lstrip(" -.") or piece
        elif k == 0 and pick % 3 == 0:
            piece = piece.replace("@", " @ ")
        out.append(piece)
        moved.append((size, k, size + len(piece)))
        size += len(piece)
        at = b
    return "".join([*out, text[at:]]), moved


def training_windows(texts: list[str], limit: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts' stretches and their tags: as they are, then in variants."""
    xs, ys = [], []
    for n, text in enumerate(texts):
        spans = base_spans(text)
        plain = []
        for s in spans:  # of overlapping kinds the first
            if not plain or s[0] >= plain[-1][2]:
                plain.append(s)
        for body, marks in ((text, plain), *([variants(text, plain, n)] if plain else [])):
            inputs, tags = inputs_of(body), tags_of(len(body), marks)
            cuts = [(c, min(c + WINDOW, b)) for a, b, _, _ in stretches(body) for c in range(a, max(a + 1, b - STEP), STEP)]
            for a, b in cuts[: 1 + limit // 50]:
                x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
                x[: b - a], y[: b - a] = inputs[a:b], tags[a:b]
                xs.append(x)
                ys.append(y)
                if len(xs) >= limit:
                    return np.array(xs).T, np.array(ys).T
    return np.array(xs).reshape(-1, WINDOW).T, np.array(ys).reshape(-1, WINDOW).T


def train(texts: list[str], epochs: int = 8) -> Tagger | None:
    """The tagger of the sample's spans; None where the sample has no stretch to learn from."""
    x, y = training_windows(texts)
    if not x.shape[1] or not y.any():
        return None
    tagger = Tagger(INPUTS, 1 + 2 * len(KINDS))
    tagger.fit(x, y, epochs)
    return tagger


def _plausible(kind: int, piece: str) -> bool:
    """The exact check of a found span: its kind's marks and its number of digits."""
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if kind == 0:
        local, _, domain = piece.partition("@")
        return bool(local.strip()) and "." in domain.strip(" .")
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def find(tagger: Tagger | None, texts: list[str | None], max_windows: int = 4096) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the patterns', and those of the tagger that don't touch one and pass the exact check.

    Each stretch is cut into windows that overlap by half. The scores of a character are averaged over its windows and
    the whole stretch is then decoded at once, so that windows can't disagree.
    """
    found = [base_spans(t) for t in texts]
    if tagger is None:
        return found
    places = [(i, *s) for i, t in enumerate(texts) if t for s in stretches(t)]
    cuts = [inputs_of(texts[i][a:b]) for i, a, b, _, _ in places]
    order = sorted(range(len(places)), key=lambda k: len(cuts[k]))
    at = 0
    while at < len(order):
        longest, group = 0, []
        while at < len(order) and (not group or (len(group) + 1) * len(cuts[order[at]]) <= max_windows * STEP):
            group.append(order[at])
            longest = len(cuts[order[at]])
            at += 1
        parts = max(1, -(-(longest - WINDOW) // STEP) + 1)
        padded = np.zeros((len(group), WINDOW + (parts - 1) * STEP), np.uint8)
        for k, g in enumerate(group):
            padded[k, : len(cuts[g])] = cuts[g]
        windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW, 1)[:, ::STEP]
        scores, _ = tagger.emissions(windows.reshape(-1, WINDOW).T)
        scores = scores.transpose(1, 0, 2).reshape(len(group), parts, WINDOW, -1)
        total, times = np.zeros((*padded.shape, scores.shape[-1]), np.float32), np.zeros(padded.shape[1], np.float32)
        for p in range(parts):
            total[:, p * STEP : p * STEP + WINDOW] += scores[:, p]
            times[p * STEP : p * STEP + WINDOW] += 1
        tags = tagger.viterbi((total / times[None, :, None]).transpose(1, 0, 2)).T
        for k, g in enumerate(group):
            i, a, b, low, high = places[g]
            found[i] = _add(found[i], texts[i], a, tags[k, : b - a], low, high)
    return [sorted(s) for s in found]


def _add(spans, text: str, offset: int, tags: np.ndarray, low: int, high: int):
    """The spans with those of the tags that begin from low to high - 1, touch none and pass the exact check."""
    marked = np.flatnonzero(tags)
    if not len(marked):
        return spans
    out, k = list(spans), 0
    while k < len(marked):
        start = int(marked[k])
        kind = (int(tags[start]) - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        while k < len(marked) and marked[k] < end:
            k += 1
        a, b = offset + start, offset + end
        while a < b and text[a].isspace():
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if low <= offset + start < high and a < b and not any(x < b and a < y for x, _, y in out) and _plausible(kind, text[a:b]):
            out.append((a, kind, b))
    return out


def sample(docs: DataFrame, keep: Column | None = None, limit: int = SAMPLE_DOCS) -> list[str]:
    """Surroundings of the digits and @ of the `limit` documents with the lowest hashes that have any, 4,000 characters each at most."""
    known = docs.filter(F.col("text").rlike("[0-9@]")) if keep is None else docs.filter(keep & F.col("text").rlike("[0-9@]"))
    near = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s).{0,40}[0-9@].{0,40}"), F.lit(0)), "\n")
    h = F.xxhash64("doc_id", F.lit(3))
    share = min(1.0, 8 * limit / max(1, known.count()))  # of the hashes; leaves 8 times as many rows as are needed
    rows = known.filter(in_lowest(h, F.lit(share))).select(h.alias("h"), F.substring(near, 1, 4000).alias("part"))
    return [r.part for r in rows.orderBy("h", "part").limit(limit).collect()]


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the patterns' matches of each kind, their digest, and all spans with the tagger's added.

    A null text is empty: no spans. Rows may repeat; an empty table gives no rows; columns other than doc_id and text
    aren't read. Very long texts are read whole, in stretches of bounded size. With nothing to learn from only the
    patterns count.
    """
    tagger = train(sample(docs))

    def make():
        def work(rows):
            spans = find(tagger, rows["text"])
            base = [base_spans(t) for t in rows["text"]]
            counts = {f"n_{kind}": [sum(s[1] == k for s in b) for b in base] for k, kind in enumerate(KINDS)}
            return {"doc_id": rows["doc_id"], **counts, "base_sha256": [hashlib.sha256(text_of(b).encode()).hexdigest() for b in base], "spans": [text_of(s) for s in spans]}

        return work

    return map_texts(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans) -> str:
    """The text with each span, or each run of overlapping ones, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in their texts; other columns and null texts stay."""
    tagger = train(sample(docs))
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from .common import slices

        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else mask(t, s) for t, s in zip(texts, find(tagger, texts))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
