"""Language identification by cross-parsing: how few phrases of a language's text make up a document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_lowest, map_texts, slices

LETTER = re.compile(r"[^\W\d_]")
#: Segments of texts are parsed side by side, then joined so that phrases run on over their edges.
SEGMENT = 256
#: Rows of a segment after which a parse that began elsewhere is compared with the segment's own.
STOPS = (32, 64, 128, SEGMENT)
#: How often segments are parsed side by side before the rest is parsed in order.
ROUNDS = 4
#: Up to so many different symbols an automaton's transitions are a table, beyond it they are sorted keys.
TABLE_SYMBOLS = 64
#: Bounds of the labelled sample: documents of a language, and characters taken from each.
DOCS_PER_LANGUAGE = 160
CHARS_PER_DOC = 200


class Automaton:
    """The suffix automaton of a string of positive symbols, as its next states; 0 is both root and 'none'.

    Its own symbols are numbered from 1; all others, which it can't follow, are 0.
    """

    def __init__(self, symbols: list[int]):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in nexts[at]:
                nexts[at][c] = new
                at = link[at]
            if at >= 0:
                to = nexts[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and nexts[at].get(c) == to:
                        nexts[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        own = np.unique(np.array(symbols, np.int32))
        self.number = np.zeros(int(own.max(initial=0)) + 2, np.int32)
        self.number[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        states = np.repeat(np.arange(len(nexts)), [len(row) for row in nexts])
        at = states * self.width + self.number[np.fromiter((c for row in nexts for c in row), np.int64, len(states))]
        to = np.fromiter((x for row in nexts for x in row.values()), np.int32, len(states))
        self.flat = self.keys = None
        if self.width <= TABLE_SYMBOLS:
            self.flat = np.zeros(len(nexts) * self.width, np.int32)
            self.flat[at] = to
        else:
            order = np.argsort(at)
            self.keys, self.to = at[order], to[order]
            self.first = np.zeros(self.width, np.int32)
            self.first[at[at < self.width]] = to[at < self.width]
        self.steps = None
        self.bits = np.log2(max(2, len(symbols)))

    def _next(self, state: np.ndarray, row: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.flat.take(state * self.width + row)
        want = state.astype(np.int64) * self.width + row
        place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[place] == want, self.to[place], np.int32(0))

    def _run(self, rows: np.ndarray, state: np.ndarray, count: np.ndarray) -> np.ndarray:
        """States after rows of symbols; adds to count the phrases that begin in them."""
        first = self.flat if self.keys is None else self.first
        for row in rows:
            row = self.number.take(row, mode="clip")  # what is over its largest symbol becomes 0
            to = self._next(state, row)
            none = to == 0
            count += none | (state == 0)
            np.copyto(to, first.take(row), where=none)
            state = to
        return state

    def _walk(self, symbols: np.ndarray, state: int) -> tuple[list[int], list[int]]:
        """_run() for one segment: the states at STOPS, and the phrases that have begun up to them. One symbol after the other
        in Python's numbers, which for a single segment is some twenty times faster than arrays of one."""
        step, first = self._steps()
        states, counts, count, at = [], [], 0, 0
        row = self.number.take(symbols, mode="clip").tolist()
        for stop in STOPS:
            for c in row[at:stop]:
                to = step(state * self.width + c)
                if not to:
                    count += 1
                    to = first(c)
                elif not state:
                    count += 1
                state = to
            states.append(state)
            counts.append(count)
            at = stop
        return states, counts

    def _steps(self):
        if self.keys is None:
            table = memoryview(self.flat)
            return table.__getitem__, table.__getitem__
        if self.steps is None:
            self.steps = dict(zip(self.keys.tolist(), self.to.tolist()))
        return lambda key: self.steps.get(key, 0), memoryview(self.first).__getitem__

    def phrases(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Of each column, how many of the longest matches of its text begin in it; a symbol not its own is one by itself.

        Columns are segments of texts; follows says which go on from the column before. Each is parsed from its
        beginning first, then again from the state in which the segment before it ends, up to where both parses are in the
        same state and so go on alike. Where that doesn't happen within a segment, the next one is parsed once more. Texts
        whose segments never fall in step, such as long runs of one character, would take as many rounds as segments:
        after ROUNDS of them the rest is parsed in order, each segment once, and equal segments begun in equal states
        are looked up.
        """
        n = columns.shape[1]
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        states, counts, at = [], [], 0
        for stop in STOPS:
            state = self._run(columns[at:stop], state, count)
            states.append(state.copy())
            counts.append(count.copy())
            at = stop
        begin = np.zeros(n, np.int32)
        todo = np.flatnonzero(follows)
        for _ in range(ROUNDS):
            todo = todo[states[-1][todo - 1] != begin[todo]]
            begin[todo] = states[-1][todo - 1]
            end = states[-1][todo].copy()
            left, state, count, at = todo, begin[todo], np.zeros(len(todo), np.int32), 0
            for k, stop in enumerate(STOPS):
                state = self._run(columns[at:stop, left], state, count)
                same = state == states[k][left]
                done = left[same]
                for j in range(k + 1, len(STOPS)):
                    counts[j][done] += count[same] - counts[k][done]
                counts[k][done] = count[same]
                left, state, count, at = left[~same], state[~same], count[~same], stop
                states[k][left], counts[k][left] = state, count
            changed = todo[states[-1][todo] != end] + 1
            changed = changed[changed < n]
            todo = changed[follows[changed]]
            if not len(todo):
                return counts[-1]
        ends, total, known = states[-1], counts[-1], {}
        for i in todo.tolist():
            while i < n and follows[i] and ends[i - 1] != begin[i]:
                begin[i] = ends[i - 1]
                what = columns[:, i].tobytes(), int(begin[i])
                if what not in known:
                    if len(known) == 4096:
                        known.clear()
                    known[what] = self._walk(columns[:, i], int(begin[i]))
                ends[i], total[i] = known[what][0][-1], known[what][1][-1]
                i += 1
        return total


class Identifier:
    def __init__(self, samples: dict[str, str]):
        """samples: of each language, labelled text. The symbols are the lower-case letters of all of it."""
        self.languages = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text.lower() if LETTER.match(c)})
        # 1: not a letter; the last: a letter that no language of the sample uses; 0: past a segment's end
        kinds = {c: i for i, c in enumerate(letters, 2)}
        self.classes = np.ones(0x110000, np.int32)
        for m in LETTER.finditer("".join(map(chr, range(0x110000)))):
            self.classes[m.start()] = kinds.get(m[0].lower()[0], len(letters) + 2)
        self.automata = [Automaton(self._symbols(samples[x]).tolist()) for x in self.languages]

    def _symbols(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        if not known:
            return langs, scores
        symbols = [self._symbols(texts[i]) for i in known]
        parts = np.array([-(-len(x) // SEGMENT) for x in symbols])
        padded = np.zeros((parts.sum(), SEGMENT), np.int32)
        flat, at = padded.reshape(-1), 0
        for x, n in zip(symbols, parts.tolist()):
            flat[at : at + len(x)] = x
            at += n * SEGMENT
        columns = np.ascontiguousarray(padded.T)
        starts = np.concatenate([[0], np.cumsum(parts)[:-1]])
        size = np.array([len(x) for x in symbols])
        extra = parts * SEGMENT - size  # padding counts one phrase each
        follows = np.ones(len(padded), bool)
        follows[starts] = False
        bits = np.array([(np.add.reduceat(a.phrases(columns, follows), starts) - extra) * a.bits / size for a in self.automata])
        order = np.argsort(bits, axis=0, kind="stable")
        first = np.take_along_axis(bits, order[:1], 0)[0]
        second = np.take_along_axis(bits, order[1:2], 0)[0] if len(bits) > 1 else np.full(len(first), np.inf)
        for k, i in enumerate(known):
            langs[i] = self.languages[order[0, k]]
            scores[i] = float(1 - first[k] / second[k]) if second[k] > 0 else 0.0
        return langs, scores


def labelled_sample(docs: DataFrame, keep: Column, per_language: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_DOC) -> dict[str, str]:
    """Of each language, pieces of the per_language labelled texts with the lowest hashes: its rows' number doesn't matter.

    A piece begins at a hashed place. Rows whose hashes can't be among the lowest go before anything is shuffled: what
    is left is 8 times as many as are needed.
    """
    known = docs.filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(8.0 * per_language) / F.count("*")).alias("share"))  # a row per language
    cut = known.select("lang", F.xxhash64("doc_id", F.lit(1)).alias("h"), F.substring(F.col("text"), place, F.lit(chars)).alias("part"))
    cut = cut.join(F.broadcast(shares), "lang").filter(in_lowest(F.col("h"), F.col("share")))
    cut = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("n") <= per_language)
    rows = cut.select("lang", "h", "part").collect()  # bounded by languages, per_language and chars
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.part)):
        out.setdefault(r.lang, []).append(r.part)
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text: the language whose text parses it into fewest phrases.

    Phrases are weighed by the bits of a place in the language's text and divided by the text's length. score: by which
    part the best needs less than the next (0 to 1). 'und' and 0 where the text is null or has no letter, or no
    language was learned. Equal languages: the first by name. Rows may repeat, an empty table gives no rows, columns other
    than doc_id and text aren't read. Very long texts are parsed whole.
    """

    model = Identifier(samples)  # of bounded size; the tasks get it with their code

    def work(rows):
        langs, scores = model.identify(rows["text"])
        return {"doc_id": rows["doc_id"], "lang_pred": langs, "score": scores}

    return map_texts(docs, lambda: work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The rows, all their columns, for whose own text identify() finds a language; a null doc_id doesn't matter."""
    at = docs.columns.index("text")
    model = Identifier(samples)

    def run(batches):
        for batch in slices(batches):
            langs, _ = model.identify(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" for x in langs]))

    return docs.mapInArrow(run, docs.schema)
